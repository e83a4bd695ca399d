"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.columns import named
from planlens.llm.text_arrays import mix


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, named ``doc_id`` and ``text``; other columns can't clash with ours."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))


def blobs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text's UTF-8 bytes, empty for null, as ``doc_id`` and ``body``."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    return docs.select(named(id_col).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("body"))


def binary_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return column.to_pylist()


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Start of each item and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that high bytes, mostly zero, compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype)[:, 0]


def pressed_planes(x: np.ndarray) -> bytes:
    return _PRESS.compress(planes(x)) if len(x) else b""


def released_planes(data: bytes, dtype: str) -> np.ndarray:
    return unplanes(_RELEASE.decompress(data), dtype) if data else np.zeros(0, dtype)


_PRESS, _RELEASE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

#: Bits of a filter of ids: 16 for each id within these bounds, so 64 KB to 8 MB are broadcast.
LEAST_BITS, MOST_BITS = 19, 26


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def filter_of(frame: DataFrame, ids_of: Callable[[object], np.ndarray], expected: int) -> bytes:
    """A bitmap with a bit set for each of about ``expected`` ids; ``ids_of`` gives those of one value of the only column.

    With far more ids than its bound allows it lets everything pass, which costs
    a shuffle of what it would have kept away, and nothing else. A task sends
    its bitmap in parts, and parts are joined by place, so what is moved doesn't
    depend on how often an id occurs.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * expected).bit_length()))
    part = 1 << 16
    fields = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                at = np.unique(_places(ids_of(value), bits))
                if len(at):
                    first = np.flatnonzero(np.concatenate([[True], at[1:] >> 3 != at[:-1] >> 3]))
                    seen[at[first] >> 3] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)
        packed = seen.reshape(-1, part)
        used = np.flatnonzero(packed.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[k].tobytes() for k in used], pa.binary())], schema=fields)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, some in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                whole[k] = whole.get(k, 0) | np.frombuffer(some, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], schema=fields)

    out = np.zeros((1 << (bits - 3)) // part * part, np.uint8).reshape(-1, part)
    for r in frame.mapInArrow(mark, "part int, bits binary").repartition("part").mapInArrow(join, "part int, bits binary").collect():  # 2 ** bits bits in all
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def in_filter(mask: bytes, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in a filter; those that were put in always are."""
    at = _places(ids, (8 * len(mask)).bit_length() - 1)
    return (np.frombuffer(mask, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
