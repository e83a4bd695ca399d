"""Token counts by a map-side, two-tier lookup.

First pass: every task summarises its chunks (words with the blank before them)
by a bounded Misra-Gries summary, one packed row. Summaries are merged
``FAN_IN`` at a time, round after round, each merged one as bounded as the
others, so neither a task nor the driver gets more as the input grows. The
chunks with a certain share of all counts form a table of bounded size with the
token length of each, which is broadcast. Second pass: a chunk's length comes
from that table or else from a worker's cache, which asks the tokenizer for what
it doesn't know. No chunk is shuffled by its text or as a row, and which chunks
the table holds changes only the speed.

Null text counts as empty (0 tokens). Repeated rows and repeated ids give a row
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm import bpe_chunks
from planlens.llm.frames import texts_of
from planlens.llm.worker_memory import slices
from planlens.workspace import Scratch, ship_package

#: Chunks kept in a summary, and summaries merged by one task.
SUMMARY_SIZE, FAN_IN = 65_536, 16
#: Chunks with at least this part of all counts are in the table: no more than a summary holds.
LEAST_SHARE = 1 / 200_000
SUMMARY = "part int, total long, summary binary"


def misra_gries(counts: Counter, size: int) -> Counter:
    """Shrink to ``size`` entries, taking off what the next one has."""
    if len(counts) <= size:
        return counts
    top = counts.most_common(size + 1)
    off = top[-1][1]
    return Counter({k: n - off for k, n in top[:-1] if n > off})


def packed_summary(part: int, total: int, counts: Counter) -> pa.RecordBatch:
    keys = [k for k in counts if "\x01" not in k]
    body = np.array([counts[k] for k in keys], "<u8").tobytes() + "\x01".join(keys).encode("utf-8", "surrogatepass")
    data = zlib.compress(len(keys).to_bytes(4, "little") + body, 1)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["part", "total", "summary"])


def read_summary(data: bytes) -> Counter:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:4], "little")
    keys = data[4 + 8 * n :].decode("utf-8", "surrogatepass").split("\x01") if n else []
    return Counter(dict(zip(keys, np.frombuffer(data[4 : 4 + 8 * n], "<u8").tolist())))


def merged_summaries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One summary for each ``part``; the rows come sorted by it."""
    at, total, seen = None, 0, Counter()
    for batch in batches:
        for part, more, data in zip(*(batch.column(c).to_pylist() for c in ("part", "total", "summary"))):
            if at is not None and at != part:
                yield packed_summary(at, total, seen)
                total, seen = 0, Counter()
            at, total = part, total + more
            seen.update(read_summary(data))
            seen = misra_gries(seen, size)
    if at is not None:
        yield packed_summary(at, total, seen)


def frequent_chunks(docs: DataFrame, scratch: Scratch, size: int = SUMMARY_SIZE, share: float = LEAST_SHARE, fan_in: int = FAN_IN) -> list[str]:
    """Keys of the chunks that have at least ``share`` of the counts of all documents, by their merged summary."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    keys = bpe_chunks.word_keys(text)
                    total += len(keys)
                    seen.update(keys)
            if len(seen) > 4 * size:
                seen = misra_gries(seen, 2 * size)
        seen = misra_gries(Counter({k: n for k, n in seen.items() if n > 1 and len(k) <= 32}), size // 4)
        yield packed_summary(TaskContext.get().partitionId(), total, seen)

    rows = scratch.save(docs.select("text").mapInArrow(summarise, SUMMARY), "round0")
    k = 0
    while rows.count() > 1:
        k += 1
        grouped = rows.withColumn("part", F.expr(f"cast(part div {fan_in} as int)")).repartition("part").sortWithinPartitions("part")
        rows = scratch.save(grouped.mapInArrow(lambda batches: merged_summaries(batches, size), SUMMARY), f"round{k}")
    only = rows.first()
    scratch.drop()
    if only is None:
        return []
    return sorted(key for key, n in read_summary(bytes(only["summary"])).items() if n >= max(2, only["total"] * share))


class LengthTable:
    """Frequent chunks and their token lengths, one byte or two each; picklable."""

    def __init__(self, keys: list[str], lengths: np.ndarray):
        self.keys, self.lengths = "\x01".join(keys), lengths.astype(np.uint16).tobytes()

    def unpack(self) -> tuple[list[str], np.ndarray]:
        keys = self.keys.split("\x01") if self.lengths else []
        return keys, np.frombuffer(self.lengths, np.uint16)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = texts_of(docs, id_col, text_col)
    keys = frequent_chunks(texts, Scratch(spark, "counts"))
    encoder = bpe_chunks.byte_level_encoder(tokenizer_path)
    table = LengthTable(keys, encoder.key_lengths(keys))
    shared = spark.sparkContext.broadcast(table)
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = shared.value.unpack()
        frequent = dict(zip(known, range(len(known))))
        cache = bpe_chunks.byte_level_encoder(tokenizer_path)
        for batch in batches:
            n = [two_tier(text, frequent, lengths, cache) for text in batch.column("text").to_pylist()]
            n = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], schema=fields)

    sized = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def two_tier(text: str | None, frequent: dict[str, int], lengths: np.ndarray, cache: bpe_chunks.ChunkEncoder) -> int:
    """Token count of one text: the table first, the worker's cache for its misses."""
    if not text:
        return 0
    keys = bpe_chunks.word_keys(text)
    at = np.fromiter(map(frequent.get, keys, bpe_chunks.repeat(-1)), np.int64, len(keys))
    hit = at >= 0
    total = int(lengths[at[hit]].sum(dtype=np.int64))
    if not hit.all():
        missed = [keys[k] for k in np.flatnonzero(~hit).tolist()]
        total += int(cache.key_lengths(missed).sum())
    return total
