"""Token ids in files, by canonical length-limited Huffman codes.

Documents are dealt by ranges of their id, sorted, encoded once and kept as
blocks of whole documents. Counts of every id over all blocks give one code,
limited to ``MAX_BITS`` bits (package-merge) and canonical, so a file needs the
code lengths only. A block's bits can be decoded alone; a bit offset is kept
for every ``STEP``-th id, and decoding follows all these offsets side by side
by one table of ``2 ** MAX_BITS`` entries.

Layout: ``<path>/code`` (id, bits) and ``<path>/blocks/part=N/`` with the
blocks of one id range in order; ranges ascend with N. The bytes lie in binary
columns of uncompressed Parquet, so Spark's committer makes a lost or repeated
task harmless and any store Spark reads will do.

A null text is an empty document: its end id alone. Rows with the same doc_id
are all written, in an order that depends on their text alone; a null doc_id comes first. Other columns are
ignored. An empty table gives empty files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planlens.llm import bpe_chunks
from planlens.llm.frames import offsets_of, texts_of
from planlens.workspace import Scratch, ship_package

MAX_BITS = 16
STEP = 64
BLOCK_IDS = 1 << 17

BLOCK = "part int, seq int, n_ids long, doc_ids binary, lengths binary, ids binary"
STORED = "part int, seq int, n_ids long, doc_ids binary, lengths binary, checkpoints binary, bits binary"
_BLOCK_FIELDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])
_STORED_FIELDS = pa.schema([*list(_BLOCK_FIELDS)[:5], ("checkpoints", pa.binary()), ("bits", pa.binary())])
#: Stands for a null doc_id in a block.
_NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaves))
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    lengths = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, from the lengths alone: shorter first, then smaller ids."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[k]):
            code <<= n - before if before else 0
            codes[k], before = code, n
            code += 1
    return codes


class HuffmanCode:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(1, int(self.lengths.max(initial=1)))
        codes = canonical_codes(lengths)
        self.code = codes.astype(np.uint64)
        left = codes << (self.width - self.lengths).astype(np.uint32)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(left[used], kind="stable")]
        spans = 1 << (self.width - self.lengths[used])
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.taken = np.ones(1 << self.width, np.int64)
        self.symbol[: spans.sum()] = np.repeat(used, spans)
        self.taken[: spans.sum()] = np.repeat(self.lengths[used], spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offset of every STEP-th id, and the bits."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        starts = ends - n
        words = -(-int(ends[-1] if len(ends) else 0) // 32) + 1
        # a code lies in the 32-bit word of its first bit and perhaps the next; codes don't overlap, so sums join them
        lies = self.code[ids] << (64 - n - (starts & 31)).astype(np.uint64)
        at = starts >> 5
        joined = np.bincount(at, (lies >> np.uint64(32)).astype(np.float64), words)
        joined[1:] += np.bincount(at, (lies & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
        return starts[::STEP].astype("<u4"), joined.astype(np.uint64).astype(">u4").tobytes()

    def decode(self, n_ids: int, checkpoints: np.ndarray, bits: bytes) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.zeros((len(checkpoints), STEP), np.uint32)
        at = checkpoints.astype(np.int64)
        last = n_ids - STEP * (len(checkpoints) - 1)
        for k in range(STEP):
            if k == last:
                at = at[:-1]
            peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.width)
            out[: len(at), k] = self.symbol[peek]
            at = at + self.taken[peek]
        return out.reshape(-1)[:n_ids]


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Ids that cut the documents into ``ranges`` of about the same number."""
    cuts = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] if cuts else None
    return sorted(set(found or []))


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of whole documents, ascending by doc_id within a part and by part."""
    spark = docs.sparkSession
    bounds = range_bounds(docs, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt_fields = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            packed = [press((x or "").encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(np.array(bounds, np.int64), ids).astype(np.int32)), batch.column("doc_id"), pa.array(packed, pa.binary())], schema=dealt_fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        encoder = bpe_chunks.word_end_encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype)
        part, seq, held = None, 0, ([], [], [])

        def block() -> pa.RecordBatch:
            ids = np.concatenate([x for pair in held[2] for x in (pair, end)])
            lengths = np.array(held[1], "<i8") + 1
            values = (part, seq, len(ids), np.array(held[0], "<i8").tobytes(), lengths.tobytes(), ids.tobytes())
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK_FIELDS)], schema=_BLOCK_FIELDS)

        size = 0
        for batch in batches:
            docs_ids = batch.column("doc_id").fill_null(_NULL_ID).to_pylist()
            texts = [unpack(x).decode() for x in batch.column("packed").to_pylist()]
            for new, doc, ids in zip(batch.column("part").to_pylist(), docs_ids, encoder.encode(texts)):
                if held[0] and (new != part or size >= block_ids):
                    yield block()
                    seq, size = seq + 1, 0
                if new != part:
                    part, seq = new, 0
                held[0].append(doc)
                held[1].append(len(ids))
                held[2].append(ids)
                size += len(ids) + 1
        if held[0]:
            yield block()

    dealt = docs.mapInArrow(deal, "part int, doc_id long, packed binary")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "doc_id", "packed")
    return dealt.mapInArrow(encode, BLOCK)


def id_counts(blocks: DataFrame, vocabulary: int, dtype: str) -> np.ndarray:
    """Occurrences of every id over all blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, dtype), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[r["id"]] = r["n"]
    return out


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> None:
    """Encode ``docs`` and write their ids to ``path``."""
    spark = docs.sparkSession
    ship_package(spark)
    own = scratch or Scratch(spark, "tokens")
    dtype = bpe_chunks.narrow_dtype(tokenizer_path)
    blocks = own.save(encode_blocks(texts_of(docs, id_col, text_col), tokenizer_path, end_id), "ids", compression="zstd")
    size = max(end_id + 1, bpe_chunks.load_tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True))
    lengths = code_lengths(id_counts(blocks, size, dtype))
    spark.createDataFrame([(int(k), int(lengths[k])) for k in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast(lengths.tobytes())

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        huffman = HuffmanCode(np.frombuffer(code.value, np.uint8))
        for batch in batches:
            pressed = [huffman.encode(np.frombuffer(x, dtype)) for x in batch.column("ids").to_pylist()]
            columns = [batch.column(f.name) for f in list(_BLOCK_FIELDS)[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a.tobytes() for a, _ in pressed], pa.binary()), pa.array([b for _, b in pressed], pa.binary())], schema=_STORED_FIELDS)

    stored = blocks.mapInArrow(press, STORED).sortWithinPartitions("part", "seq")
    stored.write.partitionBy("part").option("compression", "uncompressed").parquet(f"{path}/blocks")
    own.drop("ids")


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/code").collect()  # at most the vocabulary
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, at, doc_id, start, ids of every document; start counts all ids before it."""
    ship_package(spark)
    return _with_starts(spark, path, _decoded(spark, path, lambda ids: ids.astype(np.int32).tolist(), ("ids", pa.list_(pa.int32())), "ids array<int>"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    ship_package(spark)
    out = _with_starts(spark, path, _decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), ("ids_crc32", pa.int64()), "ids_crc32 long"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, path: str, value, field: tuple, ddl: str) -> DataFrame:
    code = spark.sparkContext.broadcast(read_code(spark, path).tobytes())
    fields = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        huffman = HuffmanCode(np.frombuffer(code.value, np.uint8))
        for batch in batches:
            for r in batch.to_pylist():
                ids = huffman.decode(r["n_ids"], np.frombuffer(r["checkpoints"], "<u4"), r["bits"])
                lengths = np.frombuffer(r["lengths"], "<i8")
                cuts = offsets_of(lengths)
                docs = np.frombuffer(r["doc_ids"], "<i8")
                values = [value(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                columns = [np.full(len(docs), r["part"], np.int32), np.full(len(docs), r["seq"], np.int32), cuts[:-1]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(docs, mask=docs == _NULL_ID), pa.array(lengths), pa.array(values, field[1])], schema=fields)

    return blocks_of(spark, path).mapInArrow(run, f"part int, seq int, at long, doc_id long, n_tokens long, {ddl}")


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(f"{path}/blocks")


def _with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    sizes = blocks_of(spark, path).select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all"))  # a row for each id range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("into", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    blocks = blocks.select("part", "seq", (F.col("base") + F.col("into")).alias("first"))
    return rows.join(blocks, ["part", "seq"]).withColumn("start", F.col("first") + F.col("at")).drop("first")
