"""Removal of passages that an earlier document has, by fixed-block anchors.

A window of ``width`` words is repeated if its words also start somewhere in a
document with a smaller doc_id. Blocks of ``(width + 1) // 2`` words at
multiples of that length index every document: any window holds one whole
block of its own document. Every rolling block of every document probes the
index. Where a probe meets a block of an earlier document, the hit is extended
to both sides: the windows around it are compared exactly, and all that are
repeated mark their words, which together are the maximal repeats.

Anchors and windows travel as packed, sorted hashes. A task settles what it can
among its own documents and sends one entry for a hash that many of them share,
so a passage of a third of all documents costs an entry for each task. A task
answers with packed (document, hash) decisions; texts meet them by a hash of
doc_id, and a filter of bounded size keeps away the texts that none concerns.
Blocks are found by 48 bits of their hash (a false hit costs time only). Windows
of two documents are the same if a 64-bit hash and 32 bits of an independent one
are; within a document the 64 bits decide. A task holds one range of hashes, or
the decisions on one group of documents, at a time; their number follows the
input's size. With more than ``FAN`` of them rows go to wider ranges first, which
tasks split step by step (``refined``), so that neither the rows that a chunk
writes nor the entries of a hot hash in one range grow with the input.

Windows are judged on the input, not on what is left. Null, empty and short
texts lose nothing; a null doc_id neither loses words nor makes others lose
any; rows with the same doc_id aren't earlier than each other. Other columns
are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm import text_arrays
from planlens.llm.frames import blobs_of, filter_of, in_filter, offsets_of, planes, unplanes
from planlens.llm.worker_memory import give_back, slices
from planlens.workspace import Scratch, ship_package

WIDTH = 13
#: Words that a task compares among themselves before it sends entries.
CHUNK_WORDS = 500_000
#: Bytes of text for each range of hashes.
PART_BYTES = 8 << 20
BLOCK_SHIFT = 16
#: Ranges that a chunk's rows are divided into at most, and the tasks of a shuffle; a task takes its ranges one after another.
FAN, MOST_TASKS = 2_048, 20_000

ENTRIES, DECISIONS, TEXT = 0, 1, 2
PACKED = "kind int, bucket int, doc_id long, keys binary, owners binary, docs binary, flags binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("docs", pa.binary()), ("flags", pa.binary())])


def row(kind: int, bucket: int, keys: bytes, owners: bytes, docs: bytes, flags: bytes = b"", doc_id: int | None = None) -> pa.RecordBatch:
    values = (kind, bucket, doc_id, keys, owners, docs, flags)
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FIELDS)], schema=_FIELDS)


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (text_arrays.mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def spans_of(buckets: int) -> list[int]:
    """Ranges in a row's range, step by step down to 1; no step divides by more than ``FAN``."""
    steps = 1
    while FAN**steps < buckets:
        steps += 1
    fan = next(f for f in range(max(1, int(buckets ** (1 / steps)) - 1), buckets + 1) if f**steps >= buckets)
    return [fan**k for k in reversed(range(steps))]


@lru_cache(maxsize=4)
def cuts_of(bits: int, buckets: int, span: int, first: int, end: int) -> np.ndarray:
    """Keys at which the ranges of ``span`` begin after the first one, between ``first`` and ``end``."""
    return np.array([-(-(b << bits) // buckets) for b in range(first + span, min(end, buckets), span)], np.uint64)


def entry_rows(keys: np.ndarray, owners: np.ndarray, marks: np.ndarray, docs: np.ndarray, bits: int, buckets: int, span: int, first: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of sorted ``keys`` of ``bits`` bits by range of key; ``owners`` index ``docs``, ``marks`` are flags or further bits of the keys."""
    cuts = np.searchsorted(keys, cuts_of(bits, buckets, span, first, buckets if end is None else end))
    cuts = np.concatenate([[0], cuts, [len(keys)]])
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        part = slice(cuts[b], cuts[b + 1])
        used, own = np.unique(owners[part], return_inverse=True)
        gaps = np.diff(keys[part], prepend=np.uint64(0))
        yield row(ENTRIES, first + b * span, planes(gaps), planes(own.astype(np.uint32)), planes(docs[used]), np.packbits(marks[part]).tobytes() if marks.dtype == bool else planes(marks[part]))


def read_entries(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and marks of an entry row."""
    keys = np.cumsum(unplanes(r["keys"], "<u8"), dtype=np.uint64)
    docs = unplanes(r["docs"], "<i8")[unplanes(r["owners"], "<u4")]
    if len(r["flags"]) == 4 * len(keys):
        return keys, docs, unplanes(r["flags"], "<u4")
    return keys, docs, np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(keys)).astype(bool)


def decision_rows(docs: np.ndarray, keys: np.ndarray, buckets: int, span: int) -> Iterator[pa.RecordBatch]:
    """Rows of (document, key) decisions by hash of the document."""
    if not len(docs):
        return
    bucket = doc_bucket(docs, buckets) // span
    order = np.lexsort((keys, docs, bucket))
    docs, keys, bucket = docs[order], keys[order], bucket[order]
    cuts = np.append(np.flatnonzero(first_of(bucket)), len(bucket))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, counts = np.unique(docs[a:b], return_counts=True)
        yield row(DECISIONS, int(bucket[a]) * span, planes(keys[a:b]), planes(counts.astype(np.uint32)), planes(own))


def read_decisions(r: dict) -> Iterator[tuple[int, np.ndarray]]:
    docs, counts, keys = unplanes(r["docs"], "<i8"), unplanes(r["owners"], "<u4"), unplanes(r["keys"], "<u8")
    cuts = offsets_of(counts.astype(np.int64))
    for k, doc in enumerate(docs.tolist()):
        yield doc, keys[cuts[k] : cuts[k + 1]]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal sorted keys, and the run of each key."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.flatnonzero(first), np.cumsum(first) - 1


def block_hits(keys: np.ndarray, docs: np.ndarray, indexed: np.ndarray) -> np.ndarray:
    """Which of the sorted entries lie on a hit: a block of a document that a later one also has."""
    if not len(keys):
        return np.zeros(0, bool)
    starts, run = runs(keys)
    earliest = np.minimum.reduceat(np.where(indexed, docs, np.iinfo(np.int64).max), starts)[run]
    latest = np.maximum.reduceat(docs, starts)[run]
    return (earliest < latest) & (indexed & (docs < latest) | (docs > earliest))


def later_windows(keys: np.ndarray, docs: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which of the entries, sorted by key, have the same key and check in an earlier document."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.arange(len(keys))
    if ((keys[1:] == keys[:-1]) & (checks[1:] != checks[:-1])).any():
        order = np.lexsort((checks, keys))
    first = first_of(keys[order], checks[order])
    least = np.minimum.reduceat(docs[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    out = np.empty(len(keys), bool)
    out[order] = docs[order] > least
    return out


def first_of(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of adjacent rows that are equal in all columns."""
    differs = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        differs |= c[1:] != c[:-1]
    return np.concatenate([[True], differs])[: len(columns[0])]


def block_rows(keys, owner, indexed, docs, bits: int, buckets: int, doc_span: int, span: int, first: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """Decisions on the hits among these blocks, and the entries that stand for them."""
    order = np.argsort(keys, kind="stable")
    keys, owner, indexed = keys[order], owner[order], indexed[order]
    hit = block_hits(keys, docs[owner], indexed)
    found = np.flatnonzero(hit)
    found = found[first_of(keys[found], owner[found])]
    yield from decision_rows(docs[owner[found]], keys[found], buckets, doc_span)
    # of a settled run, its earliest indexed and its latest document stand for the rest
    _, run = runs(keys)
    speaks = ~hit & first_of(keys, owner, indexed)
    settled = np.flatnonzero(hit)
    if len(settled):
        by_doc = settled[np.lexsort((docs[owner[settled]], run[settled]))]
        speaks[by_doc[np.append(run[by_doc][1:] != run[by_doc][:-1], True)]] = True
        by_index = settled[indexed[settled]]
        by_index = by_index[np.lexsort((docs[owner[by_index]], run[by_index]))]
        speaks[by_index[first_of(run[by_index])]] = True
    yield from entry_rows(keys[speaks], owner[speaks], indexed[speaks], docs, bits, buckets, span, first, end)


def window_rows(keys, owner, checks, docs, bits: int, buckets: int, doc_span: int, span: int, first: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """Decisions on the repeats among these windows, and the earliest of each."""
    order = np.lexsort((docs[owner], checks, keys))
    keys, owner, checks = keys[order], owner[order], checks[order]
    repeated = later_windows(keys, docs[owner], checks)
    once = repeated & first_of(keys, docs[owner])
    yield from decision_rows(docs[owner[once]], keys[once], buckets, doc_span)
    speaks = first_of(keys, checks)
    yield from entry_rows(keys[speaks], owner[speaks], checks[speaks], docs, bits, buckets, span, first, end)


class Chunk:
    """Documents that a task compares among themselves."""

    def __init__(self):
        self.docs: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.words = 0

    def add(self, doc: int, hashes: np.ndarray) -> None:
        self.docs.append(doc)
        self.hashes.append(hashes)
        self.words += len(hashes)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, owner and place in its document of every window."""
        return self._inside(text_arrays.windows(np.concatenate(self.hashes), width), width)

    def checks(self, width: int) -> np.ndarray:
        """Further bits of the hash of every window."""
        other = text_arrays.windows(np.concatenate(self.hashes), width, text_arrays.OTHER_STEP)
        return self._inside((other >> np.uint64(32)).astype(np.uint32), width)[0]

    def _inside(self, found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(h) for h in self.hashes], np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)[: len(found)]
        place = np.arange(len(found)) - offsets_of(lengths)[owner]
        inside = place <= lengths[owner] - width
        return found[inside], owner[inside], place[inside]


def anchors(blobs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Entries of all rolling blocks, and the decisions on hits within a task."""
    block = (width + 1) // 2
    bits = 64 - BLOCK_SHIFT

    span = spans_of(buckets)[0]

    def settle(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        docs = np.array(chunk.docs, np.int64)
        keys, owner, place = chunk.windows(block)
        yield from block_rows(keys >> np.uint64(BLOCK_SHIFT), owner, place % block == 0, docs, bits, buckets, span, span)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for batch in slices(batches):
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                words = body.split()
                if len(words) >= width:
                    chunk.add(doc, text_arrays.word_hashes(words))
                if chunk.words >= CHUNK_WORDS:
                    yield from settle(chunk)
                    chunk = Chunk()
                    give_back()
        if chunk.docs:
            yield from settle(chunk)

    return blobs.filter("doc_id is not null").select("doc_id", "body").mapInArrow(run_, PACKED)


def ordered(packed: DataFrame, buckets: int, *then: str) -> DataFrame:
    """Range after range; a task has several where there are more than ``MOST_TASKS``."""
    return packed.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", *then)


def refined(packed: DataFrame, kind: int, buckets: int, rows: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of ``kind`` by single ranges. ``rows(held, wide, span, first)`` divides the rows of a range of ``wide`` ranges.

    A task holds as much as a chunk, whatever a range has; what it holds meets
    once more, so equal entries become fewer with each step.
    """
    spans = spans_of(buckets)
    for wide, span in zip(spans, spans[1:]):

        def run_(batches: Iterator[pa.RecordBatch], wide: int = wide, span: int = span) -> Iterator[pa.RecordBatch]:
            held, at, size = [], None, 0
            for batch in slices(batches):
                for r in batch.to_pylist():
                    if r["kind"] != kind:
                        yield row(r["kind"], r["bucket"], r["keys"], r["owners"], r["docs"], r["flags"])
                        continue
                    if held and (at != r["bucket"] or size >= CHUNK_WORDS):
                        yield from rows(held, wide, span, at)
                        held, size = [], 0
                    at = r["bucket"]
                    held.append(r)
                    size += len(r["keys"]) // 8
            if held:
                yield from rows(held, wide, span, at)

        packed = ordered(packed, buckets).mapInArrow(run_, PACKED)
    return packed


def refined_entries(packed: DataFrame, again: Callable[..., Iterator[pa.RecordBatch]], bits: int, buckets: int) -> DataFrame:
    """Entries by single ranges; ``again`` settles those that a task holds at once."""
    doc_span = spans_of(buckets)[0]

    def rows(held: list[dict], wide: int, span: int, first: int) -> Iterator[pa.RecordBatch]:
        keys, docs, marks = (np.concatenate(x) for x in zip(*map(read_entries, held)))
        used, owner = np.unique(docs, return_inverse=True)
        yield from again(keys, owner, marks, used, bits, buckets, doc_span, span, first, first + wide)

    return refined(packed, ENTRIES, buckets, rows)


def refined_decisions(packed: DataFrame, buckets: int) -> DataFrame:
    """Decisions by single groups of documents."""

    def rows(held: list[dict], wide: int, span: int, first: int) -> Iterator[pa.RecordBatch]:
        docs = np.concatenate([np.repeat(unplanes(r["docs"], "<i8"), unplanes(r["owners"], "<u4")) for r in held])
        yield from decision_rows(docs, np.concatenate([unplanes(r["keys"], "<u8") for r in held]), buckets, span)

    return refined(packed, DECISIONS, buckets, rows)


def settled(packed: DataFrame, judge, buckets: int) -> DataFrame:
    """Decisions of all tasks: ``judge`` marks the entries of a range of keys."""
    span = spans_of(buckets)[0]

    def decide(entries: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, docs, marks = (np.concatenate(x) for x in zip(*entries))
        entries.clear()
        order = np.argsort(keys, kind="stable")
        keys, docs, marks = keys[order], docs[order], marks[order]
        found = judge(keys, docs, marks)
        yield from decision_rows(docs[found], keys[found], buckets, span)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, at = [], None
        for batch in slices(batches):
            for r in batch.to_pylist():
                if entries and at != r["bucket"]:
                    yield from decide(entries)
                at = r["bucket"]
                if r["kind"] == DECISIONS:
                    yield row(DECISIONS, r["bucket"], r["keys"], r["owners"], r["docs"])
                else:
                    entries.append(read_entries(r))
        if entries:
            yield from decide(entries)

    return refined_decisions(ordered(packed, buckets).mapInArrow(run_, PACKED), buckets)


def concerned(decisions: DataFrame) -> bytes:
    """Filter of the documents that packed decisions name."""
    named = decisions.agg(F.sum(F.length("docs"))).first()[0] or 0
    return filter_of(decisions.select("docs"), lambda data: unplanes(data, "<i8"), named // 8)


def sent_texts(blobs: DataFrame, mask, buckets: int) -> DataFrame:
    """Compressed texts that the filter lets pass, by hash of doc_id."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            part = batch.take(pa.array(np.flatnonzero(in_filter(mask.value, batch.column("doc_id").to_numpy()))))
            bodies = [press(x) for x in part.column("body").to_pylist()]
            n, bucket = len(part), doc_bucket(part.column("doc_id").to_numpy(), buckets)
            nothing = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, TEXT, np.int32)), pa.array(bucket.astype(np.int32)), part.column("doc_id"), pa.array(bodies, pa.binary()), nothing, nothing, nothing], schema=_FIELDS)

    return blobs.filter("doc_id is not null").select("doc_id", "body").mapInArrow(run_, PACKED)


def met(decisions: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """Decisions and the texts they concern, group after group of documents, decisions first."""
    return ordered(decisions.unionByName(texts), buckets, "kind")


def with_decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(doc_id, text, keys decided for it) of every text of a partition of ``met``."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    decided: dict[int, list[np.ndarray]] = {}
    at = None
    for batch in slices(batches):
        for r in batch.to_pylist():
            if at != r["bucket"]:
                decided.clear()
                at = r["bucket"]
            if r["kind"] == DECISIONS:
                for doc, keys in read_decisions(r):
                    decided.setdefault(doc, []).append(keys)
            else:
                keys = decided.get(r["doc_id"])
                yield r["doc_id"], unpack(r["keys"]), np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def around_hits(together: DataFrame, width: int, buckets: int) -> DataFrame:
    """Entries of the windows around hits, and the decisions on repeats within a task."""
    block = (width + 1) // 2
    span = spans_of(buckets)[0]

    def settle(chunk: Chunk, near: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        docs = np.array(chunk.docs, np.int64)
        keys, owner, place = chunk.windows(width)
        lengths = np.array([len(h) for h in chunk.hashes], np.int64)
        wanted = np.concatenate(near)[offsets_of(lengths - width + 1)[owner] + place]
        yield from window_rows(keys[wanted], owner[wanted], chunk.checks(width)[wanted], docs, 64, buckets, span, span)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, near = Chunk(), []
        for doc, body, hits in with_decisions(batches):
            words = body.split()
            if len(words) < width or not len(hits):
                continue
            hashes = text_arrays.word_hashes(words)
            hit = np.isin(text_arrays.windows(hashes, block) >> np.uint64(BLOCK_SHIFT), hits)
            before = offsets_of(hit)
            at = np.arange(len(words) - width + 1)
            near.append(before[at + width - block + 1] > before[at])
            chunk.add(doc, hashes)
            if chunk.words >= CHUNK_WORDS:
                yield from settle(chunk, near)
                chunk, near = Chunk(), []
        if chunk.docs:
            yield from settle(chunk, near)

    return together.mapInArrow(run_, PACKED)


def kept_words(body: bytes, repeats: np.ndarray, width: int) -> tuple[list[bytes], list[bytes]]:
    """All words, and those that no repeated window covers."""
    words = body.split()
    if not len(repeats) or len(words) < width:
        return words, words
    marked = np.isin(text_arrays.windows(text_arrays.word_hashes(words), width), repeats)
    covers = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(marked)
    np.add.at(covers, at, 1)
    np.add.at(covers, at + width, -1)
    keep = np.cumsum(covers[:-1]) == 0
    return words, [words[k] for k in np.flatnonzero(keep).tolist()]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_RESULT_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def results(found: list[tuple[int | None, list[bytes], list[bytes]]], texts: bool) -> pa.RecordBatch:
    joined = [b" ".join(kept) for _, _, kept in found]
    columns = (
        [doc for doc, _, _ in found],
        [len(words) for _, words, _ in found],
        [len(words) - len(kept) for _, words, kept in found],
        [None if texts else hashlib.sha256(x).hexdigest() for x in joined],
        [x.decode() if texts else None for x in joined],
    )
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT_FIELDS)], schema=_RESULT_FIELDS)


def dedup(docs: DataFrame, width: int = WIDTH, texts: bool = False, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_removed of every row, and kept_sha256.

    With ``texts``, rows that lose words only, and ``kept`` (words joined by one
    blank) in place of the hash.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "substrings")
    blobs = blobs_of(docs, id_col, text_col)
    size = blobs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    blocks = refined_entries(anchors(blobs, width, buckets), block_rows, 64 - BLOCK_SHIFT, buckets)
    hits = scratch.save(settled(blocks, block_hits, buckets), "hits", compression="zstd")
    to_compare = spark.sparkContext.broadcast(concerned(hits))
    windows = refined_entries(around_hits(met(hits, sent_texts(blobs, to_compare, buckets), buckets), width, buckets), window_rows, 64, buckets)
    repeats = scratch.save(settled(windows, later_windows, buckets), "repeats", compression="zstd")
    to_change = spark.sparkContext.broadcast(concerned(repeats))
    scratch.drop_others("repeats")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            named = known & in_filter(to_change.value, batch.column("doc_id").fill_null(0).to_numpy())
            part = batch.take(pa.array(np.flatnonzero(~named)))
            yield results([(doc, words := body.split(), words) for doc, body in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist())], False)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for doc, body, keys in with_decisions(batches):
            words, kept = kept_words(body, keys, width)
            if not texts or len(kept) < len(words):
                found.append((doc, words, kept))
                size += len(words)
            if size > CHUNK_WORDS // 4:
                yield results(found, texts)
                found, size = [], 0
        yield results(found, texts)

    with_repeats = met(repeats, sent_texts(blobs, to_change, buckets), buckets).mapInArrow(changed, RESULT)
    if texts:
        return with_repeats.select("doc_id", "n_words", "n_removed", "kept")
    clean = blobs.select("doc_id", "body").mapInArrow(untouched, RESULT)
    return clean.unionByName(with_repeats).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``docs``, all columns; a text that loses words becomes those left, joined by one blank."""
    changed = dedup(docs, width, True, id_col, text_col, scratch).select(F.col("doc_id").alias("changed"), "kept").dropDuplicates(["changed"])
    both = docs.join(changed, docs[f"`{id_col}`"].cast("long") == changed["changed"], "left")
    return both.select(*(F.coalesce(changed["kept"], docs[f"`{c}`"]).alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns))
