"""Alignment of two tokenizations of the same bytes, by a sweep over where tokens end.

Every token of tokenizer A (byte-level BPE) and of B (sentencepiece with byte
fallback) is an event at the byte where it ends. Events of both sides are one
table, dealt out by document and sorted by offset; a machine reads them in
order. Where an event of A and one of B meet, a group closes; between two
neighbouring events lies exactly one pair of overlapping tokens, a link. The
machine keeps the open group and one block of events, whatever the length of a
document or partition; only links are left of what it passed. Events travel in
blocks: ids of up to ``BLOCK`` tokens and the offset where the first begins.

How often an id pair is linked is counted over all documents. Pairs with at
least one in ``TABLE`` of all links, of which there can't be more than that,
are looked up in a broadcast table; for the others, none of which is frequent,
links are joined to the counts.

A null or empty text, and one whose tokens don't spell a blank and the text
(as when it holds U+2581, which B reads as a blank), has no tokens: all its
numbers are 0 and ``groups_sha256`` is ''. Texts of any length are aligned
whole. Repeated rows and ids are documents of their own and get a row each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.bpe import byte_symbols
from planlens.llm.bpe_chunks import _BARE, _SAFE_CUT, ChunkEncoder, Encoded, spans
from planlens.llm.frames import offsets_of, planes, texts_of, unplanes
from planlens.llm.worker_memory import slices, worker_cache
from planlens.workspace import Scratch, ship_package

#: Chunks that A encodes as one text; added to ids of B where they stand beside A's.
JOINED, SECOND = 128, 1 << 24
#: Tokens of a block of events, and tokens that are swept at a time.
BLOCK, SWEPT = 16_384, 200_000
#: Pairs in the broadcast table, at most.
TABLE = 1 << 18
#: Distinct pairs that a counting task holds before it passes them on.
HELD = 2_000_000

EVENTS = "key long, doc_id long, start long, side int, ids binary"
SWEEP = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
BLANK = "▁"


def spaced_keys(text: str) -> list[str]:
    """Keys of the chunks of a blank and ``text``; each chunk begins with a blank or a newline.

    No token of either side goes over such a cut: pieces of A and of B never hold
    anything before a blank, nor a newline with letters after other characters.
    """
    words = text.replace("\n", " \n").split(" ")
    if "" in words or "\n" in words or _BARE in text or len(words) != len(text.split()):
        return [_BARE + x for x in _SAFE_CUT.split(" " + text)]
    return words


def flat(found: list[list[int]]) -> Encoded:
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return lengths, np.fromiter(chain.from_iterable(found), "<u4", int(lengths.sum()))


class Vocabulary:
    """Bytes of each id; one id more stands for a chunk whose tokens don't spell it."""

    def __init__(self, strings: list[bytes]):
        self.strings = [*strings, b""]
        self.wrong = len(strings)
        self.lengths = np.fromiter(map(len, self.strings), np.int64, len(self.strings))

    def checked(self, chunks: list[str], lengths: np.ndarray, ids: np.ndarray) -> Encoded:
        """All chunks at a time; one by one only if some chunk isn't spelled."""
        spell, cuts = self.strings.__getitem__, offsets_of(lengths)
        sizes = np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in chunks), np.int64, len(chunks))
        if np.array_equal(offsets_of(self.lengths[ids])[cuts[1:]], np.cumsum(sizes)) and b"".join(map(spell, ids.tolist())) == "".join(chunks).encode():
            return lengths, ids
        parts = (ids[a:b].tolist() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return flat([part if b"".join(map(spell, part)) == chunk.encode() else [self.wrong] for chunk, part in zip(chunks, parts)])


class ByteSide(Vocabulary):
    """A: the tokenizers library on byte-level BPE; special strings are plain text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {s: b for b, s in byte_symbols().items()}
        strings = [b""] * (max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in vocab.items():
            strings[i] = bytes(map(back.get, token)) if all(c in back for c in token) else token.encode()
        super().__init__(strings)
        self.opens = np.array([x[:1] in (b" ", b"\n") for x in self.strings])

    def found(self, texts: list[str]) -> Encoded:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def encode_many(self, chunks: list[str]) -> Encoded:
        """Chunks with no white space but the first character go joined, ``JOINED`` at a time: each token that begins with such a character opens one."""
        plain = np.array([x[0] in " \n" and x[1:].split() == [x[1:]] for x in chunks], bool)
        simple, rest = list(compress(chunks, plain)), list(compress(chunks, ~plain))
        ids = self.found(["".join(simple[k : k + JOINED]) for k in range(0, len(simple), JOINED)])[1]
        edges = np.flatnonzero(self.opens[ids])
        if len(edges) != len(simple):
            return self.checked(chunks, *self.found(chunks))
        lengths, starts = np.empty((2, len(chunks)), np.int64)
        lengths[plain], starts[plain] = np.diff(edges, append=len(ids)), edges
        lengths[~plain], more = self.found(rest)
        starts[~plain] = len(ids) + offsets_of(lengths[~plain])[:-1]
        return self.checked(chunks, lengths, np.concatenate([ids, more])[spans(starts, lengths)])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class PieceSide(Vocabulary):
    """B: sentencepiece, which puts a blank before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.blank = self.model.piece_to_id(BLANK)
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])

    def encode_many(self, chunks: list[str]) -> Encoded:
        """A chunk begins with the blank that the library adds, or with a newline, before which the added blank stays alone."""
        found = self.model.encode([x.removeprefix(" ") for x in chunks], num_threads=1)
        return self.checked(chunks, *flat([ids if x[0] == " " else ids[1:] if ids[:1] == [self.blank] else [] for x, ids in zip(chunks, found)]))

    def whole(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class WholeChunks(ChunkEncoder):
    """Of both sides: a chunk's ids of A, then those of B, which have ``SECOND`` added.

    Unlike its base it takes no chunk apart: letters and marks may share a piece.
    """

    def __init__(self, *sides: Vocabulary):
        self.sides = sides
        super().__init__(self.encode_both, "<u4", spaced_keys, bound=400_000, words=150_000)

    def _learn(self, lost: list[str]) -> None:
        self._append(lost, *self.encode_many([self.chunk(k) for k in lost]))

    def encode_both(self, chunks: list[str]) -> Encoded:
        uncut = lambda side: (np.ones(len(chunks), np.int64), np.full(len(chunks), side.wrong, "<u4"))
        (n_a, ids_a), (n_b, ids_b) = (side.encode_many(chunks) if getattr(side, "cuts", True) else uncut(side) for side in self.sides)
        starts = offsets_of(n_a + n_b)[:-1]
        ids = np.empty(len(ids_a) + len(ids_b), "<u4")
        ids[spans(starts, n_a)], ids[spans(starts + n_a, n_b)] = ids_a, ids_b + SECOND
        return n_a + n_b, ids

    def ids_of_texts(self, texts: list[str]) -> Iterator[list[np.ndarray | None]]:
        """Ids of each text on both sides, None where they don't spell it."""
        for text, both in zip(texts, self.encode(texts)):
            second, out = both >= SECOND, []
            for side, ids in zip(self.sides, (both[~second], both[second] - SECOND)):
                if (ids == side.wrong).any():  # a chunk isn't spelled, or the vocabulary allows no cuts
                    whole = side.whole(text)
                    ids = np.array(whole, "<u4") if b"".join(map(side.strings.__getitem__, whole)) == b" " + text.encode() else None
                out.append(ids)
            yield out


@cache
def side_of(kind: type[Vocabulary], path: str) -> Vocabulary:
    """Once for each worker."""
    return kind(path)


def encoder_of(path_a: str, path_b: str) -> WholeChunks:
    """Kept by the worker, so that later tasks find what earlier ones learned."""
    return worker_cache(f"aligned {path_a} {path_b}", lambda: WholeChunks(side_of(ByteSide, path_a), side_of(PieceSide, path_b)))


def end_events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of the events of both sides (0: A, 1: B); a document without tokens is a row of side 2.

    ``key`` tells rows apart: the task's number and the row's place in it, both
    the same if a task runs again.
    """
    fields = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("side", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path_a, path_b)
        sides = encoder.sides
        key = TaskContext.get().partitionId() << 36
        for batch in slices(batches, keep=f"aligned {path_a} {path_b}"):
            rows: list[tuple] = []
            texts = [t if t and BLANK not in t else "" for t in batch.column("text").to_pylist()]
            for doc, text, (a, b) in zip(batch.column("doc_id").to_pylist(), texts, encoder.ids_of_texts(texts)):
                if not text or a is None or b is None:
                    rows.append((key, doc, 0, 2, b""))
                else:
                    for side, ids in enumerate((a, b)):
                        starts = [0] if len(ids) <= BLOCK else np.concatenate([[0], np.cumsum(sides[side].lengths[ids])])[:-1:BLOCK].tolist()
                        rows += [(key, doc, at, side, ids[k : k + BLOCK].astype("<u2" if sides[side].wrong < 1 << 16 else "<u4").tobytes()) for k, at in zip(range(0, len(ids), BLOCK), starts)]
                key += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, EVENTS)


_PRESS, _RELEASE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed_links(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct pairs and how often each occurs."""
    return _PRESS.compress(planes(np.diff(pairs, prepend=0).astype("<u8")) + planes(counts.astype("<u4"))) if len(pairs) else b""


def unpacked_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    body = _RELEASE.decompress(data)
    n = len(body) // 12
    return np.cumsum(unplanes(body[: 8 * n], "<u8").astype(np.int64)), unplanes(body[8 * n :], "<u4").astype(np.int64)


class Machine:
    """Reads blocks in order of (document, offset) and puts out a row for each document.

    Documents lie one after the other on a line of bytes. A sweep covers the events
    up to the last place where both sides end; the rest stays for the next one. If
    a group is longer than what was read, twice as much is read before the next try.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides, self.width = (a, b), len(b.strings)
        # a token's decimal id and what follows it: A by ',' or '|', B by ',' or ';'
        texts = [b"%d%s" % (i, mark) for side, marks in ((a, b",|"), (b, b",;")) for i in range(len(side.strings)) for mark in (marks[:1], marks[1:])]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.texts = np.array(texts).view(np.uint8).reshape(len(texts), -1)  # with zero bytes after shorter ones
        self.ids: tuple[list, list] = ([], [])
        self.ends: tuple[list, list] = ([], [])
        self.waiting, self.enough = 0, SWEPT
        self.at = self.reached = 0  # where the open document begins, and how far its events go
        self.open: tuple | None = None
        self.closed: list[tuple] = []  # (key, doc_id, end) of documents whose events are all here
        self._fresh()

    def _fresh(self) -> None:
        self.totals, self.hash, self.links = np.zeros(4, np.int64), None, []

    def read(self, key: int, doc: int | None, start: int, side: int, ids: bytes) -> Iterator[tuple]:
        if self.open and self.open[0] != key:
            self.close()
        self.open = (key, doc)
        if side < 2:
            vocabulary = self.sides[side]
            block = np.frombuffer(ids, "<u2" if vocabulary.wrong < 1 << 16 else "<u4").astype(np.int64)
            ends = self.at + start + np.cumsum(vocabulary.lengths[block])
            self.ids[side].append(block)
            self.ends[side].append(ends)
            self.waiting += len(block)
            self.reached = max(self.reached, int(ends[-1]))
        if self.waiting >= self.enough or len(self.closed) >= 20_000:
            yield from self.sweep()

    def close(self) -> None:
        if self.open:
            self.closed.append((*self.open, self.reached))
            self.at, self.open = self.reached, None

    def sweep(self) -> Iterator[tuple]:
        (ids_a, ids_b), (ends_a, ends_b) = ([np.concatenate([np.zeros(0, np.int64), *x]) for x in xs] for xs in (self.ids, self.ends))
        meet = np.isin(ends_a, ends_b, assume_unique=True)
        last = int(ends_a[meet][-1]) if meet.any() else -1
        n_a, n_b = np.searchsorted(ends_a, last, "right"), np.searchsorted(ends_b, last, "right")
        rest = (ids_a[n_a:], ids_b[n_b:]), (ends_a[n_a:], ends_b[n_b:])
        ids_a, ids_b, ends_a, ends_b, meet = ids_a[:n_a], ids_b[:n_b], ends_a[:n_a], ends_b[:n_b], meet[:n_a]
        # events in order; an interval between two is one link
        places = np.concatenate([ends_a, ends_b])
        order = np.argsort(places, kind="stable")  # of two at one place A's comes first
        sorted_places = places[order]
        new = np.concatenate([[True], sorted_places[1:] != sorted_places[:-1]]) if len(places) else np.zeros(0, bool)
        bounds = sorted_places[new]
        of_a = np.cumsum(order < n_a)
        first = np.flatnonzero(new)
        ends_here = order[first] < n_a
        at_a = of_a[first] - ends_here
        at_b = first - at_a
        pairs = ids_a[at_a] * self.width + ids_b[at_b] if len(first) else np.zeros(0, np.int64)
        # groups: tokens of A, then tokens of B
        meet_b = np.isin(ends_b, ends_a[meet], assume_unique=True)
        upto_a, upto_b = np.flatnonzero(meet) + 1, np.flatnonzero(meet_b) + 1
        group_a, group_b = np.cumsum(meet) - meet, np.cumsum(meet_b) - meet_b
        text = np.zeros(n_a + n_b, np.int64)
        text[np.arange(n_a) + np.concatenate([[0], upto_b])[group_a]] = 2 * ids_a + meet
        text[np.arange(n_b) + upto_a[group_b]] = 2 * len(self.sides[0].strings) + 2 * ids_b + meet_b
        # documents
        closed, self.closed = self.closed, []
        stops = np.array([end for *_, end in closed] + [max(last, self.reached)], np.int64)
        cuts = [np.concatenate([[0], np.searchsorted(x, stops, "right")]) for x in (ends_a, ends_b, ends_a[meet], bounds)]
        of_doc = np.repeat(np.arange(len(stops)), np.diff(cuts[3]))
        linked, counts = np.unique(of_doc << 44 | pairs, return_counts=True)
        link_cuts = np.searchsorted(linked >> 44, np.arange(len(stops) + 1))
        linked &= (1 << 44) - 1
        written = self.texts.take(text, axis=0).ravel()
        written, begins = written[written != 0].tobytes(), offsets_of(self.sizes[text])[cuts[0] + cuts[1]].tolist()
        for k in range(len(stops)):
            self.totals += [int(c[k + 1] - c[k]) for c in cuts]
            piece = written[begins[k] : begins[k + 1]][:-1]
            if piece:
                if self.hash is None:
                    self.hash = hashlib.sha256(piece)
                else:
                    self.hash.update(b";" + piece)
                self.links.append((linked[link_cuts[k] : link_cuts[k + 1]], counts[link_cuts[k] : link_cuts[k + 1]]))
            if k < len(closed):
                some = self.links[0] if len(self.links) == 1 else summed(self.links)
                yield (*closed[k][:2], *self.totals.tolist(), self.hash.hexdigest() if self.hash else "", packed_links(*some))
                self._fresh()
        self.ids, self.ends = ([rest[0][0]], [rest[0][1]]), ([rest[1][0]], [rest[1][1]])
        self.waiting = len(rest[0][0]) + len(rest[0][1])
        self.enough = max(SWEPT, 2 * self.waiting)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of several lists, with their counts added up."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, back, np.concatenate([n for _, n in parts]))
    return pairs, counts


def swept(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: its numbers of tokens, groups and links, the hash of its groups, its links."""
    fields = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary())])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, rows = Machine(side_of(ByteSide, path_a), side_of(PieceSide, path_b)), []
        for batch in slices(batches, keep=""):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "start", "side", "ids"))):
                rows += machine.read(*row)
            if rows:
                yield rows_of(rows)
                rows = []
        machine.close()
        if rows := list(machine.sweep()):
            yield rows_of(rows)

    dealt = events.repartition("key").sortWithinPartitions("key", "start", "side")
    return dealt.mapInArrow(run, SWEEP)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n over all rows; a task adds up what it reads."""
    fields = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        emit = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], schema=fields)
        for batch in slices(batches, keep=""):
            more = [unpacked_links(data) for data in batch.column(0).to_pylist() if data]
            held += more
            size += sum(len(p) for p, _ in more)
            if size > HELD:
                held = [summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield emit(held[0])
                    held, size = [], 0
        yield emit(summed(held))

    return links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def looked_up(found: DataFrame, table: pa.Table) -> DataFrame:
    """Links against the broadcast table: a row for each document with sums over its frequent pairs, and one for each other pair of it."""
    spark = found.sparkSession
    order = np.argsort(table.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))
    fields = pa.schema([("key", pa.int64()), ("pair", pa.int64()), ("times", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, best = shared.value
        for batch in slices(batches, keep=""):
            parts = [unpacked_links(data) for data in batch.column("links").to_pylist()]
            sizes = np.fromiter((len(p) for p, _ in parts), np.int64, len(parts))
            keys = batch.column("key").to_numpy()
            pairs, times = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            doc = np.repeat(np.arange(len(parts)), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, len(parts)), np.int64)
            np.add.at(sums[0], doc[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], doc[hit], times[hit] * total[at[hit]])
            rare, none = ~hit, np.zeros(int((~hit).sum()), np.int64)
            columns = [np.concatenate(x) for x in ((keys, keys[doc[rare]]), (np.full(len(keys), -1), pairs[rare]), (np.zeros(len(keys), np.int64), times[rare]), (sums[0], none), (sums[1], none))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=fields)

    return found.select("key", "links").mapInArrow(run, "key long, pair long, times long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    n_best counts the links whose pair is the most frequent one of its B id in all
    documents, ties included; count_sum adds up the pairs' counts over the links.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "alignment")
    found = scratch.save(swept(end_events(texts_of(docs, id_col, text_col), path_a, path_b), path_a, path_b), "swept")
    width = len(side_of(PieceSide, path_b).strings)
    counts = scratch.save(pair_counts(found), "counts").withColumn("b", F.col("pair") % width)
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # at most one row for each id of B
    pairs = scratch.save(counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")
    least = (pairs.agg(F.sum("n")).first()[0] or 0) / table
    frequent = F.col("n") >= least  # at most ``table`` of them
    parts = scratch.save(looked_up(found, pairs.filter(frequent).toArrow()), "parts")
    rare = parts.filter("pair >= 0").join(pairs.filter(~frequent), "pair")
    rare = rare.select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = parts.filter("pair < 0").select("key", "n_best", "count_sum").unionByName(rare)
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    whole = sums.select("key", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in numbers), "n_best", "count_sum")
    whole = whole.unionByName(found.select("key", *numbers, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")))
    out = whole.groupBy("key").agg(*(F.max(c).alias(c) for c in numbers), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    scratch.drop("counts")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
