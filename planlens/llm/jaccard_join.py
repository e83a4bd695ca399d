"""Exact Jaccard self-join of documents on word shingles, up to components.

1. A scan gives each document's shingle-set size and digest, and a count sketch
   of fixed size of all shingles. Documents with equal sets are one class.
2. A second scan packs the shingles of a few hundred documents at a time by
   range of hash; a task for a range counts the documents of each shingle and
   answers with those of two documents or more. Hot shingles, that is those with
   a large counter in the sketch, are not sent: the sketch gives their place in
   the order. Only a class of which enough shingles occur elsewhere can have a
   link; the others end here.
3. Shingles have one global order, rarest first. If two sets are similar enough,
   their prefixes of ``size - needed + L`` shingles share at least ``L``. Every
   class chooses its own L by estimated cost: common shingles in a prefix make
   many candidates, so it is lengthened and more matches are asked for; a pair is
   held to the smaller L of its two classes.
4. A shingle's place in a prefix bounds the intersection of two classes that
   share it first, and with it the sizes a partner can have. A place for which
   the shingle has no class of such a size opens no pair.
5. Each class is compared with few others on whole sets: the hubs of most of its
   shared shingles, a hub being the class with the fewest shingles of its own
   (the original of a group of copies). These links give components.
6. What could still connect different components is every pair of classes that
   share enough prefix shingles and lie in different ones; all of these are
   verified. Pairs inside a component need no look, so copies and large groups
   don't multiply. Both steps' links give the final components.

Similarity is decided in integers: 100 * intersection >= percent * union, on the
64-bit hashes of the two sets at hand; classes go by 128 bits and then by their
smallest doc_id. The shortened hashes of step 2 only let more pairs through.

Null, empty and blank texts have an empty set and are linked with nothing;
texts of fewer words than a shingle are one shingle. Repeated rows and equal
texts are one class; rows with the same doc_id and different texts are linked
with whatever one of them is; a null doc_id gets a row of its own without links.
Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm import text_arrays
from planlens.llm.components import components
from planlens.llm.frames import blobs_of, filter_of, in_filter, offsets_of, pressed_planes, released_planes
from planlens.llm.worker_memory import give_back, slices
from planlens.workspace import Scratch, ship_package

WIDTH, PERCENT = 5, 75
#: Counters of the sketch, whatever the input: broadcast as one byte each.
SKETCH_BITS, CHUNK_BITS = 22, 16
#: A shingle is hot if its counter passes this and four times the mean counter.
HOT = 4096
#: Shingles that a task packs at a time, and entries of a range of hashes.
CHUNK_SHINGLES, PART_ENTRIES = 500_000, 2_000_000
#: Bits of a shortened hash above those that number all shingles: one in 2 ** SPARE_BITS looks shared and isn't.
SPARE_BITS = 12
#: Prefix extensions a class chooses from, and the cost of a candidate against a prefix shingle.
LEVELS, CANDIDATE_COST = (1, 2, 4, 8, 16, 32), 20.0
#: Hubs that a class is compared with in a round.
HUBS = 2
#: Pieces of the sketch above which they are added up in two rounds.
MANY_PIECES, SALTS = 4096, 32


def needed(size, percent: int = PERCENT):
    """Shingles that any similar set shares with one of ``size``, at least."""
    return -(-percent * size // 100)


def signatures(blobs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: a document's (doc_id, n, digest), and a task's packed part of the sketch."""
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for batch in slices(batches):
            sizes, digests, new = [], [], []
            for body in batch.column("body").to_pylist():
                s = text_arrays.shingle_set(body, width)
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                sizes.append(len(s))
                digests.append(digest)
                if digest and digest not in seen:
                    seen.add(digest)
                    new.append(s)
            if new:
                at, times = np.unique(np.concatenate(new) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                sketch[at] += times.astype(np.uint32)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=fields)
        chunks = sketch.reshape(-1, 1 << CHUNK_BITS)
        for k in np.flatnonzero(chunks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([packed_counts(chunks[k])], pa.binary())], schema=fields)

    return blobs.mapInArrow(run, "doc_id long, n long, digest binary, chunk int, counts binary")


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def added_counts(pieces: DataFrame) -> DataFrame:
    """One piece for each (chunk, salt): the sum of theirs."""
    fields = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, salt, packed in zip(*(batch.column(c).to_pylist() for c in ("chunk", "salt", "counts"))):
                counts = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<u8")[:, 0]
                sums[k, salt] = sums.get((k, salt), 0) + counts
        for (k, _), counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed_counts(counts)], pa.binary())], schema=fields)

    return pieces.repartition("chunk", "salt").mapInArrow(add, "chunk int, counts binary")


def merged_sketch(pieces: DataFrame) -> tuple[np.ndarray, float]:
    """Counters as bytes on a logarithmic scale (16 steps for each doubling from 4 on), and their mean."""
    if pieces.count() > MANY_PIECES:
        pieces = added_counts(pieces.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(SALTS))))
    rows = added_counts(pieces.withColumn("salt", F.lit(0))).collect()  # 8 bytes for each of 2 ** SKETCH_BITS counters, before compression
    out, total = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8), 0
    for r in rows:
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.uint8).reshape(8, -1).T.copy().view("<u8")[:, 0]
        out[r["chunk"]], total = to_level(counts), total + int(counts.sum())
    return out.reshape(-1), total / out.size


def to_level(counts: np.ndarray) -> np.ndarray:
    small = np.minimum(counts, 15)
    return np.where(counts < 16, small, np.minimum(255, 8 * np.log2(np.maximum(counts, 1)) - 16)).astype(np.uint8)


def from_level(level: np.ndarray) -> np.ndarray:
    x = level.astype(np.float64)
    return np.where(x < 16, x, 2.0 ** ((x + 16) / 8))


def choose_level(estimates: np.ndarray, size: int, percent: int) -> int:
    """The extension with the least cost; ``estimates`` are the other documents of each shingle, in order."""
    need = needed(size, percent)
    base = size - need
    others = np.concatenate([[0.0], np.cumsum(estimates)])
    best, least = 1, float("inf")
    for extra in LEVELS:
        if extra > need:
            break
        prefix = min(size, base + extra)
        cost = prefix + CANDIDATE_COST * others[prefix] / extra
        if cost < least:
            best, least = extra, cost
    return best


#: Rows between the tasks: a chunk's documents, its hot shingles, its shingles by range of hash, and the answers to these.
DOCS, HOTS, ENTRIES, SHARED = 0, 1, 2, 3
PACKED = "kind int, part int, chunk binary, keys binary, owners binary, extra binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.binary()), ("keys", pa.binary()), ("owners", pa.binary()), ("extra", pa.binary())])


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _FIELDS)], schema=_FIELDS)


def _gaps(keys: np.ndarray) -> bytes:
    return pressed_planes(np.diff(keys, prepend=np.uint64(0)))


def _ungaps(data: bytes) -> np.ndarray:
    return np.cumsum(released_planes(data, "<u8"), dtype=np.uint64)


def packed_shingles(blobs: DataFrame, sketch, hot_level: int, width: int, bits: int, parts: int) -> DataFrame:
    """Chunks of documents as packed rows. Equal sets of a chunk are one document, the one with the smallest id."""

    def settle(sets: list[np.ndarray], docs: list[int], levels: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], np.uint32)
        chunk = np.array([TaskContext.get().partitionId(), number], "<i8").tobytes()  # the same if the task is repeated
        keys, owner = np.concatenate(sets) >> np.uint64(64 - bits), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        keys, owner = keys[first], owner[first]
        kinds = np.bincount(owner, minlength=len(sets)).astype(np.uint32)
        at = xxhash.xxh3_64_intdigest(chunk) % parts
        yield _row(DOCS, at, chunk, pressed_planes(np.array(docs, np.int64)), pressed_planes(sizes), pressed_planes(kinds))
        level = levels[keys >> np.uint64(bits - SKETCH_BITS)]
        hot = level >= hot_level
        if hot.any():
            yield _row(HOTS, at, chunk, pressed_planes(keys[hot]), pressed_planes(owner[hot]), pressed_planes(level[hot]))
            keys, owner = keys[~hot], owner[~hot]
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        cuts = np.searchsorted(keys, np.array([-(-(p << bits) // parts) for p in range(1, parts)], np.uint64))
        cuts = np.concatenate([[0], cuts, [len(keys)]])
        for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = slice(cuts[p], cuts[p + 1])
            yield _row(ENTRIES, p, chunk, _gaps(keys[part]), pressed_planes(owner[part]), b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sketch.value, np.uint8)
        place: dict[bytes, int] = {}
        sets, docs, held, number = [], [], 0, 0
        for batch in slices(batches):
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                s = text_arrays.shingle_set(body, width)
                if not len(s):
                    continue
                k = place.setdefault(xxhash.xxh3_128_digest(s.tobytes()), len(docs))
                if k < len(docs):
                    docs[k] = min(docs[k], doc)
                    continue
                docs.append(doc)
                sets.append(s)
                held += len(s)
                if held >= CHUNK_SHINGLES:
                    yield from settle(sets, docs, levels, number)
                    sets, docs, held, number = [], [], 0, number + 1
                    place.clear()
        if docs:
            yield from settle(sets, docs, levels, number)

    return blobs.filter("doc_id is not null").select("doc_id", "body").mapInArrow(run, PACKED)


def shared_shingles(packed: DataFrame, parts: int) -> DataFrame:
    """For each entry whose shingle two documents or more have, how many (as a level); other rows pass."""

    def judge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        keys = [_ungaps(r["keys"]) for r in rows]
        cuts = offsets_of(np.array([len(k) for k in keys]))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        times = np.diff(np.append(np.flatnonzero(first), len(keys)))
        level = np.empty(len(keys), np.uint8)
        level[order] = to_level(times)[np.cumsum(first) - 1]
        for r, a, b in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist()):
            keep = level[a:b] > 1
            if keep.any():
                owner = released_planes(r["owners"], "<u4")
                yield _row(SHARED, r["part"], r["chunk"], _gaps(keys[a:b][keep]), pressed_planes(owner[keep]), pressed_planes(level[a:b][keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["part"] != r["part"]:
                    yield from judge(rows)
                    rows = []
                if r["kind"] == ENTRIES:
                    rows.append(r)
                else:
                    yield _row(*r.values())
        if rows:
            yield from judge(rows)
        give_back()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, PACKED)


CANDIDATES = "doc_id long, n long, extra int, common int, first int, prefix array<long>"


def prefixes(shared: DataFrame, parts: int, percent: int) -> DataFrame:
    """Prefixes of the documents that can have a link: shared shingles in order, the first at place ``first``."""
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("extra", pa.int32()), ("common", pa.int32()), ("first", pa.int32()), ("prefix", pa.list_(pa.int64()))])
    others_of = np.maximum(0, from_level(np.arange(256)) - 1)

    def judge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        docs, sizes, kinds = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        found = []
        for r in rows:
            if r["kind"] == DOCS:
                docs, sizes, kinds = released_planes(r["keys"], "<i8"), released_planes(r["owners"], "<u4"), released_planes(r["extra"], "<u4")
            else:
                keys = _ungaps(r["keys"]) if r["kind"] == SHARED else released_planes(r["keys"], "<u8")
                found.append((keys, released_planes(r["owners"], "<u4"), released_planes(r["extra"], "<u1")))
        if not found:
            return
        keys, owner, level = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((keys, level, owner))
        keys, owner, level = keys[order], owner[order], level[order]
        times = np.bincount(owner, minlength=len(docs))
        cuts = offsets_of(times)
        n = sizes.astype(np.int64)
        able = np.flatnonzero((times > 0) & (times >= needed(n, percent) - (n - kinds)))  # kinds < n where short hashes meet
        out: list[tuple] = []
        for k in able.tolist():
            size, single = int(n[k]), int(kinds[k]) - int(times[k])
            part = slice(cuts[k], cuts[k + 1])
            others = others_of[level[part]]
            extra = choose_level(np.concatenate([np.zeros(single), others]), size, percent)
            length = size - needed(size, percent) + extra - single
            prefix = keys[part][:length].astype(np.int64)
            out.append((int(docs[k]), size, extra, int(255 * np.mean(others[:length] > 1)), single, prefix))
        for a in range(0, len(out), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 200]), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and rows[0]["chunk"] != r["chunk"]:
                    yield from judge(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from judge(rows)
        give_back()

    return shared.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(run, CANDIDATES)


def _fitting(percent: int) -> tuple[Column, Column]:
    """Least and largest size of a class with which a shingle at this place can be the first shared one."""
    least = F.expr(f"({percent} * n + 99) div 100")
    most = F.expr(f"(n - place) * {100 + percent} div {percent} - n")
    return least, most


def shared_postings(found: DataFrame, percent: int) -> DataFrame:
    """shingle, node, n, extra, place of the prefix shingles of two classes or more, one of these as hub, and ``opens``.

    The hub is the class whose prefix is most common. The original of a group of
    edited copies has fewest shingles of its own, so the copies are nearer to it
    than to each other. ``opens`` says that the shingle has another class of a
    size with which it could be the first shared one. Sizes, not classes, are
    gathered for a shingle.
    """
    flat = found.select(F.posexplode("prefix").alias("at", "shingle"), F.col("doc_id").alias("node"), "n", "extra", "common", "first")
    flat = flat.select("shingle", "node", "n", "extra", (F.col("first") + F.col("at")).alias("place"), "common")
    sized = flat.groupBy("shingle", "n").agg(F.count("*").alias("times"), F.min(F.struct((-F.col("common")).alias("own"), "node")).alias("low"))
    best = F.min(F.struct("low.own", "low.node", "n"))
    groups = sized.groupBy("shingle").agg(F.sum("times").alias("all"), best.alias("best"), F.collect_list(F.struct("n", "times")).alias("sizes"))
    groups = groups.filter(F.col("all") > 1).select("shingle", F.col("best.node").alias("hub"), F.col("best.n").alias("hub_n"), "sizes")
    least, most = _fitting(percent)
    fits = F.exists("sizes", lambda s: (s["n"] >= F.col("least")) & (s["n"] <= F.col("most")) & ((s["n"] != F.col("n")) | (s["times"] > 1)))
    met = flat.withColumn("least", least).withColumn("most", most).join(groups, "shingle")
    return met.select("shingle", "node", "n", "extra", "place", "hub", "hub_n", fits.alias("opens"))


def verified(pairs: DataFrame, blobs: DataFrame, width: int, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """a, b, similar, distance for ``pairs`` (a, b) of classes' first documents, decided on whole sets.

    Texts are scanned again; a filter of bounded size picks those that a pair may
    need, so that others aren't shuffled.
    """
    spark = pairs.sparkSession
    pairs = scratch.save(pairs.select("a", "b").distinct(), f"{label}-pairs")
    wanted = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{label}-wanted")
    shared = spark.sparkContext.broadcast(filter_of(wanted, lambda doc: np.array([doc], np.int64), wanted.count()))
    fields = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = batch.take(pa.array(np.flatnonzero(in_filter(shared.value, batch.column("doc_id").to_numpy()))))
            out = [text_arrays.shingle_set(x, width).tobytes() for x in part.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], schema=fields)

    found = blobs.filter("doc_id is not null").mapInArrow(sets, "doc_id long, shingles binary")
    # rows with the same doc_id are one document with several texts, similar to another if one of them is
    ours, theirs = (found.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(theirs, "b").join(ours, "a").select("a", "b", "set_a", "set_b")
    decided = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similar", pa.bool_()), ("distance", pa.float64())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out, distance = [], []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                out.append(100 * common >= percent * union)
                distance.append(1 - common / union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_()), pa.array(distance, pa.float64())], schema=decided)

    return scratch.save(both.mapInArrow(decide, "a long, b long, similar boolean, distance double"), f"{label}-verified")


def star_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Each class against a few others: the hubs of most of its shared shingles, where the sizes allow it.

    ``postings`` has shingle, node, n and the shingle's hub, hub_n.
    """
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    met = postings.filter((F.col("node") != F.col("hub")) & fits).groupBy("node", "hub").agg(F.count("*").alias("shared"))
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "hub")), asc=False), 1, HUBS).alias("best"))
    return best.select(F.explode("best").alias("x"), F.col("node").alias("b")).select(F.col("x.hub").alias("a"), "b")


def cross_pairs(postings: DataFrame, roots: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs of classes in different components.

    For each shingle, classes outside its largest component meet all others, but
    only as if it were the first that the two share: then the intersection is at
    most one more than what either set has left, and that must be enough. A
    similar pair meets at least at its first common shingle, at a place that
    ``opens``. Pairs that met must share as many prefix shingles as the smaller
    of their extensions. Classes that were compared with the same hub need
    similar distances from it: Jaccard distance is a metric.
    """
    far = 1 - percent / 100 + 1e-9
    compared = stars.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("distance", F.col("a").alias("center"))).alias("x")).select("node", "x.center", "x.distance")
    step = F.greatest(F.lit(1), F.col("place") - F.col("n") + F.expr(f"({percent} * n + 99) div 100") + 1)
    opening = postings.filter("opens").join(roots.join(compared, "node", "full_outer"), "node", "left").select(
        "shingle", "node", "n", "extra", step.alias("step"), (F.col("n") - F.col("place") - 1).alias("rest"), F.coalesce("root", "node").alias("root"),
        F.coalesce("center", "node").alias("center"), F.coalesce("distance", F.lit(0.0)).alias("distance"),
    ).filter("step <= extra")
    sized = opening.groupBy("shingle", "root").agg(F.count("*").alias("size"))
    main = sized.groupBy("shingle").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("shingle", "main")
    placed = opening.join(main, "shingle")
    columns = ("node", "n", "extra", "step", "rest", "root", "center", "distance")
    few = placed.filter("root != main").select("shingle", *(F.col(c).alias(f"{c}_a") for c in columns))
    many = placed.select("shingle", "main", *(F.col(c).alias(f"{c}_b") for c in columns))
    asked = F.least("extra_a", "extra_b")
    met = few.join(many, "shingle").filter("root_a != root_b and (root_b = main or node_a < node_b)")
    met = met.filter((F.col("step_a") <= asked) & (F.col("step_b") <= asked))
    met = met.filter((100 + percent) * (1 + F.least("rest_a", "rest_b")) >= percent * (F.col("n_a") + F.col("n_b")))
    met = met.filter((F.col("center_a") != F.col("center_b")) | (F.abs(F.col("distance_a") - F.col("distance_b")) <= far))
    return met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(F.max(asked).alias("asked"))


def multiply_matched(pairs: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """The pairs that share as many prefix shingles as they are asked for."""
    step = F.greatest(F.lit(1), F.col("place") - F.col("n") + F.expr(f"({percent} * n + 99) div 100") + 1)
    more = pairs.filter("asked > 1")
    used = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    prefix = postings.join(used, "node", "left_semi").groupBy("node").agg(F.collect_list(F.struct(step.alias("step"), "shingle")).alias("prefix"))
    of = lambda x: prefix.select(F.col("node").alias(x), F.col("prefix").alias(f"prefix_{x}"))
    within = lambda x: F.transform(F.filter(f"prefix_{x}", lambda s: s["step"] <= F.col("asked")), lambda s: s["shingle"])
    enough = more.join(of("a"), "a").join(of("b"), "b").filter(F.size(F.array_intersect(within("a"), within("b"))) >= F.col("asked"))
    return pairs.filter("asked = 1").select("a", "b").unionByName(enough.select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "jaccard")
    blobs = blobs_of(docs, id_col, text_col)
    scanned = scratch.save(signatures(blobs, width), "signatures", compression="zstd")
    documents = scanned.filter("n is not null").select("doc_id", "n", "digest")
    levels, noise = merged_sketch(scanned.filter("chunk is not null").select("chunk", "counts"))
    total = documents.agg(F.sum("n")).first()[0] or 0
    heads = scratch.save(documents.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("head")), "classes")

    sketch = spark.sparkContext.broadcast(levels.tobytes())
    hot_level = int(to_level(np.array([max(hot, 4 * noise)]))[0])
    bits = min(62, max(32, total.bit_length() + SPARE_BITS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_ENTRIES + 1)
    shared = shared_shingles(packed_shingles(blobs, sketch, hot_level, width, bits, parts), parts)
    found = prefixes(shared, parts, percent).join(heads.select(F.col("head").alias("doc_id")), "doc_id", "left_semi")
    postings = scratch.save(shared_postings(scratch.save(found, "prefixes", compression="zstd"), percent), "postings", compression="zstd")

    stars = verified(star_pairs(postings, percent), blobs, width, percent, scratch, "star")
    links = stars.filter("similar").select("a", "b")
    roots = scratch.save(components(links, "a", "b", scratch, "first"), "first-roots")
    ends = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = cross_pairs(postings, roots, stars, percent).join(ends, ["a", "b"], "left_anti")
    rest = multiply_matched(scratch.save(rest, "met"), postings, percent)
    crossed = verified(rest, blobs, width, percent, scratch, "cross")
    every = links.union(crossed.filter("similar").select("a", "b"))
    final = scratch.save(components(every, "a", "b", scratch, "last"), "roots")
    scratch.drop_others("signatures", "classes", "roots")
    classed = documents.join(heads, "digest", "left").withColumn("head", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")))
    return classed.join(final, classed["head"] == final["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "head").alias("component_id"))


def near_duplicate_heads(docs: DataFrame, result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that aren't the first of their component."""
    kept = result.filter("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept["kept"]), "left_semi")
