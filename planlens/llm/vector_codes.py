"""Vector codes: codebooks for parts of vectors by Lloyd rounds with Elkan's bounds.

A vector's components become integers (floor of ``SCALE`` times each); its
``PARTS`` equal parts are coded each by the nearest of ``ENTRIES`` codebook
entries. Between rounds every part keeps its entry, an upper bound of the
distance to it and a lower bound of the distance to each entry, as integers
that are rounded outwards, so that they are bounds exactly. When entries move,
bounds are shifted by how far each moved. An entry is passed over only if it is
strictly farther by the triangle inequality; all others are compared by exact
integer squares, ties to the lower index. Bounds take two bytes: lower ones are
cut to what fits, and an upper one that doesn't fit counts as unknown.

A round is one pass over the table of vectors and bounds that the round before
wrote. Sums for the new entries are added up in each task and then in Spark, as
limbs of 30 bits, so they are exact at any size; the driver gets one row for
each entry and position. Neither a label nor a vector that a third of all rows
share is ever one task's.

Vectors that are null or hold null or non-finite components are dropped, and so
are those of another length than the vector with the smallest id that can be cut
evenly (so are empty ones). Codebooks start from the vectors with the
smallest ids; null ids come last, and rows of one id are taken by their
components, so equal ids have a defined order. With fewer vectors than entries
codebooks are smaller. Repeated rows get a row each; other columns are ignored;
an empty table gives no rows. ``error`` and ``label_error`` are null where they
don't fit 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.columns import named
from planlens.llm.worker_memory import slices
from planlens.workspace import Scratch, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: What two bytes hold; as an upper bound it means that none is known.
MOST = 65_535
#: Bits of a limb of a sum, and limbs: enough for any double times ``SCALE``, with sums over 2 ** 33 rows in each limb.
LIMB_BITS, LIMBS = 30, 36
#: Labels whose totals are broadcast, at most; beyond it they are joined by a shuffle.
LABELS = 100_000

STATE = "vec_id long, label {label}, vector binary, entries binary, upper binary, lower binary"


@dataclass
class Codebooks:
    """Entries of all parts, and how they moved in the last round (rounded up)."""

    entries: list[list[list[int]]]  # by part, entry, position
    moved: list[list[int]]

    def arrays(self, part: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, distances between entries (rounded down), movements."""
        found = np.array(self.entries[part], object if wide else np.int64)
        between = floor_root(((found[:, None, :] - found[None, :, :]) ** 2).sum(axis=2))
        return found, between, np.array(self.moved[part], object if wide else np.int64)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


_ROOT = np.frompyfunc(math.isqrt, 1, 1)


def floor_root(squares: np.ndarray) -> np.ndarray:
    """Exact integer square roots, rounded down."""
    if squares.dtype == object:
        return _ROOT(squares)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares)


def safe_size(width: int) -> int:
    """Components up to this size have squared distances that fit 64 bits."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def floored(column: pa.Array, width: int) -> np.ndarray:
    """Components as integers, one row for each vector; Python's own where 64 bits could overflow."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    if not values.size or np.abs(values).max() < safe_size(width) / SCALE:
        return np.floor(SCALE * values).astype(np.int64)
    return np.array([math.floor(Fraction(x) * SCALE) for x in values.ravel().tolist()], object).reshape(-1, width)


def packed_vector(row: np.ndarray) -> bytes:
    """Little-endian components of 2 or 4 bytes, or decimal text; the first byte tells which."""
    size = max(abs(int(row.min())), abs(int(row.max())))
    if size < 1 << 15:
        return b"2" + row.astype("<i2").tobytes()
    return b"4" + row.astype("<i4").tobytes() if size < 1 << 31 else b"t" + ",".join(map(str, row.tolist())).encode()


def unpacked_vectors(data: list[bytes], width: int) -> np.ndarray:
    kinds = {x[:1] for x in data}
    if len(kinds) == 1 and kinds <= {b"2", b"4"}:
        size = int(kinds.pop())
        raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)[:, 1:]
        return np.ascontiguousarray(raw).view(f"<i{size}").astype(np.int64)
    read = lambda x: np.frombuffer(x[1:], f"<i{int(x[:1])}").tolist() if x[:1] != b"t" else [int(c) for c in x[1:].split(b",")]
    rows = [read(x) for x in data]
    most = max((abs(c) for row in rows for c in row), default=0)
    return np.array(rows, object if most > safe_size(width) else np.int64).reshape(len(data), -1)


def assigned(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries of one part of many vectors, from the last entries and bounds; with new bounds.

    ``MOST`` as an upper bound is none at all.
    """
    found, between, moved = books
    n, every = len(x), np.arange(len(found))
    lower = np.maximum(lower - moved, 0)
    upper = np.where(upper >= MOST, MOST, np.minimum(upper + moved[entry], MOST))

    def may_be_nearer(rows: np.ndarray, bound: np.ndarray, known: np.ndarray) -> np.ndarray:
        bound = bound[:, None]
        out = (bound >= lower[rows]) & (2 * bound >= between[entry[rows]])
        out |= ~known[:, None]
        return out & (every != entry[rows][:, None])

    every_row = np.arange(n)
    rows = np.flatnonzero(may_be_nearer(every_row, upper, upper < MOST).any(axis=1) | (upper >= MOST))
    if len(rows):
        own = ((x[rows] - found[entry[rows]]) ** 2).sum(axis=1)
        exact = ceil_root(own)
        left = may_be_nearer(rows, exact, np.ones(len(rows), bool))
        squares = np.full((len(rows), len(found)), -1, x.dtype)
        squares[np.arange(len(rows)), entry[rows]] = own
        at, k = np.nonzero(left)
        squares[at, k] = ((x[rows[at]] - found[k]) ** 2).sum(axis=1)
        seen = squares >= 0
        lower[rows] = np.where(seen, np.minimum(floor_root(np.where(seen, squares, 0)), MOST), lower[rows])
        best = np.argmin(np.where(seen, squares, squares.max() + 1), axis=1)  # the first of equals
        entry, upper = entry.copy(), upper.copy()
        entry[rows] = best
        upper[rows] = np.minimum(ceil_root(squares[np.arange(len(rows)), best]), MOST)
    return entry, upper, lower


def next_state(batch: pa.RecordBatch, books: Codebooks, width: int, label: pa.DataType) -> pa.RecordBatch:
    """A batch of vectors with entries and bounds of another round."""
    vectors = unpacked_vectors(batch.column("vector").to_pylist(), width)
    n, part, k = len(vectors), width // PARTS, len(books.entries[0])
    wide = vectors.dtype == object or any(abs(c) > safe_size(width) for p in books.entries for e in p for c in e)
    vectors = vectors.astype(object) if wide else vectors
    read = lambda name, kind, shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, *shape).astype(np.int64)
    entry, upper, lower = read("entries", "u1", (PARTS,)), read("upper", "<u2", (PARTS,)), read("lower", "<u2", (PARTS, k))
    for p in range(PARTS):
        kept = (upper[:, p].astype(object), lower[:, p].astype(object)) if wide else (upper[:, p], lower[:, p])
        entry[:, p], upper[:, p], lower[:, p] = assigned(vectors[:, p * part : (p + 1) * part], entry[:, p], *kept, books.arrays(p, wide))
    rows = lambda a, kind: pa.array([r.tobytes() for r in a.reshape(n, -1).astype(kind)], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), rows(entry, "u1"), rows(upper, "<u2"), rows(lower, "<u2")], names=["vec_id", "label", "vector", "entries", "upper", "lower"])


def limbs(x: int) -> list[int]:
    """Parts of an integer: ``LIMB_BITS`` each, the last with the sign."""
    mask = (1 << LIMB_BITS) - 1
    out = []
    while -(1 << LIMB_BITS) > x or x >= 1 << LIMB_BITS:
        out.append(x & mask)
        x >>= LIMB_BITS
    return [*out, x]


def entry_sums(state: DataFrame, width: int, entries: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): number of vectors and the sum of each component."""
    part = width // PARTS
    fields = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, entries, part + 1), object)  # the last position counts
        for batch in slices(batches):
            vectors = unpacked_vectors(batch.column("vector").to_pylist(), width)
            chosen = np.frombuffer(b"".join(batch.column("entries").to_pylist()), "u1").reshape(-1, PARTS)
            # 32-bit halves, so that sums over a batch fit 64 bits
            low, high = (vectors & 0xFFFFFFFF, vectors >> 32)
            for p in range(PARTS):
                here = np.zeros((2, entries, part), vectors.dtype)
                for half, values in enumerate((low, high)):
                    np.add.at(here[half], chosen[:, p], values[:, p * part : (p + 1) * part])
                total[p, :, :part] += here[0].astype(object) + (here[1].astype(object) << 32)
                total[p, :, part] += np.bincount(chosen[:, p], minlength=entries).astype(object)
        rows = [(p, k, d, j, v) for (p, k, d), x in np.ndenumerate(total) if x for j, v in enumerate(limbs(int(x)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, fields)], schema=fields)

    found = state.select("vector", "entries").mapInArrow(add, "part int, entry int, position int, limb int, value long")
    out = {(p, k): (0, [0] * part) for p in range(PARTS) for k in range(entries)}
    # at most PARTS * ENTRIES * (components of a part + 1) * LIMBS rows
    for r in found.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():
        count, sums = out[r["part"], r["entry"]]
        value = r["value"] << (LIMB_BITS * r["limb"])
        if r["position"] == part:
            count += value
        else:
            sums[r["position"]] += value
        out[r["part"], r["entry"]] = count, sums
    return out


def moved_books(books: Codebooks, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
    """Entries at the floor of their parts' means; unused ones stay."""
    new = [[[s // sums[p, k][0] for s in sums[p, k][1]] if sums[p, k][0] else old for k, old in enumerate(part)] for p, part in enumerate(books.entries)]

    def distance(a: list[int], b: list[int]) -> int:
        square = sum((x - y) ** 2 for x, y in zip(a, b))
        return math.isqrt(square) + (math.isqrt(square) ** 2 < square)

    return Codebooks(new, [[distance(a, b) for a, b in zip(x, y)] for x, y in zip(books.entries, new)])


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, embedding of rows whose vector is whole."""
    x = named(vector_col).cast("array<double>")
    whole = (F.size(x) > 0) & (F.size(x) % PARTS == 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(named(id_col).cast("long").alias("vec_id"), named(label_col).alias("label"), x.alias("embedding"))


def code(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, labels: int = LABELS, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "codes")
    label_type = vectors.select(named(label_col)).schema[0].dataType.simpleString()
    result = f"vec_id long, label {label_type}, code string, error long"
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = kept.orderBy(*order).limit(1).collect()
    width = len(first[0]["embedding"]) if first else 0
    if not width:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.filter(F.size("embedding") == width)
    part = width // PARTS
    starts = [[math.floor(Fraction(x) * SCALE) for x in r["embedding"]] for r in kept.orderBy(*order).limit(ENTRIES).collect()]
    books = Codebooks([[v[p * part : (p + 1) * part] for v in starts] for p in range(PARTS)], [[0] * len(starts)] * PARTS)
    entries = len(starts)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            whole = floored(batch.column("embedding"), width)
            n = len(whole)
            same = lambda data: pa.array([data] * n, pa.binary())
            unknown = (np.full(PARTS, MOST, "<u2").tobytes(), bytes(2 * PARTS * entries))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([packed_vector(r) for r in whole], pa.binary()), same(bytes(PARTS)), *map(same, unknown)], names=["vec_id", "label", "vector", "entries", "upper", "lower"])

    schema = STATE.format(label=label_type)
    state = kept.mapInArrow(begin, schema)

    def advanced(table: DataFrame, now: Codebooks) -> DataFrame:
        shared = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield next_state(batch, shared.value, width, batch.schema.field("label").type)

        return table.mapInArrow(run, schema)

    for k in range(rounds):
        state = scratch.save(advanced(state, books), f"round{k}")
        if k:
            scratch.drop(f"round{k - 1}")
        books = moved_books(books, entry_sums(state, width, entries))
    last = spark.sparkContext.broadcast(books)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.array(last.value.entries[p], object) for p in range(PARTS)]
        wide = any(abs(c) > safe_size(width) for a in found for c in a.ravel())
        for batch in slices(batches):
            vectors = unpacked_vectors(batch.column("vector").to_pylist(), width)
            chosen = np.frombuffer(b"".join(batch.column("entries").to_pylist()), "u1").reshape(-1, PARTS)
            kind = object if wide or vectors.dtype == object else np.int64
            error = sum(((vectors[:, p * part : (p + 1) * part].astype(kind) - found[p].astype(kind)[chosen[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))
            fits = [int(e) if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in chosen]), pa.array(fits, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = scratch.save(advanced(state, books).mapInArrow(finish, result), "coded")
    scratch.drop_others("coded")
    totals = coded.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_sum(error)")).alias("label_error"))
    totals = scratch.save(totals.withColumnRenamed("label", "of_label"), "totals")
    few = F.broadcast(totals) if totals.limit(labels + 1).count() <= labels else totals
    out = coded.join(few, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
