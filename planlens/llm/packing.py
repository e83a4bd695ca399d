"""Best-fit packing of token documents, in residual rounds.

Every partition cuts its documents into pieces and packs them by best fit,
largest first. A sequence that is nearly full is emitted; the others become the
items of the next round, in which fewer partitions each best-fit what several
left over. Rounds end when one partition has packed the rest, or when a round
fills no more sequences. Pieces are written once; the rounds move only
(sequence, fill) rows.

A null text is an empty document (its end id alone). Repeated rows are packed
like others. An empty table gives an empty result. A document longer than a
sequence is cut so that its first piece may be shorter and all others are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm import bpe_chunks
from planlens.llm.frames import texts_of
from planlens.llm.worker_memory import slices
from planlens.workspace import Scratch, ship_package

#: A sequence with at most this many free places is emitted.
SLACK = 8
#: Underfull sequences that one task of a round packs at most, on average.
ROUND_SIZE = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, largest first into the bin it fills best; and the fill of each bin.

    Free bins are kept by room; the set of rooms in use is an integer's bits, so
    the tightest fit is its lowest bit at or above the item's size.
    """
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            rooms[left].append(b)
            used |= 1 << left
    return bins, offsets, fills


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark, "packing")
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("at", pa.int64()), ("fill", pa.int64())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = bpe_chunks.byte_level_encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        docs_, pieces, starts, lengths, crcs = [], [], [], [], []
        for batch in slices(batches, keep=f"byte-level {tokenizer_path}"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids = np.concatenate([ids.astype("<u4"), end])
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    docs_.append(doc)
                    pieces.append(n)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(ids[start : start + length].tobytes()))
        bins, offsets, fills = best_fit(np.array(lengths, np.int64), capacity)
        full = np.array(fills, np.int64)[bins] if len(bins) else np.zeros(0, np.int64)
        names = (task << 32) + bins  # unique: a task has fewer sequences than 2 ** 32
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs_, pieces, starts, lengths, crcs, names, offsets, full), fields)], schema=fields)

    placed = scratch.save(texts_of(docs, id_col, text_col).mapInArrow(local, PIECES), "pieces")
    bins = placed.groupBy("bin").agg(F.max("fill").alias("fill"))
    open_ = bins.filter(F.col("fill") < capacity - SLACK).select("bin", "fill")
    moves = merge_rounds(open_, capacity, scratch)
    placed = placed.join(moves, "bin", "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("home", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def merge_rounds(open_: DataFrame, capacity: int, scratch: Scratch, group_size: int = ROUND_SIZE) -> DataFrame:
    """bin, home, shift of every underfull sequence: where the rounds put it."""
    moves = scratch.save(open_.select("bin", F.col("bin").alias("home"), F.lit(0).cast("long").alias("shift"), "fill"), "round0")
    live = moves.select(F.col("bin").alias("item"), "fill")
    count, number = live.count(), 0
    while count > 1:
        number += 1
        tasks = max(1, -(-count // group_size))
        packed = scratch.save(pack_round(live, tasks, capacity, number), f"packed{number}")
        moves = scratch.save(
            moves.join(packed.withColumnRenamed("item", "home"), "home", "left").select(
                "bin",
                F.coalesce("into", "home").alias("home"),
                (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"),
                F.coalesce("total", "fill").alias("fill"),
            ),
            f"round{number}",
        )
        live = packed.filter(F.col("total") < capacity - SLACK).select(F.col("into").alias("item"), F.col("total").alias("fill")).distinct()
        before, count = count, live.count()
        if tasks == 1 or count > 0.98 * before:
            break
    return moves.select("bin", "home", "shift")


def pack_round(items: DataFrame, tasks: int, capacity: int, number: int) -> DataFrame:
    """item, into, by, total: each of ``tasks`` tasks best-fits the items it is dealt."""
    fields = pa.schema([("item", pa.int64()), ("into", pa.int64()), ("by", pa.int64()), ("total", pa.int64())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=pa.schema([("item", pa.int64()), ("fill", pa.int64())]))
        names, sizes = table.column("item").to_numpy(), table.column("fill").to_numpy()
        order = np.argsort(names, kind="stable")
        names, sizes = names[order], sizes[order]
        bins, offsets, fills = best_fit(sizes, capacity)
        first = np.zeros(len(fills), np.int64)
        first[bins[::-1]] = names[::-1]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(first[bins]), pa.array(offsets), pa.array(np.array(fills, np.int64)[bins])], schema=fields)

    dealt = items.select("item", "fill").repartition(tasks, F.xxhash64("item", F.lit(number)))
    return dealt.mapInArrow(fit, "item long, into long, by long, total long")
