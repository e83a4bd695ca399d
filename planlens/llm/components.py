"""Connected components of a link table, by alternating star contractions.

Every round hooks neighbours to the smallest node they know (large star, then
small star); the edges become a star around each component's smallest node.
Each round's edges are a written table, so lineage stays short and a lost
executor repeats only its tasks. No component is gathered in one task: minima
are aggregated before the shuffle, and Spark splits a hub's join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.workspace import Scratch

MOST_ROUNDS = 60


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minima(down)
    hooked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return hooked.filter("u != v").distinct()


def components(links: DataFrame, a: str, b: str, scratch: Scratch, label: str) -> DataFrame:
    """node, root for every linked node: root is the smallest node it reaches."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct()
    before = None
    for k in range(MOST_ROUNDS):
        edges = scratch.save(_small_star(_large_star(edges)), f"{label}-star{k}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if k > 1:
            scratch.drop(f"{label}-star{k - 2}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
