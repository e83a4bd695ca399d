"""Plans of few nodes solved in one row each, by column expressions: order of a depth-first walk, depths, longest times.

The work of a row grows with the square of its nodes, so only plans of at most
``SMALL`` nodes go this way; for longer ones callers double over rows of nodes and
edges (``doubling``). Both give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.functions.canonical import let

#: Most nodes of a plan that is solved in its row; speed only.
SMALL = 32
_PLACES = "array<int>"


def sizes_above(rows: DataFrame, limit: int = SMALL) -> DataFrame:
    """plan_id of the plans with more rows than that."""
    return rows.groupBy("plan_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("plan_id")


def inside(keys: Column, dependencies: Column, outer: str | int | None = None) -> Column:
    """Of each node the places (from 1) of its dependencies among ``keys``, each once; 0 for one that isn't there. ``outer`` is no node."""
    place = lambda d: F.array_position(keys, d).cast("int")
    kept = (lambda ds: ds) if outer is None else (lambda ds: F.filter(ds, lambda d: d != outer))
    return F.transform(dependencies, lambda ds: F.array_distinct(F.transform(kept(ds), place)))


def walk(before: Column) -> Column:
    """The places of the nodes in the order of a depth-first walk, of those freed together the lower one first.

    ``before`` is ``inside`` of nodes in the order of their keys. Nodes on or behind
    a cycle or a missing node aren't in it.
    """
    none = F.array().cast(_PLACES)
    every = F.when(F.size(before) > 0, F.sequence(F.lit(1), F.size(before))).otherwise(none)
    waiting = F.transform(before, lambda ds: F.size(ds))
    start = F.struct(none.alias("done"), F.filter(every, lambda u: F.size(F.get(before, u - 1)) == 0).alias("ready"), waiting.alias("waiting"))

    def step(s: Column, _: Column) -> Column:
        k = F.get(s["ready"], F.lit(0))
        left = F.transform(s["waiting"], lambda w, j: F.when(F.array_contains(F.get(before, j), k), w - 1).otherwise(w))
        taken = let(left, lambda w: F.struct(
            F.array_append(s["done"], k).alias("done"),
            F.concat(F.filter(every, lambda u: (F.get(w, u - 1) == 0) & (F.get(s["waiting"], u - 1) > 0)), F.slice(s["ready"], F.lit(2), F.size(before))).alias("ready"), w.alias("waiting")))
        return F.when(F.size(s["ready"]) == 0, s).otherwise(taken)

    return F.aggregate(every, start, step, lambda s: s["done"])


def longest(order: Column, before: Column, own: Column) -> Column:
    """edges, ms, unknown for each place of ``order``: the longest way to a node, the most time up to its end, and whether a node on a way states none (null in ``own``)."""
    one = "struct<edges:int,ms:double,unknown:boolean>"

    def step(made: Column, k: Column) -> Column:
        found = F.transform(F.get(before, k - 1), lambda d: F.get(made, F.array_position(order, d).cast("int") - 1))
        mine = F.get(own, k - 1)
        return let(found, lambda f: F.array_append(made, F.struct(
            F.coalesce(F.array_max(F.transform(f, lambda x: x["edges"])) + 1, F.lit(0)).alias("edges"),
            (F.coalesce(mine, F.lit(0.0)) + F.greatest(F.coalesce(F.array_max(F.transform(f, lambda x: x["ms"])), F.lit(0.0)), F.lit(0.0))).alias("ms"),
            (mine.isNull() | F.exists(f, lambda x: x["unknown"])).alias("unknown")).cast(one)))

    return F.aggregate(order, F.array().cast(f"array<{one}>"), step)


def solved(nodes: DataFrame | None, edges: DataFrame, outer: int | None = None) -> DataFrame:
    """plan_id, n, keys, order, found (in the order) of plans with ``nodes`` (plan_id, i, own) and ``edges`` (plan_id, i, dep).

    Without ``nodes`` they are the ones that have edges, and state no time.
    """
    edge = F.struct("i", "dep").alias("edge")
    if nodes is None:
        plans = edges.groupBy("plan_id").agg(F.collect_list(edge).alias("edges"))
        plans = plans.withColumn("nodes", F.transform(F.array_sort(F.array_distinct(F.transform("edges", lambda e: e["i"]))), lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("own"))))
    else:
        rows = nodes.select("plan_id", F.struct("i", "own").alias("node"), F.lit(None).alias("edge"))
        both = rows.unionByName(edges.select("plan_id", F.lit(None).alias("node"), edge))
        plans = both.groupBy("plan_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.collect_list("edge").alias("edges"))
    deps = F.transform("nodes", lambda n: F.transform(F.filter("edges", lambda e: e["i"] == n["i"]), lambda e: e["dep"]))
    keyed = plans.select("plan_id", F.transform("nodes", lambda n: n["i"]).alias("keys"), F.transform("nodes", lambda n: n["own"]).alias("own"), deps.alias("deps"))
    return _solved(keyed, outer)


def _solved(plans: DataFrame, outer: str | int | None) -> DataFrame:
    placed = plans.select("plan_id", "keys", "own", inside(F.col("keys"), F.col("deps"), outer).alias("before"))
    ordered = placed.withColumn("order", walk(F.col("before")))
    return ordered.select("plan_id", F.size("keys").alias("n"), "keys", "before", "order", longest(F.col("order"), F.col("before"), F.col("own")).alias("found"))


def solved_keys(nodes: DataFrame, outer: str) -> DataFrame:
    """The same of nodes (plan_id, key, dependencies, own)."""
    plans = nodes.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("key", "dependencies", "own"))).alias("nodes"))
    return _solved(plans.select("plan_id", F.transform("nodes", lambda n: n["key"]).alias("keys"), F.transform("nodes", lambda n: n["own"]).alias("own"), F.transform("nodes", lambda n: n["dependencies"]).alias("deps")), outer)


def is_whole() -> Column:
    """Of a solved plan: every node is in the order, and no two have one key."""
    return (F.col("n") > 0) & (F.size("order") == F.col("n")) & (F.size(F.array_distinct("keys")) == F.col("n"))


def node_rows() -> Column:
    """i, edges, ms, unknown of a solved plan's nodes, for ``inline``."""
    return F.zip_with("order", "found", lambda k, f: F.struct(F.get("keys", k - 1).alias("i"), f["edges"].alias("edges"), f["ms"].alias("ms"), f["unknown"].alias("unknown")))
