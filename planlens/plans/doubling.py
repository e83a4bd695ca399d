"""Longest paths and reachability in plan graphs by doubling, over all plans at once.

``jump`` k holds the pairs of nodes between which some path has exactly 2 ** k
edges; two of its rows that meet make one of the next. What is known of paths
with fewer than 2 ** k edges and one jump give what is known of paths with fewer
than 2 ** (k + 1), so a chain of n nodes takes about log2(n) rounds. Rows are
dealt by plan and node: no plan is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.plans.gathered import is_whole, node_rows, sizes_above, solved
from planlens.workspace import Scratch


def ancestry(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None, outputs: DataFrame | None = None) -> DataFrame:
    """plan_id, i, depth, path_ms, cyclic, lost, used of every node (plan_id, i, wall_time_ms).

    ``edges`` (plan_id, i, dep) name dependencies within a plan; the plan's input
    is no node and must not be among them. depth and path_ms (the most time up to a
    node's end; null if one of the nodes before it, or it, states none) are null
    where the node is on or behind a cycle (``cyclic``) or behind a missing node
    (``lost``). ``used``: an output leads back to it; outputs (plan_id, i) are the
    nodes without users if not given. Plans of few nodes, all of them in an order,
    are solved in a row each; the others double.
    """
    scratch = scratch or Scratch(edges.sparkSession, "doubling")
    on = ["plan_id", "i"]
    own = scratch.save(nodes.select(*on, F.col("wall_time_ms").cast("double").alias("own")), "own")
    links = scratch.save(edges.select(*on, "dep"), "edges")
    if outputs is not None:
        return _doubled(own, links, scratch, outputs)
    large = scratch.save(sizes_above(own), "large")
    few = (own, links) if large.isEmpty() else tuple(f.join(large, "plan_id", "left_anti") for f in (own, links))
    found = scratch.save(solved(*few).filter(F.size("keys") > 0).select("plan_id", is_whole().alias("whole"), F.when(is_whole(), node_rows()).alias("rows")), "few")
    rest = scratch.save(found.filter(~F.col("whole")).select("plan_id").unionByName(large), "rest")
    made = found.filter("whole").select("plan_id", F.inline("rows"))
    made = made.select(*on, (F.col("edges") + 1).alias("depth"), F.when(~F.col("unknown"), F.col("ms")).alias("path_ms"), F.lit(False).alias("cyclic"), F.lit(False).alias("lost"), F.lit(True).alias("used"))
    if rest.isEmpty():
        return made
    return made.unionByName(_doubled(*(f.join(rest, "plan_id", "left_semi") for f in (own, links)), scratch, None))


def _doubled(own: DataFrame, edges: DataFrame, scratch: Scratch, outputs: DataFrame | None) -> DataFrame:
    on = ["plan_id", "i"]
    links = scratch.save(edges.distinct(), "links")
    known = links.join(own.withColumnRenamed("i", "dep").withColumnRenamed("own", "before"), ["plan_id", "dep"], "left_semi")
    lacking = links.join(own.withColumnRenamed("i", "dep"), ["plan_id", "dep"], "left_anti").select(*on).distinct().withColumn("lost", F.lit(True))
    jump = known.join(own, on).select("plan_id", "dep", "i", F.coalesce("own", F.lit(0)).cast("double").alias("ms"))
    ends = outputs.select(*on).distinct() if outputs is not None else own.select(*on).join(jump.select("plan_id", F.col("dep").alias("i")), on, "left_anti")
    state = own.join(lacking, on, "left").join(ends.withColumn("used", F.lit(True)), on, "left")
    state = state.select(*on, F.lit(0).alias("edges"), F.coalesce("own", F.lit(0)).cast("double").alias("ms"), F.col("own").isNull().alias("unknown"), F.coalesce("lost", F.lit(False)).alias("lost"), F.coalesce("used", F.lit(False)).alias("used"))
    most = own.groupBy("plan_id").count().agg(F.max("count")).first()[0] or 0
    k = 0
    while (1 << k) <= most and not (k and jump.isEmpty()):
        told = jump.join(state.withColumnRenamed("i", "dep").withColumnRenamed("ms", "until"), ["plan_id", "dep"])
        forward = told.select(*on, (F.col("edges") + (1 << k)).alias("edges"), (F.col("until") + F.col("ms")).alias("ms"), "unknown", "lost", F.lit(False).alias("used"))
        back = jump.join(state.filter("used").select(*on), on, "left_semi").select("plan_id", F.col("dep").alias("i"), F.lit(0).alias("edges"), F.lit(0.0).alias("ms"), F.lit(False).alias("unknown"), F.lit(False).alias("lost"), F.lit(True).alias("used"))
        most_of = (F.max("edges").alias("edges"), F.max("ms").alias("ms"), *(F.bool_or(c).alias(c) for c in ("unknown", "lost", "used")))
        state = scratch.save(state.unionByName(forward).unionByName(back).groupBy(*on).agg(*most_of), f"state{k + 1}")
        left = jump.select("plan_id", F.col("dep").alias("from"), F.col("i").alias("dep"), F.col("ms").alias("first"))
        jump = scratch.save(jump.join(left, ["plan_id", "dep"]).groupBy("plan_id", "from", "i").agg(F.max(F.col("first") + F.col("ms")).alias("ms")).withColumnRenamed("from", "dep"), f"jump{k + 1}")
        scratch.drop(f"state{k}")
        scratch.drop(f"jump{k}")
        k += 1
    endless = jump.select(*on).distinct().withColumn("cyclic", F.lit(True))
    whole = state.join(endless, on, "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    good = ~F.col("cyclic") & ~F.col("lost")
    return whole.select(*on, F.when(good, F.col("edges") + 1).alias("depth"), F.when(good & ~F.col("unknown"), F.col("ms")).alias("path_ms"), "cyclic", "lost", "used")
