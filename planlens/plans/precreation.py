"""Tasks that a run creates before it starts: reachability with barriers, over all plans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.workspace import Scratch

#: Kinds of steps that lead on by their first dependency only, since the rest isn't known before a decision or a collection.
BARRIERS = ("when", "map_module")


def precreated(nodes: DataFrame, edges: DataFrame, outputs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """plan_id, i, scope of the ``module`` steps of ``nodes`` (plan_id, i, kind) that a run creates at once.

    From a plan's ``outputs`` (plan_id, i) along ``edges`` (plan_id, i, position, dep),
    dep 0 being the input. A step of kind ``parallel`` adds ``parallel:<position>`` to the
    scope of what it leads to. A step that is reached by several ways has the scope of the
    way that a walk in the order of positions takes first: in a plan without cycles the
    least one by positions. Each round extends only the ways that the last one shortened or found.
    """
    scratch = scratch or Scratch(edges.sparkSession, "precreation")
    on = ["plan_id", "i"]
    part = F.when(F.col("kind") == "parallel", F.array(F.concat(F.lit("parallel:"), F.col("position").cast("string")))).otherwise(F.array().cast("array<string>"))
    leads = edges.filter("dep <> 0").join(nodes.select(*on, "kind"), on)
    leads = scratch.save(leads.filter(~F.col("kind").isin(*BARRIERS) | (F.col("position") == 0)).select(*on, F.col("position").cast("int").alias("position"), "dep", part.alias("part")), "leads")
    start = outputs.select(*on).distinct().select(*on, F.array().cast("array<int>").alias("way"), F.array().cast("array<string>").alias("scope"))
    known = new = scratch.save(start, "known0")
    k = 0
    while not new.isEmpty():
        k += 1
        further = leads.join(new, on).select("plan_id", F.col("dep").alias("i"), F.concat("way", F.array("position")).alias("way"), F.concat("scope", "part").alias("scope"))
        best = further.groupBy(*on).agg(F.min(F.struct("way", "scope")).alias("b")).select(*on, "b.way", "b.scope")
        old = known.select(*on, F.col("way").alias("old"))
        new = scratch.save(best.join(old, on, "left").filter(F.col("old").isNull() | (F.col("way") < F.col("old"))).drop("old"), f"new{k}")
        known = scratch.save(known.join(new, on, "left_anti").unionByName(new), f"known{k}")
        scratch.drop(f"known{k - 1}")
        scratch.drop(f"new{k - 1}")
    return known.join(nodes.filter("kind = 'module'").select(*on), on, "left_semi").select(*on, F.array_join("scope", "/").alias("scope"))
