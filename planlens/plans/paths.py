"""Paths through plan graphs over all plans: critical paths, dependencies behind control steps, executed branches.

Rows are dealt by plan and node, so no plan is gathered in one task. Critical
paths double; the others take as many rounds as the longest path has nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from planlens.plans.doubling import ancestry
from planlens.workspace import Scratch, partitions_for


def spread(start: DataFrame, onward: Callable[[DataFrame], DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """``start`` and all that ``onward`` leads to from there, each row once; ends with the first round without a new row, on cycles too."""
    schema = StructType([*start.schema.fields, StructField("round", IntegerType())])
    every = lambda: start.sparkSession.read.schema(schema).parquet(scratch.path(name)).drop("round")
    new, k = scratch.save(start.distinct(), f"{name}/round=0"), 0
    while not new.isEmpty():
        k += 1
        new = scratch.save(onward(new).distinct().join(every(), start.columns, "left_anti"), f"{name}/round={k}")
    return every()


def critical_paths(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """plan_id, i, path_ms: the longest time up to the end of each node.

    Unknown (null) if the node or any before it states no wall time; a node on or
    behind a cycle or a missing node has no row.
    """
    listed = nodes.select("plan_id", "i", "wall_time_ms").join(edges.select("plan_id", "i").distinct(), ["plan_id", "i"], "left_semi")
    found = ancestry(listed, edges.filter("dep <> 0"), scratch)
    return found.filter("depth is not null").select("plan_id", "i", F.col("path_ms").cast("long").alias("path_ms"))


def wall_budget(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, wall_time_ms: the longest path to an output (a node without users); unknown if one of these is."""
    used = edges.select("plan_id", F.col("dep").alias("i")).distinct()
    ends = nodes.select("plan_id", "i").join(used, ["plan_id", "i"], "left_anti").join(critical_paths(nodes, edges), ["plan_id", "i"], "left")
    return ends.groupBy("plan_id").agg(F.when(F.count("*") == F.count("path_ms"), F.max("path_ms")).alias("wall_time_ms"))


def dependency_keys(edges: DataFrame, executable: DataFrame) -> DataFrame:
    """plan_id, i, dependency: the nearest executable nodes (plan_id, i) before each executable node, through control nodes."""
    scratch = Scratch(edges.sparkSession, "keys")
    runs = executable.select("plan_id", F.col("i").alias("dep"), F.lit(True).alias("runs"))
    own = executable.select("plan_id", "i", F.lit(True).alias("own"))
    marked = edges.filter("dep <> 0").select("plan_id", "i", "dep").join(runs.hint("merge"), ["plan_id", "dep"], "left").join(own.hint("merge"), ["plan_id", "i"], "left")  # nodes grow with the input: a small file of them is no small table
    deps = scratch.save(marked.select("plan_id", "i", "dep", F.coalesce("runs", F.lit(False)).alias("runs"), F.coalesce("own", F.lit(False)).alias("own")), "deps")
    back = deps.filter("not own").select("plan_id", F.col("i").alias("via"), F.col("dep").alias("next"), F.col("runs").alias("ends"))

    def onward(new: DataFrame) -> DataFrame:
        control = new.filter("not runs").select("plan_id", "i", F.col("dep").alias("via"))
        return control.join(back, ["plan_id", "via"]).select("plan_id", "i", F.col("next").alias("dep"), F.col("ends").alias("runs"))

    started = deps.filter("own").drop("own")
    found = onward(spread(started.filter("not runs"), lambda new: onward(new).filter("not runs"), scratch, "reached")).filter("runs")
    every = started.filter("runs").unionByName(found).select("plan_id", "i", F.col("dep").alias("dependency"))
    return every.repartition(partitions_for(scratch.spark, deps.count()), "plan_id", "i").distinct()


def executed_path(edges: DataFrame, decisions: DataFrame, outputs: DataFrame) -> DataFrame:
    """plan_id, i of the nodes that led to ``outputs`` (plan_id, i) once branches are decided.

    A branch's dependency at position 0 is its condition; ``decisions`` (plan_id, i,
    selected) name the position taken. A branch without a decision keeps them all.
    """
    scratch = Scratch(edges.sparkSession, "executed")
    live = edges.join(decisions.select("plan_id", "i", "selected"), ["plan_id", "i"], "left")
    live = live.filter("dep <> 0 and (selected is null or position in (0, selected))")
    back = scratch.save(live.select("plan_id", F.col("i").alias("via"), "dep"), "live")
    onward = lambda new: new.withColumnRenamed("i", "via").join(back, ["plan_id", "via"]).select("plan_id", F.col("dep").alias("i"))
    return spread(outputs.select("plan_id", "i"), onward, scratch, "kept")
