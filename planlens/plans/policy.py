"""Policy gate: numeric and set rules over plan metrics, first refusal wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlens.operators.audits import rule_code


def unpivoted(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """plan_id, metric, value."""
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return metrics.selectExpr("plan_id", f"stack({len(names)}, {pairs}) as (metric, value)")


def numeric_violations(metrics: DataFrame, rules: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """plan_id, rank, code of every rule (rank, metric, upper, lower) that a plan breaks, by the codes of ``METRICS``."""
    joined = unpivoted(metrics, names).join(rules, "metric")
    code = rule_code(F.col("metric"), F.col("value"), F.col("upper"), F.col("lower"))
    return joined.select("plan_id", "rank", code.alias("code")).filter("code is not null")


def set_violations(nodes: DataFrame, allowed: tuple[str, ...], none_of: tuple[str, ...]) -> DataFrame:
    """plan_id, rank, code where modules are forbidden, or effects are of forbidden modules."""
    sets = nodes.groupBy("plan_id").agg(F.collect_set("module_id").alias("modules"), F.collect_set(F.when(F.col("effectful"), F.col("module_id"))).alias("effectful_modules"))
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    forbidden = F.size(F.array_except("modules", strings(allowed))) > 0
    effects = F.size(F.array_intersect("effectful_modules", strings(none_of))) > 0
    codes = F.array_compact(F.array(F.when(forbidden, F.struct(F.lit(10).alias("rank"), F.lit("PLAN_MODULE_FORBIDDEN").alias("code"))), F.when(effects, F.struct(F.lit(11).alias("rank"), F.lit("PLAN_EFFECTFUL_MODULE_FORBIDDEN").alias("code")))))
    return sets.select("plan_id", F.explode(codes).alias("v")).select("plan_id", "v.rank", "v.code")


def unseen_shapes(shapes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Plans whose topology digest the baseline doesn't have."""
    return shapes.join(baseline.select("topology_digest").distinct(), "topology_digest", "left_anti")


def first_refusal(violations: DataFrame) -> DataFrame:
    """plan_id and the code of lowest rank."""
    return violations.groupBy("plan_id").agg(F.min(F.struct("rank", "code"))["code"].alias("refusal"), F.count("*").alias("issues"))


def baseline(shapes: DataFrame) -> DataFrame:
    """The most common shape, the smallest digest among equals, and its count."""
    counted = shapes.groupBy("topology_digest").agg(F.count("*").alias("plans"))
    return counted.orderBy(F.desc("plans"), "topology_digest").limit(1)


def ranked(violations: DataFrame) -> DataFrame:
    """Violations of a plan in order."""
    return violations.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy("rank", "code")))
