"""Comparing two versions of plans: identity joins, ordered changes, first divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

#: Kinds of change in order; those below the line end a comparison.
ORDER = {"DELETION": 0, "INSERTION": 1, "MODULE_DIGEST_CHANGED": 4, "BUDGET_CHANGED": 5}
UNRESOLVABLE = ("DELETION", "INSERTION")


#: Kinds that end an alignment, and those of a step that don't, in order, with the column that each compares.
ENDING = ("DELETION", "INSERTION", "REORDER", "CONTROL_FLOW_CHANGED", "TOPOLOGY_CHANGED")
COMPATIBLE = {
    "MODULE_DIGEST_CHANGED": "module_digest", "BUDGET_CHANGED": "budget", "CAPABILITY_CHANGED": "capabilities", "EFFECT_CHANGED": "effects",
    "CONNECTOR_CHANGED": "connectors", "POLICY_CHANGED": "policies", "SCHEMA_CHANGED": "schemas",
}
STEP_COLUMNS = ("control", "dependencies", *COMPATIBLE.values())


def align(before: DataFrame, after: DataFrame, controls_before: DataFrame, controls_after: DataFrame) -> DataFrame:
    """plan_id, phase, place, rank, kind, key of every change up to the first that ends a plan's alignment.

    Steps are (plan_id, key, place, and STEP_COLUMNS); controls are (plan_id,
    controls), a signature of the plan's control steps. Steps meet by key. Checked
    in this order: a step gone, a new step, another order, other controls, then step
    by step its control, its dependencies and what replay can cope with. A change
    of the first six kinds is the last one of its plan. Only changes are
    aggregated by plan, not steps.
    """
    controls = controls_before.withColumnRenamed("controls", "old").join(controls_after.withColumnRenamed("controls", "new"), "plan_id")
    return aligned(in_versions(before, after), controls)


def aligned(steps: DataFrame, controls: DataFrame) -> DataFrame:
    """The same of steps of both versions (``after`` false and true) and controls (plan_id, old, new). Only plan_id deals the steps, where it already does."""
    kind_of_key = steps.schema["key"].dataType
    of = lambda c, after: F.max(F.when(F.col("after") == after, F.col(c)))
    texts = F.struct(*STEP_COLUMNS)
    steps = met(steps.select("plan_id", "key", "place", texts.alias("step"), "after"), "plan_id", "key").agg(*(of(c, a).alias(f"{c}_{n}") for a, n in ((False, "old"), (True, "new")) for c in ("place", "step"))).drop("alone")
    steps = steps.select("plan_id", "key", "place_old", "place_new", *(F.col(f"step_{n}")[c].alias(f"{c}_{n}") for n in ("old", "new") for c in STEP_COLUMNS))
    both = F.col("place_old").isNotNull() & F.col("place_new").isNotNull()
    differs = lambda c: both & ~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new"))

    def change(test: Column, phase: int, place: str, rank: int, kind: str) -> Column:
        return F.when(test, F.struct(F.lit(phase).alias("phase"), F.col(place).alias("place"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))

    found = F.array_compact(F.array(
        change(F.col("place_new").isNull(), 0, "place_old", 0, "DELETION"),
        change(F.col("place_old").isNull(), 1, "place_new", 0, "INSERTION"),
        change(differs("place"), 2, "place_old", 0, "REORDER"),
        change(differs("control"), 4, "place_old", 0, "CONTROL_FLOW_CHANGED"),
        change(differs("dependencies"), 4, "place_old", 1, "TOPOLOGY_CHANGED"),
        *(change(differs(c), 4, "place_old", k + 2, kind) for k, (kind, c) in enumerate(COMPATIBLE.items())),
    ))
    steps = steps.select("plan_id", "key", F.explode(found).alias("c")).select("plan_id", "c.*", "key")
    whole = controls.filter("not (old <=> new)").select("plan_id", F.lit(3).alias("phase"), F.lit(0).alias("place"), F.lit(0).alias("rank"), F.lit("CONTROL_FLOW_CHANGED").alias("kind"), F.lit(None).cast(kind_of_key).alias("key"))
    at = F.struct("phase", "place", "rank")
    last = F.min(F.when(F.col("kind").isin(*ENDING), at)).over(Window.partitionBy("plan_id"))
    return steps.unionByName(whole).withColumn("last", last).filter(F.col("last").isNull() | (at <= F.col("last"))).drop("last")


def in_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of two versions as one table, with ``after`` false and true."""
    return before.withColumn("after", F.lit(False)).unionByName(after.withColumn("after", F.lit(True)))


def met(rows: DataFrame, *keys: str) -> GroupedData:
    """Rows of two versions (``after``) in groups of equal keys; those with a null key meet none of the other version."""
    alone = F.when(F.greatest(*(F.col(k).isNull() for k in keys)), F.col("after"))
    return rows.groupBy(*keys, alone.alias("alone"))


def matched_nodes(rows: DataFrame) -> DataFrame:
    """plan_id, i of either version, ``old`` and ``new`` (true or null), and what each version says of the node, which is once in it."""
    names = ("module_digest", "tool_calls")
    of = lambda c, after: F.max(F.when(F.col("after") == after, c))
    sides = ((False, "old"), (True, "new"))
    return met(rows, "plan_id", "i").agg(*(of(F.lit(True), a).alias(n) for a, n in sides), *(of(F.col(c), a).alias(f"{c}_{n}") for a, n in sides for c in names)).drop("alone")


def changes(rows: DataFrame) -> DataFrame:
    """plan_id, i, rank, kind of every change between two versions (``after``)."""
    kind = lambda name, test: F.when(test, F.struct(F.lit(ORDER[name]).alias("rank"), F.lit(name).alias("kind")))
    both = F.col("old") & F.col("new")
    found = F.array_compact(F.array(
        kind("DELETION", F.col("new").isNull()),
        kind("INSERTION", F.col("old").isNull()),
        kind("MODULE_DIGEST_CHANGED", both & ~F.col("module_digest_old").eqNullSafe(F.col("module_digest_new"))),
        kind("BUDGET_CHANGED", both & ~F.col("tool_calls_old").eqNullSafe(F.col("tool_calls_new"))),
    ))
    return matched_nodes(rows).select("plan_id", "i", F.explode(found).alias("c")).select("plan_id", "i", "c.rank", "c.kind")


def divergence(found: DataFrame) -> DataFrame:
    """plan_id, kind, i of the first change that ends a comparison, and how many changes there are."""
    first = F.min(F.when(F.col("kind").isin(*UNRESOLVABLE), F.struct("rank", "i", "kind")))
    return found.groupBy("plan_id").agg(first.alias("first"), F.count("*").alias("changes")).select("plan_id", F.col("first.kind").alias("kind"), F.col("first.i").alias("i"), "changes")


def uses(rows: DataFrame) -> DataFrame:
    """plan_id, module_id with its uses in either of two versions (``after``)."""
    return met(rows, "plan_id", "module_id").agg(F.count_if(~F.col("after")).alias("old_uses"), F.count_if(F.col("after")).alias("new_uses")).drop("alone")


def composition_changes(rows: DataFrame) -> DataFrame:
    """plan_id, module_id with its uses in either of two versions (``after``) where these differ."""
    return uses(rows).filter("old_uses <> new_uses")


def unequal_multisets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def metric_diff(before: DataFrame, after: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """plan_id, metric, old, new where a metric differs."""
    pairs = ", ".join(f"'{n}', cast(b.{n} as double), cast(a.{n} as double)" for n in names)
    both = before.alias("b").join(after.alias("a"), F.col("b.plan_id") == F.col("a.plan_id"))
    return both.selectExpr("b.plan_id", f"stack({len(names)}, {pairs}) as (metric, old, new)").filter("not (old <=> new)")
