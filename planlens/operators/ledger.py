"""Runs, tasks, attempts, effects and budgets: scans, joins, state checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Budget dimensions in the order in which an overrun is reported.
DIMENSIONS = ("wall_time_ms", "model_tokens", "tool_calls", "cost_usd")
#: Fixed value: an overrun's name where it isn't that of the column.
DIMENSION_NAMES = {"wall_time_ms": "wall_time"}
#: States a run may go to.
RUN_TRANSITIONS = {"RUNNING": ("PAUSED", "SUCCEEDED", "FAILED", "CANCELLED"), "PAUSED": ("RUNNING", "CANCELLED")}


def run_history(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every run with its tasks counted by kind; runs without tasks too."""
    tasks = nodes.groupBy("plan_id").agg(F.count("*").alias("tasks"), F.count_if("effectful").alias("effects"), F.max("i").alias("last_task"))
    return runs.join(tasks, runs["run_id"] == tasks["plan_id"], "left").select("run_id", "tenant_id", "status", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("effects", F.lit(0)).alias("effects"), "last_task")


def active_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest running or paused runs."""
    return runs.filter(F.col("status").isin("RUNNING", "PAUSED")).orderBy("created_at", "run_id").limit(limit).select("run_id", "tenant_id", "status")


def of_tenant(runs: DataFrame, tenant_id: int) -> DataFrame:
    """The tenant guard: nothing of other tenants."""
    return runs.filter(F.col("tenant_id") == tenant_id)


def numbered_attempts(attempts: DataFrame) -> DataFrame:
    """attempt_number of every attempt of a task, from 1."""
    return attempts.withColumn("attempt_number", F.row_number().over(Window.partitionBy("task_id").orderBy("turn")))


def next_attempt(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("task_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_attempt"))


def accepted_attempts(attempts: DataFrame) -> DataFrame:
    """Each task's first attempt that succeeded, and how many it took."""
    numbered = numbered_attempts(attempts)
    return numbered.filter("status = 'SUCCEEDED'").groupBy("task_id").agg(F.min("attempt_number").alias("accepted"), F.max("attempt_number").alias("last"))


def unfinished(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks of runs that haven't succeeded, by run; zero for finished ones."""
    joined = nodes.join(runs, nodes["plan_id"] == runs["run_id"])
    return joined.groupBy("run_id").agg(F.count_if(F.col("status") != "SUCCEEDED").alias("unfinished"))


def startable(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks of running runs (semi join)."""
    running = runs.filter("status = 'RUNNING'")
    return nodes.join(running, nodes["plan_id"] == running["run_id"], "left_semi")


def frontier(edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes that aren't done and whose dependencies all are; ``done`` has plan_id, i."""
    finished = done.select("plan_id", F.col("i").alias("dep"), F.lit(True).alias("ok"))
    checked = edges.join(finished, ["plan_id", "dep"], "left").groupBy("plan_id", "i").agg(F.bool_and((F.col("dep") == 0) | F.coalesce("ok", F.lit(False))).alias("ready"))
    return checked.filter("ready").join(done, ["plan_id", "i"], "left_anti").select("plan_id", "i")


def initially_ready(edges: DataFrame) -> DataFrame:
    """Nodes that depend on the plan's input only."""
    return edges.groupBy("plan_id", "i").agg(F.max("dep").alias("most")).filter("most = 0").select("plan_id", "i")


def claims(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """For each tenant, the task it would claim next: of running runs, the oldest run first."""
    joined = startable(nodes, runs).join(runs, F.col("plan_id") == F.col("run_id"))
    order = Window.partitionBy("tenant_id").orderBy("created_at", "run_id", "i")
    return joined.withColumn("place", F.row_number().over(order)).filter("place = 1").select("tenant_id", "run_id", "i")


def effect_orders(nodes: DataFrame) -> DataFrame:
    """Reservation order of a plan's effects, and ordinal of each effect name, both from 0."""
    effects = nodes.filter("effectful")
    return effects.select(
        "plan_id", "i", "module_id",
        (F.row_number().over(Window.partitionBy("plan_id").orderBy("i")) - 1).alias("reservation_order"),
        (F.row_number().over(Window.partitionBy("plan_id", "module_id").orderBy("i")) - 1).alias("ordinal"),
    )


def idempotency_key(task_id: Column, effect_name: Column, ordinal: Column) -> Column:
    """A stable key from a task, an effect's name and its ordinal."""
    text = F.concat(F.lit('{"effect_name":"'), effect_name, F.lit('","ordinal":'), ordinal.cast("string"), F.lit(',"task_id":"'), task_id, F.lit('"}'))
    return F.concat(F.lit("mwf_"), F.sha2(text, 256))


def outstanding(usage: DataFrame) -> DataFrame:
    """plan_id and use by dimension: what is committed counts as metered, the rest as reserved."""
    of = lambda c: F.sum(F.when(F.col("committed"), F.col(f"{c}_actual")).otherwise(F.col(f"{c}_reserved")))
    return usage.groupBy("plan_id").agg(*(of(c).alias(c) for c in ("wall_time_ms", "tool_calls")))


def overrun(use: DataFrame, limits: dict[str, float]) -> DataFrame:
    """plan_id and the first dimension over its limit."""
    ladder = None
    for dimension in DIMENSIONS:
        if dimension in limits:
            over = F.col(dimension) > limits[dimension]
            name = DIMENSION_NAMES.get(dimension, dimension)
            ladder = ladder.when(over, name) if ladder is not None else F.when(over, name)
    return use.select("plan_id", ladder.alias("exceeded")).filter("exceeded is not null")


def over_limit(budgets: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Plans whose budget is over a finite limit, or unbounded under one, in order of dimensions."""
    ladder = None
    for dimension, limit in limits.items():
        bad = F.col(dimension).isNull() | (F.col(dimension).cast("decimal(28,10)") > F.lit(str(limit)).cast("decimal(28,10)"))
        ladder = ladder.when(bad, dimension) if ladder is not None else F.when(bad, dimension)
    return budgets.select("plan_id", ladder.alias("dimension")).filter("dimension is not null")


def key_conflicts(rows: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """Keys that were used with more than one value."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("kinds")).filter("kinds > 1")


def illegal_transitions(events: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps of a run's log from one type to a type that may not follow."""
    before = F.lag("event_type").over(Window.partitionBy("run_id").orderBy("event_id"))
    legal = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    step = events.withColumn("before", before).filter("before is not null")
    return step.filter(~F.array_contains(legal, F.concat_ws(">", "before", "event_type"))).select("run_id", "event_id", "before", "event_type")


def effect_records(nodes: DataFrame) -> DataFrame:
    """Two ledger rows, attempted and committed, of every effect that needs no approval; others only the first."""
    kinds = F.when(F.col("approval_required"), F.array(F.lit("ATTEMPTED"))).otherwise(F.array(F.lit("ATTEMPTED"), F.lit("COMMITTED")))
    return nodes.filter("effectful").select("plan_id", "i", F.explode(kinds).alias("kind"))


def incomplete_effects(records: DataFrame) -> DataFrame:
    """Effects whose ledger rows aren't one attempted and one committed."""
    pair = records.groupBy("plan_id", "i").agg(F.array_join(F.sort_array(F.collect_list("kind")), ",").alias("kinds"))
    return pair.filter("kinds <> 'ATTEMPTED,COMMITTED'")


def scheduler_outcome(status: Column) -> Column:
    """What the scheduler does about a task's state."""
    return F.when(status.isNull(), "create").when(status == "BLOCKED", "ready").when(status == "FAILED", "error").when(status == "SUCCEEDED", "output").otherwise("wait")


def coordinator_totals(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Totals of one scheduling pass over all runs."""
    tasks = nodes.groupBy("plan_id").agg(F.count("*").alias("n"))
    joined = runs.join(tasks, runs["run_id"] == tasks["plan_id"], "left")
    return joined.agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"),
        F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(F.col("status") == "PAUSED").alias("paused"), F.count_if(F.col("n").isNull()).alias("without_tasks"),
    )
