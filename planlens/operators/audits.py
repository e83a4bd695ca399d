"""Audits of ledgers, leases, adoptions, imported plans and proposals, and the texts of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Environments in which a task may be isolated.
ISOLATIONS = ("process", "container", "vm", "microvm")
#: A policy's numeric metrics, each with the code of a plan beyond its upper limit and the label in messages.
METRICS = {
    "plan_depth": ("PLAN_DEPTH_EXCEEDED", "Plan depth"),
    "plan_fanout": ("PLAN_FANOUT_EXCEEDED", "Plan fan-out"),
    "plan_budget_cost_usd": ("PLAN_BUDGET_COST_EXCEEDED", "Plan cost budget (USD)"),
    "plan_budget_model_tokens": ("PLAN_BUDGET_MODEL_TOKENS_EXCEEDED", "Plan model-token budget"),
    "plan_budget_tool_calls": ("PLAN_BUDGET_TOOL_CALLS_EXCEEDED", "Plan tool-call budget"),
    "plan_budget_wall_time_ms": ("PLAN_BUDGET_WALL_TIME_EXCEEDED", "Plan wall-time budget (ms)"),
}


def first_difference(left: str, right: str, fields: tuple[str, ...], where_recorded: bool = False) -> Column:
    """The first field in which two joined rows differ, or null; ``where_recorded``: what the right row lacks isn't compared."""
    differs = lambda f: ~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) & (F.col(f"{right}.{f}").isNotNull() if where_recorded else F.lit(True))
    return F.coalesce(*(F.when(differs(f), f) for f in fields))


def ledger_defects(log: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """Rows of an effect log (state) out of order: reserved once and first, then attempted, then committed and over."""
    before = F.lag("state").over(Window.partitionBy(*key).orderBy(order))
    defect = (
        F.when(before.isNull() & (F.col("state") != "RESERVED"), "NOT_RESERVED").when(before == "COMMITTED", "AFTER_COMMIT")
        .when(before.isNotNull() & (F.col("state") == "RESERVED"), "RESERVED_TWICE").when((F.col("state") == "COMMITTED") & (before != "ATTEMPTED"), "NOT_ATTEMPTED")
    )
    return log.withColumn("defect", defect).filter("defect is not null")


def lapsed_leases(beats: DataFrame, lease: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """Beats (run_id, event_id, created_at) whose lease ended before the run's next row; the last one of a run hasn't lapsed by its log."""
    after = F.lead("created_at").over(Window.partitionBy("run_id").orderBy("created_at", "event_id"))
    return beats.withColumn("next_at", after).filter(F.col("next_at") > F.col("created_at") + F.expr(lease))


def adoption_outcome(run_status: Column, source_accepted: Column, current: Column, expected: Column, proposed: Column) -> Column:
    """What becomes of a proposed definition; only a running run whose planner was accepted takes one, and the same one again at no effect."""
    return (
        F.when(run_status.isNull(), "RUN_NOT_FOUND").when(run_status != "RUNNING", "RUN_NOT_RUNNING").when(~F.coalesce(source_accepted, F.lit(False)), "NO_ACCEPTED_BOUNDARY")
        .when(current == proposed, "ALREADY_ADOPTED").when(~current.eqNullSafe(expected), "DEFINITION_CHANGED").otherwise("ADOPTED")
    )


def effect_lookups(proposals: DataFrame, ledger: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Each proposal with what its identity's ledger row (request_digest, status) means: another request, a result to give back, or a call to make."""
    known = ledger.select(*key, F.col("request_digest").alias("_digest"), F.col("status").alias("_status"))
    outcome = F.when(F.col("_status").isNull(), "RESERVE").when(F.col("_digest") != F.col("request_digest"), "IDENTITY_CONFLICT").when(F.col("_status") == "COMMITTED", "RECOVERED").otherwise("ATTEMPT")
    return proposals.join(known, list(key), "left").withColumn("outcome", outcome).drop("_digest", "_status")


def conflicting_materializations(log: DataFrame, region: tuple[str, ...], order: str) -> DataFrame:
    """Rows (plan_digest) of a region that bring another digest than its first: an equal one again is no conflict."""
    first = F.first("plan_digest").over(Window.partitionBy(*region).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return log.withColumn("first_digest", first).filter("plan_digest <> first_digest")


def imported_defects(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, defect, i: the first defect of each imported plan, by place of the step and order of checks.

    ``steps`` are (plan_id, i, place, module_id, logical_step, module_digest, budget),
    ``edges`` (plan_id, i, dep) with dep 0 as the plan's input. A dependency must be an
    earlier step, an identity is whole or absent, a replay key occurs once, executable
    steps are defined in full, and control steps have no budget.
    """
    places = steps.groupBy("plan_id", F.col("i").alias("dep")).agg(F.min("place").alias("dep_place"))
    own = steps.groupBy("plan_id", "i").agg(F.min("place").alias("place"))
    bad = edges.filter("dep <> 0").join(own, ["plan_id", "i"]).join(places, ["plan_id", "dep"], "left")
    bad = bad.filter(F.col("dep_place").isNull() | (F.col("dep_place") >= F.col("place"))).groupBy("plan_id", "i").agg(F.lit(True).alias("bad_dependency"))
    again = lambda *key: F.row_number().over(Window.partitionBy("plan_id", *key).orderBy("place")) > 1
    whole = F.col("module_id").isNotNull() & F.col("logical_step").isNotNull()
    partial = F.col("module_id").isNotNull() != F.col("logical_step").isNotNull()
    marked = steps.withColumn("twice", again("i")).withColumn("key_twice", whole & again("module_id", "logical_step")).join(bad, ["plan_id", "i"], "left")
    checks = (
        (F.col("twice"), "DUPLICATE_NODE"), (F.coalesce("bad_dependency", F.lit(False)), "UNKNOWN_OR_FORWARD_DEPENDENCY"), (partial, "PARTIAL_IDENTITY"), (F.col("key_twice"), "DUPLICATE_REPLAY_KEY"),
        (whole & (F.col("module_digest").isNull() | F.col("budget").isNull()), "INCOMPLETE_DEFINITION"), (~whole & F.col("budget").isNotNull(), "CONTROL_WITH_CONTRACT"),
    )
    defect = F.coalesce(*(F.when(test, code) for test, code in checks))
    first = F.min_by(F.struct("defect", "i"), "place").alias("f")
    return marked.withColumn("defect", defect).filter("defect is not null").groupBy("plan_id").agg(first).select("plan_id", "f.defect", "f.i")


def reuse_defects(steps: DataFrame) -> DataFrame:
    """plan_id, module_id, uses of modules that a plan uses twice or more, at least once without an explicit step."""
    return steps.groupBy("plan_id", "module_id").agg(F.count("*").alias("uses"), F.count_if(~F.col("explicit")).alias("implicit")).filter("uses > 1 and implicit > 0")


def contained_labels(part: Column, whole: Column) -> Column:
    """Whether all items of one JSON array of texts are in another; null if either isn't one."""
    items = lambda c: F.from_json(c, "array<string>")
    return F.size(F.array_except(items(part), items(whole))) == 0


def fits_executor(executor: dict) -> Column:
    """Whether a task (isolation, image, cpu, memory_bytes, labels as JSON) fits an executor; a task that states no image, cpu or memory needs none."""
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    least = lambda c: F.col(c).isNull() | (F.col(c) <= executor[c])
    image = F.col("image").isNull() | F.array_contains(strings(executor["images"]), F.col("image"))
    return F.array_contains(strings(executor["isolations"]), F.col("isolation")) & image & least("cpu") & least("memory_bytes") & contained_labels(F.col("labels"), F.lit(executor["labels"]))


def environment_defect(isolation: Column, image: Column, lock: Column, cpu: Column) -> Column:
    """Why an execution environment is refused, or null; digests must be pinned."""
    pinned = lambda c, form: F.coalesce(c.rlike(form), F.lit(True))
    return (
        F.when(~isolation.isin(*ISOLATIONS), "isolation").when(~pinned(image, r"(?s)\A.+@sha256:[0-9a-f]{64}\z"), "image-not-pinned")
        .when((isolation != "process") & image.isNull(), "image-missing").when(~pinned(lock, r"\Asha256:[0-9a-f]{64}\z"), "lock").when(cpu < 1, "cpu")
    )


def number_text(value: Column) -> Column:
    """A whole number without a point, others with six significant digits as ``%g`` has them, in Arrow batches: the JVM's formats round ties of the shortest decimal, not of the number."""
    short = F.pandas_udf(lambda numbers: numbers.map("{:g}".format), StringType())
    value = value.cast("double")
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).when(value.isNotNull(), short(value))


def _named(metric: Column, place: int) -> Column:
    return F.coalesce(*(F.when(metric == name, F.lit(texts[place])) for name, texts in METRICS.items()))


def rule_code(metric: Column, observed: Column, upper: Column, lower: Column) -> Column:
    """The code of a plan beyond a limit of a numeric rule, or null."""
    code = _named(metric, 0)
    return F.when(observed > upper, code).when(observed < lower, F.regexp_replace(code, "EXCEEDED$", "BELOW_MINIMUM"))


def rule_message(metric: Column, observed: Column, upper: Column, lower: Column) -> Column:
    """The sentence that tells how a plan breaks a numeric rule, or null if it doesn't."""
    says = lambda how, bound: F.concat(_named(metric, 1), F.lit(" is "), number_text(observed), F.lit(f"; policy {how} "), number_text(bound), F.lit(" ("), metric, F.lit(")."))
    return F.when(observed > upper, says("allows at most", upper)).when(observed < lower, says("requires at least", lower))


def evidence_text(refusals: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, evidence: what a reader is told of each of ``plans`` (plan_id, artifact_id), from ``refusals`` (plan_id, rank, code, message)."""
    listed = refusals.groupBy("plan_id").agg(F.min_by("code", "rank").alias("code"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "message"))), lambda x: x["message"]).alias("messages"))
    refused = F.concat(F.lit("PLAN REFUSED: "), "code", F.lit("\n"), F.array_join("messages", "\n"))
    return plans.join(listed, "plan_id", "left").select("plan_id", F.coalesce(refused, F.concat(F.lit("PLAN APPROVED: "), "artifact_id")).alias("evidence"))
