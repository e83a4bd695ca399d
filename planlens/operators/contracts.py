"""Contract checks on declarations, commands, usage and declarations' order, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planlens.functions import expressions as fx

#: What a command of each type has besides type and command_id: what it must have, and what it may.
COMMAND_FIELDS = {
    "signal": (("name", "value"), ("request_id",)), "approve": (("request_id",), ("comment",)), "reject": (("request_id",), ("reason",)), "input": (("request_id", "value"), ()),
    "pause": ((), ("reason",)), "resume": ((), ()), "cancel": ((), ("reason",)), "retry": (("task_id",), ()),
}


def has_exactly(fields: Column, expected: tuple[str, ...]) -> Column:
    """Whether an array of names is the expected set."""
    return F.array_sort(fields) == F.array(*map(F.lit, sorted(expected)))


def in_order(items: Column) -> Column:
    """Whether an array ascends without repeats."""
    return items == F.array_sort(F.array_distinct(items))


def command_defect(kind: Column, command_id: Column, fields: Column, blank: Column | None = None) -> Column:
    """Why a command is refused, or null: unknown type, no id, a field that it lacks or doesn't know, a blank name.

    ``fields`` are those that hold a value; ``blank`` those whose text is blank, which
    no field that says whom a command is for may be.
    """
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    known, lacking, more = F.lit(False), F.lit(False), F.lit(False)
    for name, (must, may) in COMMAND_FIELDS.items():
        known = known | (kind == name)
        lacking = lacking | ((kind == name) & (F.size(F.array_except(names(must), fields)) > 0))
        more = more | ((kind == name) & (F.size(F.array_except(fields, names(("type", "command_id", *must, *may)))) > 0))
    out = F.when(kind.isNull() | ~known, "unknown-type").when(command_id.isNull() | (F.trim(command_id) == ""), "no-id").when(lacking | more, "fields")
    return out if blank is None else out.when(F.arrays_overlap(blank, names(("name", "request_id", "task_id"))), "blank")


def budget_defect(dimension: Column, value: Column) -> Column:
    """Why a budget's value is refused, or null: it must be finite, not negative, and whole unless it is a cost."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), "not-finite").when(value < 0, "negative").when((dimension != "cost_usd") & (value != F.floor(value)), "not-whole")


def whole_milliseconds(microseconds: Column) -> Column:
    """Milliseconds, or null where the precision is finer."""
    return F.when(microseconds % 1000 == 0, F.floor(microseconds / 1000))


def token_split(total: Column, given_in: Column, given_out: Column) -> Column:
    """Whether a reservation's tokens are well split: not at all, or to a sum."""
    return (given_in.isNull() & given_out.isNull()) | (F.coalesce(given_in, F.lit(0)) + F.coalesce(given_out, F.lit(0)) == total)


def fits_reservation(usage: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Whether what was metered is at most what was reserved in every dimension; nothing reserved is no limit."""
    fits = F.lit(True)
    for d in dimensions:
        fits = fits & (F.col(f"{d}_reserved").isNull() | (F.col(f"{d}_actual") <= F.col(f"{d}_reserved")))
    return usage.withColumn("fits", fits)


def executor_supports(cpu: Column, memory: Column, need_cpu: Column, need_memory: Column) -> Column:
    """Whether an executor is enough; one that states nothing has nothing."""
    return (F.coalesce(cpu, F.lit(-1)) >= F.coalesce(need_cpu, F.lit(-1))) & (F.coalesce(memory, F.lit(-1)) >= F.coalesce(need_memory, F.lit(-1)))


def exactly_one(rows: DataFrame, key: str, match: Column) -> DataFrame:
    """key and whether exactly one of its rows matches."""
    return rows.groupBy(key).agg((F.count_if(match) == 1).alias("resolved"), F.count_if(match).alias("found"))


def inherited(decisions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Decisions (plan_id, scope, choice) that a context (plan_id, context) inherits: those whose scope begins it."""
    joined = contexts.join(decisions, "plan_id")
    return joined.filter(F.slice("context", 1, F.size("scope")) == F.col("scope"))


def provenance_defects(tasks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows in which some but not all of the columns are given."""
    given = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return tasks.filter((given > 0) & (given < len(columns)))


def public_keys(payload: Column) -> Column:
    """Keys of a map that aren't secret."""
    return F.filter(F.map_keys(payload), lambda k: ~fx.is_secret_key(k))


def first_of_kind(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
