"""Event log: pages, public projection, redaction, allowlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log types whose public name isn't their own in lower case with dots.
PUBLIC_NAMES = {"ATTEMPT_STARTED": "task.started", "TASK_SUCCEEDED": "task.completed"}
#: Types that users don't see.
INTERNAL_TYPES = ("ATTEMPT_CLAIMED", "ATTEMPT_HEARTBEAT", "CHECKPOINT_WRITTEN")
#: Payload fields of operations.
OPERATIONAL_FIELDS = ("checkpoint_digest", "lease_expires_at", "lease_token", "worker_id")
PAGE_LIMIT, STORE_LIMIT = 1000, 1001


def public_name(event_type: Column) -> Column:
    """The public name of a type: mapped, or in lower case with dots."""
    names = F.create_map(*(F.lit(x) for pair in PUBLIC_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, event_type), F.lower(F.replace(event_type, F.lit("_"), F.lit("."))))


def visible(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("event_type").isin(*INTERNAL_TYPES))


def redacted(payload: Column) -> Column:
    """A payload map without operational fields."""
    return F.map_filter(payload, lambda k, v: ~k.isin(*OPERATIONAL_FIELDS))


def public_events(events: DataFrame) -> DataFrame:
    """event_id, run_id, name, payload_k of what users see."""
    return visible(events).select("event_id", "run_id", public_name(F.col("event_type")).alias("name"), F.get_json_object("payload", "$.k").cast("long").alias("payload_k"))


def page(events: DataFrame, run_id: int, after: int = -1, limit: int = 100) -> DataFrame:
    """One run's events after an exclusive cursor, by event_id."""
    if not 1 <= limit <= STORE_LIMIT:
        raise ValueError(f"limit must be 1 to {STORE_LIMIT}")
    return events.filter((F.col("run_id") == run_id) & (F.col("event_id") > after)).orderBy("event_id").limit(limit)


def first_pages(events: DataFrame, limit: int) -> DataFrame:
    """The first page of every run, and whether the run has more."""
    order = Window.partitionBy("run_id").orderBy("event_id")
    ranked = events.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit + 1)
    more = F.max("place").over(Window.partitionBy("run_id")) > limit
    return ranked.withColumn("has_more", more).filter(F.col("place") <= limit)


def public_pages(events: DataFrame, limit: int) -> DataFrame:
    """The first public page of every run: how many events it shows, the cursor to go on from, and whether to go on.

    A page is filled with visible events. A full one ends at its last event, and
    there is more if anything follows, visible or not; a page that isn't full ends
    at the run's last event of any type.
    """
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be 1 to {PAGE_LIMIT}")
    order = Window.partitionBy("run_id").orderBy("event_id")
    shown = visible(events).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    pages = shown.groupBy("run_id").agg(F.count("*").alias("shown"), F.max("event_id").alias("end"))
    whole = events.groupBy("run_id").agg(F.max("event_id").alias("last")).join(pages, "run_id", "left")
    full = F.coalesce(F.col("shown") == limit, F.lit(False))
    return whole.select("run_id", F.coalesce("shown", F.lit(0)).cast("long").alias("shown"), F.when(full, F.col("end")).otherwise(F.col("last")).alias("cursor"), (full & (F.col("last") > F.col("end"))).alias("has_more"))


def allowed_only(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Audit sink's rows: types on the allowlist."""
    return events.filter(F.col("event_type").isin(*types))


def latest_by_type(events: DataFrame) -> DataFrame:
    """The latest event of each type of a run."""
    return events.groupBy("run_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


def resolutions(events: DataFrame, request: str, resolution: str) -> DataFrame:
    """As-of: the latest request of a run and the last resolution after it."""
    asked = events.filter(F.col("event_type") == request).groupBy("run_id").agg(F.max("event_id").alias("requested"))
    after = events.filter(F.col("event_type") == resolution).join(asked, "run_id").filter(F.col("event_id") > F.col("requested"))
    found = after.groupBy("run_id").agg(F.max("event_id").alias("resolved"), F.max_by("value", "event_id").alias("value"))
    return asked.join(found, "run_id", "left")


def approval_evidence(events: DataFrame) -> DataFrame:
    """Runs in which a request, a command and a resolution follow each other: requested < command < resolved."""
    last = lambda kind, name: events.filter(F.col("event_type") == kind).groupBy("run_id").agg(F.max("event_id").alias(name))
    requested = events.filter("event_type = 'RUN_STARTED'").groupBy("run_id").agg(F.min("event_id").alias("requested"))
    command = last("TASK_READY", "command")
    resolved = last("TASK_COMPLETED", "resolved")
    joined = requested.join(command, (requested["run_id"] == command["run_id"]) & (F.col("requested") < F.col("command"))).select(requested["run_id"], "requested", "command")
    return joined.join(resolved, (joined["run_id"] == resolved["run_id"]) & (F.col("command") < F.col("resolved"))).select(joined["run_id"], "requested", "command", "resolved")


def without_repeats(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row, the first, for each key; for commands that may be sent again."""
    first = Window.partitionBy(*keys).orderBy("event_id")
    return events.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def sse(event_id: Column, name: Column, data: Column) -> Column:
    """Server-sent-event text."""
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\nevent: "), name, F.lit("\ndata: "), data, F.lit("\n\n"))
