"""Contract columns and ledger checks on small inputs with known results."""

from pyspark.sql import functions as F

from planlens.functions import expressions as fx
from planlens.operators import contracts as co
from planlens.operators import events as ev
from planlens.operators import ledger as lg
from planlens.operators import replay as rp


def values(spark, *columns, rows=((0,),)):
    return [tuple(r) for r in spark.createDataFrame(list(rows), "x int").select(*columns).collect()]


def test_commands(spark):
    names = lambda *xs: F.array(*map(F.lit, xs))
    got = values(
        spark,
        co.command_defect(F.lit("pause"), F.lit("c"), names("type", "command_id")),
        co.command_defect(F.lit("approve"), F.lit("c"), names("type", "command_id")),
        co.command_defect(F.lit("stop"), F.lit("c"), names("type", "command_id")),
        co.command_defect(F.lit("pause"), F.lit(""), names("type", "command_id")),
    )
    assert got == [(None, "fields", "unknown-type", "no-id")]
    base = ("type", "command_id")
    legal = [("approve", "request_id", "comment"), ("approve", "request_id"), ("reject", "request_id"), ("reject", "request_id", "reason"), ("pause", "reason"), ("cancel", "reason"), ("signal", "name", "value", "request_id"), ("input", "request_id", "value"), ("retry", "task_id"), ("resume",)]
    refused = [("resume", "reason"), ("approve", "comment"), ("approve", "request_id", "reason"), ("signal", "name"), ("retry",), ("input", "request_id")]
    of = lambda kind, *fields: co.command_defect(F.lit(kind), F.lit("c"), names(*base, *fields), F.array().cast("array<string>"))
    assert values(spark, *(of(*x) for x in legal)) == [(None,) * len(legal)]
    assert values(spark, *(of(*x) for x in refused)) == [("fields",) * len(refused)]
    assert values(spark, co.command_defect(F.lit("retry"), F.lit("c"), names(*base, "task_id"), names("task_id"))) == [("blank",)]


def test_budget_values(spark):
    cases = [("tool_calls", 1.5, "not-whole"), ("cost_usd", 1.5, None), ("cost_usd", -1.0, "negative"), ("cost_usd", float("nan"), "not-finite"), ("tool_calls", float("inf"), "not-finite")]
    got = values(spark, *(co.budget_defect(F.lit(d), F.lit(v)) for d, v, _ in cases))
    assert got == [tuple(c[2] for c in cases)]


def test_units_and_names(spark):
    got = values(spark, fx.memory_bytes(F.lit("512MiB")), fx.memory_bytes(F.lit("512Mi")), fx.memory_bytes(F.lit("0MiB")), fx.is_secret_key(F.lit("API-Key")), co.whole_milliseconds(F.lit(1500)), co.whole_milliseconds(F.lit(2000)), *(ev.public_name(F.lit(x)) for x in ("TASK_READY", "ATTEMPT_STARTED", "TASK_COMPLETED", "TASK_SUCCEEDED")))
    assert got == [(512 << 20, None, None, True, None, 2, "task.ready", "task.started", "task.completed", "task.completed")]


def test_executors(spark):
    none = F.lit(None).cast("int")
    got = values(spark, co.executor_supports(none, F.lit(9), F.lit(1), none), co.executor_supports(F.lit(2), F.lit(9), F.lit(1), F.lit(9)), co.executor_supports(none, none, none, none))
    assert got == [(False, True, True)]


def test_event_pages(spark):
    rows = [(k, 1, "TASK_READY" if k % 2 else "ATTEMPT_HEARTBEAT", 1.0) for k in range(5)] + [(9, 2, "TASK_READY", 2.0)]
    events = spark.createDataFrame(rows, "event_id long, run_id long, event_type string, value double")
    assert [r["event_id"] for r in ev.page(events, 1, 1, 2).collect()] == [2, 3]
    assert {(r["run_id"], r["has_more"]) for r in ev.first_pages(events, 2).collect()} == {(1, True), (2, False)}
    assert ev.visible(events).count() == 3


def test_public_pages(spark):
    kinds = ["TASK_READY", "CHECKPOINT_WRITTEN", "TASK_READY", "ATTEMPT_CLAIMED"]
    rows = [(k, 1, kinds[k % 4], 1.0) for k in range(1, 9)] + [(20, 2, "TASK_READY", 2.0), (21, 2, "TASK_READY", 2.0), (30, 3, "ATTEMPT_HEARTBEAT", 2.0)]
    events = spark.createDataFrame(rows, "event_id long, run_id long, event_type string, value double")
    got = {tuple(r) for r in ev.public_pages(events, 2).collect()}
    assert got == {(1, 2, 4, True), (2, 2, 21, False), (3, 0, 30, False)}
    assert ev.redacted is not None and set(ev.OPERATIONAL_FIELDS) == {"checkpoint_digest", "lease_expires_at", "lease_token", "worker_id"}


def test_secrets_and_uuids(spark):
    import uuid

    texts = ['{"a":[{"Api-Key":1}]}', '{"a":"\\"token\\":"}', '{"a":["token"]}', '{"tokens":1}', '{"x":{"PASSWORD" :2}}']
    got = values(spark, *(fx.has_secret_key(F.lit(t)) for t in texts))
    assert got == [(True, False, False, False, True)]
    names = ["", "a", "é:1"]
    assert values(spark, *(fx.name_uuid(F.lit(n)) for n in names)) == [tuple(str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names)]


def test_resolution_after_latest_request(spark):
    rows = [(1, 1, "ASK", 0.0), (2, 1, "ANSWER", 1.0), (3, 1, "ASK", 0.0), (4, 1, "ANSWER", 2.0), (5, 2, "ASK", 0.0)]
    events = spark.createDataFrame(rows, "event_id long, run_id long, event_type string, value double")
    got = {r["run_id"]: (r["requested"], r["resolved"], r["value"]) for r in ev.resolutions(events, "ASK", "ANSWER").collect()}
    assert got == {1: (3, 4, 2.0), 2: (5, None, None)}


def test_frontier(spark):
    edges = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1), (1, 3, 0, 1), (1, 4, 0, 2), (1, 4, 1, 3)], "plan_id long, i int, position int, dep int")
    done = lambda *xs: spark.createDataFrame([(1, x) for x in xs], "plan_id long, i int")
    ready = lambda *xs: sorted(r["i"] for r in lg.frontier(edges, done(*xs)).collect())
    assert ready() == [1] and ready(1) == [2, 3] and ready(1, 2) == [3] and ready(1, 2, 3) == [4]


def test_overruns_in_order(spark):
    use = spark.createDataFrame([(1, 200, 99), (2, 10, 99), (3, 10, 1)], "plan_id long, wall_time_ms long, tool_calls long")
    got = {r["plan_id"]: r["exceeded"] for r in lg.overrun(use, {"wall_time_ms": 100, "tool_calls": 10}).collect()}
    assert got == {1: "wall_time", 2: "tool_calls"}


def test_decision_ladders(spark):
    checks = {"policy-denied": F.lit(True), "not-declared": F.col("x") == 1}
    got = values(spark, rp.ladder(checks, rp.READ_LADDER), rows=((0,), (1,)))
    assert got == [("policy-denied",), ("not-declared",)] and values(spark, rp.ladder({}, rp.READ_LADDER)) == [("used",)]
