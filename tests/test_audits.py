"""Paths and audits on small graphs and logs with known results."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from planlens.operators import audits as au
from planlens.plans import paths as pa

NODES, EDGES = "plan_id long, i int, wall_time_ms long", "plan_id long, i int, position int, dep int"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_wall_budget(spark):
    # Plan 1: two ways to 4; plan 2: an unknown time before its only output; plan 3: unknown beside an output that is known; plan 4: a cycle with an output behind it.
    nodes, edges = graph(
        spark,
        [(1, 1, 5), (1, 2, 10), (1, 3, 1), (1, 4, 2), (2, 1, None), (2, 2, 7), (3, 1, 3), (3, 2, None), (4, 1, 1), (4, 2, 1), (4, 3, 1)],
        [(1, 1, 0, 0), (1, 2, 0, 1), (1, 3, 0, 1), (1, 4, 0, 2), (1, 4, 1, 3), (2, 1, 0, 0), (2, 2, 0, 1), (3, 1, 0, 0), (3, 2, 0, 0), (4, 1, 0, 2), (4, 2, 0, 1), (4, 3, 0, 2)],
    )
    assert rows(pa.wall_budget(nodes, edges)) == [(1, 17), (2, None), (3, None), (4, None)]
    assert rows(pa.wall_budget(nodes.limit(0), edges.limit(0))) == []


def test_dependency_keys_pass_control_nodes(spark):
    # 4 <- 3 (control) <- 2 (control) <- 1; 3 and 2 also form a cycle; node 9 isn't known.
    _, edges = graph(spark, [], [(1, 1, 0, 0), (1, 2, 0, 1), (1, 2, 1, 3), (1, 3, 0, 2), (1, 4, 0, 3), (1, 4, 1, 9)])
    executable = spark.createDataFrame([(1, 1), (1, 4)], "plan_id long, i int")
    assert rows(pa.dependency_keys(edges, executable)) == [(1, 4, 1)]


def test_dependency_keys_follow_only_control_nodes(spark, monkeypatch):
    written = {}
    save = pa.Scratch.save
    monkeypatch.setattr(pa.Scratch, "save", lambda self, frame, name, **o: (kept := save(self, frame, name, **o), written.update({name: kept.count()}))[0])
    edges = spark.createDataFrame([(1, 1, 0), *((1, i, i - 1) for i in range(2, 9)), (1, 8, 2), (1, 8, 2), (2, 1, 2), (2, 2, 1), (2, 3, 1)], "plan_id long, i int, dep int")
    executable = spark.createDataFrame([(1, i) for i in (1, 2, 3, 6, 7, 8)] + [(2, 3)], "plan_id long, i int")
    assert rows(pa.dependency_keys(edges, executable)) == [(1, 2, 1), (1, 3, 2), (1, 6, 3), (1, 7, 6), (1, 8, 2), (1, 8, 7)]
    assert sum(n for name, n in written.items() if name.startswith("reached")) == 4



def test_executed_path(spark):
    # Branch 4 has condition 1 and ways 2 and 3.
    links = [(p, i, k, d) for p in (1, 2, 3) for i, k, d in ((1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1), (4, 1, 2), (4, 2, 3), (5, 0, 4))]
    _, edges = graph(spark, [], links)
    decisions = spark.createDataFrame([(1, 4, 1), (2, 4, 2)], "plan_id long, i int, selected int")
    outputs = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "plan_id long, i int")
    kept = rows(pa.executed_path(edges, decisions, outputs))
    assert kept == [(1, 1), (1, 2), (1, 4), (1, 5), (2, 1), (2, 3), (2, 4), (2, 5), (3, 1), (3, 2), (3, 3), (3, 4), (3, 5)]


def test_imported_defects(spark):
    schema = "plan_id long, i int, place int, module_id string, logical_step int, module_digest string, budget long"
    whole = lambda plan, i, place, step, **more: (plan, i, place, more.get("module", "m"), step, more.get("digest", "d"), more.get("budget", 1))
    steps = [
        whole(1, 1, 1, 1), whole(1, 2, 2, 2),
        whole(2, 1, 1, 1), whole(2, 1, 2, 2),
        whole(3, 2, 1, 1), whole(3, 1, 2, 2),
        whole(4, 1, 1, None), whole(5, 1, 1, 1), whole(5, 2, 2, 1), whole(6, 1, 1, 1, digest=None),
        whole(7, 1, 1, None, module=None), whole(8, 1, 1, None, module=None, budget=None),
    ]
    edges = [(1, 1, 0, 0), (1, 2, 0, 1), (3, 2, 0, 1), (3, 1, 0, 0), (8, 1, 0, 0)]
    got = rows(au.imported_defects(spark.createDataFrame(steps, schema), spark.createDataFrame(edges, EDGES)))
    assert got == [
        (2, "DUPLICATE_NODE", 1), (3, "UNKNOWN_OR_FORWARD_DEPENDENCY", 2), (4, "PARTIAL_IDENTITY", 1), (5, "DUPLICATE_REPLAY_KEY", 2),
        (6, "INCOMPLETE_DEFINITION", 1), (7, "CONTROL_WITH_CONTRACT", 1),
    ]


def test_ledger(spark):
    log = lambda key, *states: [(key, k, s) for k, s in enumerate(states)]
    table = log("ok", "RESERVED", "ATTEMPTED", "ATTEMPTED", "COMMITTED") + log("a", "ATTEMPTED", "COMMITTED", "ATTEMPTED") + log("b", "RESERVED", "COMMITTED") + log("c", "RESERVED", "RESERVED")
    got = rows(au.ledger_defects(spark.createDataFrame(table, "key string, n int, state string"), ("key",), "n").select("key", "n", "defect"))
    assert got == [("a", 0, "NOT_RESERVED"), ("a", 2, "AFTER_COMMIT"), ("b", 1, "NOT_ATTEMPTED"), ("c", 1, "RESERVED_TWICE")]


def test_leases(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    beats = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(5)), (1, 3, at(11))], "run_id long, event_id long, created_at timestamp")
    assert [r["event_id"] for r in au.lapsed_leases(beats).collect()] == [2]


def test_adoption(spark):
    cases = [
        ((None, True, "a", "a", "b"), "RUN_NOT_FOUND"), (("PAUSED", True, "a", "a", "b"), "RUN_NOT_RUNNING"), (("RUNNING", None, "a", "a", "b"), "NO_ACCEPTED_BOUNDARY"),
        (("RUNNING", True, "b", "a", "b"), "ALREADY_ADOPTED"), (("RUNNING", True, "c", "a", "b"), "DEFINITION_CHANGED"), (("RUNNING", True, "a", "a", "b"), "ADOPTED"),
    ]
    frame = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, s string, ok boolean, c string, e string, p string")
    got = frame.select("k", au.adoption_outcome(*map(F.col, ("s", "ok", "c", "e", "p"))).alias("o")).orderBy("k")
    assert [r["o"] for r in got.collect()] == [o for _, o in cases]


def test_proposals(spark):
    # What history didn't record isn't compared.
    fields = "k int, adapter string, version string"
    proposed = spark.createDataFrame([(1, "a", "2"), (2, "a", "2"), (3, "b", "1")], fields).alias("p")
    recorded = spark.createDataFrame([(1, "a", None), (2, "a", "1"), (3, "a", "2")], fields).alias("r")
    got = proposed.join(recorded, "k").select("k", au.first_difference("p", "r", ("adapter", "version"), where_recorded=True))
    assert rows(got) == [(1, None), (2, "version"), (3, "adapter")]
    both = proposed.join(recorded, "k").select("k", au.first_difference("p", "r", ("adapter", "version")))
    assert rows(both)[0] == (1, "version")


def test_lookups(spark):
    ledger = spark.createDataFrame([("x", "1", "COMMITTED"), ("y", "1", "ATTEMPTED"), ("z", "2", "COMMITTED")], "key string, request_digest string, status string")
    asked = spark.createDataFrame([(k, "1") for k in "wxyz"], "key string, request_digest string")
    got = rows(au.effect_lookups(asked, ledger, ("key",)).select("key", "outcome"))
    assert got == [("w", "RESERVE"), ("x", "RECOVERED"), ("y", "ATTEMPT"), ("z", "IDENTITY_CONFLICT")]


def test_executors_and_environments(spark):
    schema = "k int, isolation string, image string, cpu int, memory_bytes long, labels string"
    tasks = [(1, "vm", None, None, None, "[]"), (2, "process", "i", None, None, "[]"), (3, "process", None, 5, None, "[]"), (4, "process", None, None, 9, '["a"]'), (5, "process", "j", 4, 9, '["b","a"]'), (6, "process", None, None, None, '["c"]')]
    executor = {"isolations": ("process",), "images": ("j",), "cpu": 4, "memory_bytes": 9, "labels": '["a","b"]'}
    assert [r["k"] for r in spark.createDataFrame(tasks, schema).filter(au.fits_executor(executor)).orderBy("k").collect()] == [4, 5]
    digest = "0" * 64
    cases = [("jail", None, None, None, "isolation"), ("vm", "x:1", None, None, "image-not-pinned"), ("vm", None, None, None, "image-missing"), ("process", None, f"md5:{digest}", None, "lock"), ("process", None, None, 0, "cpu"), ("vm", f"x@sha256:{digest}", f"sha256:{digest}", 1, None)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, isolation string, image string, lock string, cpu int, want string")
    got = frame.select("want", au.environment_defect(*map(F.col, ("isolation", "image", "lock", "cpu"))).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_numbers_and_evidence(spark):
    numbers = [3.0, -2.0, 0.5, 132.5375, 123456.7, 1234567.5, 0.00001234, None]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(numbers)], "k int, n double")
    got = [r["t"] for r in frame.select("k", au.number_text(F.col("n")).alias("t")).orderBy("k").collect()]
    assert got == [None if n is None else str(int(n)) if n.is_integer() else f"{n:g}" for n in numbers]
    refusals = spark.createDataFrame([(1, 2, "B", "b."), (1, 1, "A", "a.")], "plan_id long, rank int, code string, message string")
    plans = spark.createDataFrame([(1, "p1"), (2, "p2")], "plan_id long, artifact_id string")
    assert rows(au.evidence_text(refusals, plans)) == [(1, "PLAN REFUSED: A\na.\nb."), (2, "PLAN APPROVED: p2")]


def test_rules(spark):
    cases = [("plan_depth", 7.0, 6.0, 1.0), ("plan_budget_cost_usd", 0.125, 2.0, 0.5), ("plan_fanout", 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, metric string, value double, upper double, lower double")
    columns = [F.col(c) for c in ("metric", "value", "upper", "lower")]
    assert rows(frame.select("k", au.rule_code(*columns), au.rule_message(*columns))) == [
        (0, "PLAN_DEPTH_EXCEEDED", "Plan depth is 7; policy allows at most 6 (plan_depth)."),
        (1, "PLAN_BUDGET_COST_BELOW_MINIMUM", "Plan cost budget (USD) is 0.125; policy requires at least 0.5 (plan_budget_cost_usd)."),
        (2, None, None),
    ]
