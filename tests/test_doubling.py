"""Paths by doubling against a plain walk, deep chains, broken graphs; schemas against a recursion."""

import json
import random
import time

from pyspark.sql import functions as F

from planlens.plans import metrics as me
from planlens.plans import paths as pa
from planlens.plans import schemas as sc
from planlens.plans.doubling import ancestry


def graphs(seed):
    r = random.Random(seed)
    for plan in range(50):
        keys = [f"k{x:02d}" for x in r.sample(range(100), r.randint(1, 12))]
        deps = {k: ["$input"] if not j or r.random() < 0.2 else [r.choice(keys[:j]) for _ in range(r.randint(1, 3))] for j, k in enumerate(keys)}
        if plan % 10 == 8 and len(keys) > 2:
            deps[keys[0]] = [keys[-1]]
            deps[keys[-1]] = [keys[0]]
        if plan % 10 == 9:
            deps[keys[0]] = ["gone"]
        yield plan, keys, deps, {k: None if r.random() < 0.1 else float(r.randint(0, 50)) for k in keys}


def test_graph_metrics(spark):
    rows, want = [], {}
    for plan, keys, deps, wall in graphs(4):
        rows += [(plan, k, deps[k], wall[k]) for k in keys]
        found = me.analyse(sorted(keys), deps, wall)
        order = [k for k in found["order"]]
        path = found["critical_path_ms"] if len(order) == len(keys) else None
        want[plan] = (len(keys), found["max_depth"], found["cyclic"], ",".join(found["missing"]), ",".join(found["unreachable"]), ",".join(order), path)
    nodes = spark.createDataFrame(rows, "plan_id long, key string, dependencies array<string>, wall_time_ms double")
    got = {r["plan_id"]: tuple(r)[1:] for r in me.graph_metrics(nodes).collect()}
    assert got == want
    assert me.graph_metrics(nodes.limit(0)).count() == 0


def test_chain_takes_few_rounds(spark):
    n = 1_100
    nodes = spark.range(1, n + 1).selectExpr("1L as plan_id", "cast(id as int) as i", "1L as wall_time_ms")
    edges = nodes.selectExpr("plan_id", "i", "i - 1 as dep")
    began = time.time()
    got = ancestry(nodes, edges.filter("dep > 0")).agg(F.max("depth"), F.max("path_ms"), F.count_if("used"), F.count_if(F.expr("cyclic or lost"))).first()
    assert tuple(got) == (n, float(n), n, 0) and time.time() - began < 60
    assert me.indexed_depths(nodes, edges, rounds=2).agg(F.max("depth"), F.count("*")).first()[:] == (n, n)
    assert pa.critical_paths(nodes, edges).agg(F.max("path_ms")).first()[0] == n


def test_depths_by_rounds_and_by_doubling(spark):
    rows = [(plan, k, d) for plan, keys, deps, _ in graphs(9) for k in keys for d in deps[k]]
    edges = spark.createDataFrame(rows, "plan_id long, i string, d string").selectExpr("plan_id", "cast(substring(i, 2) as int) + 1 as i", "case d when '$input' then 0 when 'gone' then 500 else cast(substring(d, 2) as int) + 1 end as dep")
    by = lambda n: sorted(map(tuple, me.indexed_depths(None, edges, rounds=n).collect()))
    assert by(1) == by(3) == by(100)


def test_outputs_given(spark):
    nodes = spark.createDataFrame([(1, i, 1) for i in range(1, 6)], "plan_id long, i int, wall_time_ms long")
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 5, 4)], "plan_id long, i int, dep int")
    used = ancestry(nodes, edges, outputs=spark.createDataFrame([(1, 3)], "plan_id long, i int")).filter("used")
    assert sorted(r["i"] for r in used.collect()) == [1, 2, 3]


def fits(source, target):
    if not target or not source or source == target or target.get("pythonType") in sc.ANYTHING:
        return True
    if target.get("type") == "number" and source.get("type") == "integer":
        return True
    return any(fits(source, x) for x in target.get("anyOf", ()) if isinstance(x, dict))


def test_schemas(spark):
    r = random.Random(2)

    def schema(depth=0):
        if depth < 3 and r.random() < 0.5:
            return {"anyOf": [schema(depth + 1) for _ in range(r.randint(0, 3))]}
        return r.choice([{}, {"type": "integer"}, {"type": "number"}, {"type": "string"}, {"pythonType": "a.B"}, {"pythonType": "typing.Any"}, {"type": "object", "properties": {"a": {"type": "integer"}}}])

    every = [schema() for _ in range(40)] + [{"anyOf": [True, {"type": "null"}]}]
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    pairs = [(text(a), text(b)) for a in every for b in every]
    got = sc.compatible(spark.createDataFrame(pairs, "source string, target string"))
    assert {(a, b): ok for a, b, ok in got.select("source", "target", "compatible").collect()} == {p: fits(*map(json.loads, p)) for p in pairs}
    edges = spark.createDataFrame([(1, '{"type":"string"}', '{"type":"number"}'), (2, '{"type":"integer"}', '{"type":"number"}'), (1, '{"type":"string"}', '{"type":"number"}')], "id long, source string, target string")
    assert [x["id"] for x in sc.incompatible_edges(edges).collect()] == [1, 1]


def test_plans_in_a_row_and_by_doubling_are_equal(spark, monkeypatch):
    from planlens.plans import doubling

    rows = [(plan, k, deps[k], wall[k]) for plan, keys, deps, wall in graphs(6) for k in keys]
    nodes = spark.createDataFrame(rows, "plan_id long, i string, deps array<string>, wall_time_ms double")
    edges = nodes.select("plan_id", "i", F.explode("deps").alias("dep")).filter("dep <> '$input'")
    by = lambda: sorted(map(repr, ancestry(nodes, edges).collect()))
    few = by()
    monkeypatch.setattr(doubling, "sizes_above", lambda rows: rows.select("plan_id").distinct())
    assert by() == few and len(few) == len(rows)
    plan = me.indexed_depths(None, spark.range(9).selectExpr("id as plan_id", "1 as i", "0 as dep"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
