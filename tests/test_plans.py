"""Graph kernel, validation, budgets, canonical values on small inputs with known results."""

import enum
from dataclasses import dataclass

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planlens.functions import authoring as au
from planlens.functions import expressions as fx
from planlens.plans import alignment as al
from planlens.plans import metrics as me
from planlens.plans import policy as po
from planlens.plans import validation as va

DIAMOND = {"finish": ["north", "south"], "north": ["begin"], "south": ["begin"], "begin": ["$input"]}
CATALOG = {k: va.Entry(inputs=("any",) * n) for k, n in (("one", 1), ("two", 2))}


def fragment(deps, outputs, alias=None):
    nodes = [{"key": k, "module_alias": (alias or {}).get(k, "two" if len(d) == 2 else "one"), "dependencies": d} for k, d in sorted(deps.items())]
    return {"fragment_id": "f", "version": va.VERSION, "nodes": nodes, "outputs": outputs}


def test_diamond():
    found = me.analyse(sorted(DIAMOND), DIAMOND, {"begin": 1, "north": 2, "south": 4, "finish": 8})
    assert found["max_depth"] == 3 and found["critical_path_ms"] == 13 and not found["cyclic"]
    assert found["order"] == ["begin", "north", "south", "finish"]
    assert me.analyse(sorted(DIAMOND), DIAMOND, {"begin": 1, "north": None, "south": 4, "finish": 8})["critical_path_ms"] is None


def test_order_is_depth_first():
    deps = {"a": ["$input"], "b": ["$input"], "c": ["a"], "d": ["b"]}
    assert me.analyse(sorted(deps), deps, {})["order"] == ["a", "c", "b", "d"]


def test_deep_chain():
    deps = {f"n{k:05d}": [f"n{k - 1:05d}"] if k else ["$input"] for k in range(1100)}
    assert me.analyse(sorted(deps), deps, {})["max_depth"] == 1100
    assert va.resolve(fragment(deps, ["n01099"]), CATALOG, va.Limits(2000, 2000, 9)) is None
    assert va.resolve(fragment(deps, ["n01099"]), CATALOG, va.Limits(2000, 10, 9)) == "PLAN_LIMIT_EXCEEDED"


@pytest.mark.parametrize(
    ("deps", "outputs", "limits", "code"),
    [
        (DIAMOND, ["finish"], va.Limits(), None),
        (DIAMOND, ["finish"], va.Limits(3, 5, 3), "PLAN_LIMIT_EXCEEDED"),
        (DIAMOND, ["finish"], va.Limits(8, 2, 3), "PLAN_LIMIT_EXCEEDED"),
        (DIAMOND, ["finish"], va.Limits(8, 5, 1), "PLAN_LIMIT_EXCEEDED"),
        ({}, ["finish"], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
        (DIAMOND, [], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
        (DIAMOND, ["finish", "finish"], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
        (DIAMOND, ["other"], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
        (DIAMOND, ["north"], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
        (DIAMOND | {"north": ["nowhere"]}, ["finish"], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
        (DIAMOND | {"finish": ["north", "north"]}, ["finish", "south"], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
        ({"a": ["b"], "b": ["a"]}, ["a"], va.Limits(), "PLAN_TOPOLOGY_INVALID"),
    ],
)
def test_first_violation(deps, outputs, limits, code):
    assert va.resolve(fragment(deps, outputs), CATALOG, limits) == code


def test_violations_of_form():
    good = fragment(DIAMOND, ["finish"])
    assert va.decode(good | {"more": 1}) == "PLAN_FRAGMENT_INVALID"
    assert va.decode(good | {"version": "9"}) == "PLAN_FRAGMENT_VERSION_UNSUPPORTED"
    assert va.decode(good | {"nodes": good["nodes"][::-1]}) == "PLAN_FRAGMENT_INVALID"
    assert va.decode(good | {"nodes": [good["nodes"][0]] * 2}) == "PLAN_TOPOLOGY_INVALID"
    assert va.resolve(fragment(DIAMOND, ["finish"], {"north": "unknown"}), CATALOG, va.Limits()) == "PLAN_MODULE_NOT_ALLOWED"


@given(st.lists(st.integers(0, 5), min_size=1, max_size=12))
def test_depth_by_relaxation(choices):
    deps = {f"n{k:02d}": sorted({f"n{(c * 7 + j) % k:02d}" for j in range(2)}) if k else ["$input"] for k, c in enumerate(choices)}
    depth = {}
    for k in sorted(deps):
        depth[k] = 1 + max([depth[d] for d in deps[k] if d in depth], default=0)
    assert me.analyse(sorted(deps), deps, {})["max_depth"] == max(depth.values())


def test_alignment_ends_at_the_first_incompatible_change(spark):
    """Each pair of versions by hand: what is found, in order."""
    names = ("plan_id", "key", "place", *al.STEP_COLUMNS)
    step = lambda plan, key, place, **x: (plan, key, place, *(x.get(c, "same") for c in al.STEP_COLUMNS))
    pairs = {
        1: ([step(1, "a", 1), step(1, "b", 2)], [step(1, "b", 1), step(1, "c", 2)], ["DELETION"]),
        2: ([step(2, "a", 1)], [step(2, "x", 1), step(2, "a", 2), step(2, "y", 3)], ["INSERTION"]),
        3: ([step(3, "a", 1), step(3, "b", 2), step(3, "c", 3)], [step(3, "a", 1), step(3, "c", 2), step(3, "b", 3)], ["REORDER"]),
        4: ([step(4, "a", 1)], [step(4, "a", 1, budget="more")], ["CONTROL_FLOW_CHANGED"]),
        5: ([step(5, k, n) for n, k in enumerate("abc", 1)], [step(5, "a", 1, effects="x", budget="x"), step(5, "b", 2, module_digest="x", dependencies="x", schemas="x"), step(5, "c", 3, schemas="x")], ["BUDGET_CHANGED", "EFFECT_CHANGED", "TOPOLOGY_CHANGED"]),
        6: ([step(6, "a", 1)], [step(6, "a", 1, control=None, policies="x")], ["CONTROL_FLOW_CHANGED"]),
        7: ([step(7, "a", 1)], [step(7, "a", 1, capabilities="x", connectors="x", policies="x", schemas="x", module_digest="x")], ["MODULE_DIGEST_CHANGED", "CAPABILITY_CHANGED", "CONNECTOR_CHANGED", "POLICY_CHANGED", "SCHEMA_CHANGED"]),
        8: ([step(8, "a", 1)], [step(8, "a", 1)], []),
    }
    schema = ", ".join(f"{c} {'int' if c in ('plan_id', 'place') else 'string'}" for c in names)
    before, after = (spark.createDataFrame([s for p in pairs.values() for s in p[k]], schema) for k in (0, 1))
    controls = [spark.createDataFrame([(k, "x" if k == 4 and n else "") for k in pairs], "plan_id int, controls string") for n in (0, 1)]
    got = al.align(before, after, *controls).orderBy("plan_id", "phase", "place", "rank").collect()
    assert {k: [r["kind"] for r in got if r["plan_id"] == k] for k in pairs} == {k: p[2] for k, p in pairs.items()}


def test_budgets(spark):
    rows = [(1, 1, 10, 0.1), (1, 2, 20, 0.2), (1, 3, 30, 0.0), (2, 1, None, 0.5)]
    nodes = spark.createDataFrame(rows, "plan_id long, i int, tool_calls long, cost_usd double")
    got = {r["plan_id"]: (r["tool_calls"], r["cost_usd"]) for r in me.aggregate_budget(nodes).collect()}
    assert got == {1: (60, 0.3), 2: (None, 0.5)}


def test_empty_inputs(spark):
    nodes = spark.createDataFrame([], "plan_id long, i int, module_id string, module_digest string, tool_calls long, cost_usd double, effectful boolean, approval_required boolean")
    edges = spark.createDataFrame([], "plan_id long, i int, position int, dep int")
    for frame in (me.aggregate_budget(nodes), me.fan_out(edges), me.composition(nodes), me.required_grant(nodes), me.topology_digest(nodes, edges), me.indexed_depths(nodes, edges), po.set_violations(nodes, ("a",), ("b",))):
        assert frame.count() == 0


class Colour(enum.Enum):
    RED = "red"


@dataclass
class Point:
    x: int
    y: float


def test_canonical_values():
    assert fx.canonical_json({"b": 1, "a": [True, None, 1.5]}) == '{"a":[true,null,1.5],"b":1}'
    assert fx.canonical_json(b"\x00\xff") == '{"$bytes":"00ff"}'
    assert fx.canonical_json({1, 2, 10}) == "[1,10,2]"
    assert fx.canonical_json((Colour.RED, Point(1, 2.0))) == '["red",{"x":1,"y":2.0}]'
    for bad in (float("nan"), {1: 2}, object()):
        with pytest.raises((ValueError, TypeError)):
            fx.canonical_json(bad)


def test_schemas():
    number = {"type": "number"}
    assert fx.matches_schema(1, number) and not fx.matches_schema(True, number) and not fx.matches_schema("1", number)
    assert fx.matches_schema([1, "a"], {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "string"}]})
    assert not fx.matches_schema({"a": 1}, {"type": "object", "properties": {"a": {"type": "string"}}})
    assert not fx.matches_schema({"b": 1}, {"type": "object", "required": ["a"]})
    whole = {"type": "object", "properties": {"a": True}, "additionalProperties": False}
    assert fx.matches_schema({"a": object()}, whole) and not fx.matches_schema({"b": 1}, whole)
    assert fx.matches_schema(1, {"type": "unknown"}) and not fx.matches_schema(1, {"pythonType": "x"})
    assert fx.matches_schema(None, {"anyOf": [{"type": "null"}, number]}) and fx.matches_schema(object, {})


def test_map_over(spark):
    rows = spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (2, [("b", 2), ("a", 1)])], "id long, items array<struct<part_no:string,value:bigint>>")
    done = au.map_over(rows, "id", "items", lambda x: x["part_no"], lambda x: x["value"])
    got = {r["id"]: [(m["instance"], m["value"]) for m in r["mapped"]] for r in done.collect()}
    assert [v for _, v in got[1]] == [1, 2] and [v for _, v in got[2]] == [2, 1] and dict(got[1]) == dict(got[2])
    twice = spark.createDataFrame([(1, [("a", 1), ("a", 2)])], rows.schema)
    with pytest.raises(Exception, match="repeated map key"):
        au.map_over(twice, "id", "items", lambda x: x["part_no"], lambda x: x["value"]).collect()


def test_split_branches(spark):
    rows = spark.createDataFrame([(2,), (-2,), (None,)], "x int")
    out = au.split(rows, F.col("x") > 0, lambda d: d.select((F.col("x") + 10).alias("y")), lambda d: d.select((F.col("x") - 10).alias("y")))
    assert sorted(r["y"] for r in out.collect() if r["y"] is not None) == [-12, 12]


def test_depths_and_limits_without_gathering_a_plan(spark, monkeypatch):
    size = 3_000
    nodes = spark.createDataFrame([(1, i, "a") for i in range(1, size + 1)] + [(2, 1, "a"), (2, 2, "b")], "plan_id long, i int, module_id string")
    edges = spark.createDataFrame([(1, i, 0, i // 2) for i in range(1, size + 1)] + [(2, 1, 0, 0), (2, 2, 0, 1)], "plan_id long, i int, position int, dep int")
    depths = me.indexed_depths(nodes, edges)
    assert {(r["plan_id"], r["i"]): r["depth"] for r in depths.collect()} == {(1, i): i.bit_length() for i in range(1, size + 1)} | {(2, 1): 1, (2, 2): 2}
    assert "collect_list" not in depths._jdf.queryExecution().toString()
    catalog, limits = {k: va.Entry() for k in "ab"}, va.Limits(max_nodes=12)
    whole = va.first_violations(va.fragments_of(nodes, edges), catalog, limits)
    gathered = []
    kernel = va.first_violations
    monkeypatch.setattr(va, "first_violations", lambda rows, *more: gathered.extend(r["plan_id"] for r in rows.collect()) or kernel(rows, *more))
    found = va.numbered_violations(nodes, edges, catalog, limits)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) == [(1, "PLAN_LIMIT_EXCEEDED"), (2, None)]
    assert gathered == [2]
    bad = nodes.withColumn("module_id", F.when(F.col("i") == 7, "7 7").otherwise(F.col("module_id")))
    assert {r["plan_id"]: r["code"] for r in va.numbered_violations(bad, edges, catalog, limits).collect()} == {1: "PLAN_FRAGMENT_INVALID", 2: None}


def test_every_rule_counts(spark):
    metrics = spark.createDataFrame([(1, 5)], "plan_id long, plan_depth int")
    rules = spark.createDataFrame([(k, "plan_depth", 4.0, None) for k in range(1_500)], "rank int, metric string, upper double, lower double")
    assert po.numeric_violations(metrics, rules, ("plan_depth",)).count() == 1_500
