"""Bindings, pre-created tasks, typed values, grants, repeated keys, planners and ready tasks against plain Python."""

import json
import random
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from planlens.functions import json_keys as jk
from planlens.functions import planner as pl
from planlens.functions import typed as ty
from planlens.operators import declarations as de
from planlens.operators import interactions as it
from planlens.plans import bindings as bi
from planlens.plans.precreation import precreated
from planlens.streaming.ready import ready_tasks


def _leaf(r):
    return {"kind": "source", "schema_digest": "d", "source": r.choice("abcdé")} if r.random() < 0.7 else {"kind": "literal", "schema_digest": "d", "value": r.choice([None, 1.5, {"source": "z"}])}


def _binding(r, depth):
    kind = r.choice(["list", "tuple", "object", "field", "leaf"]) if depth else "leaf"
    if kind in ("list", "tuple"):
        return {"kind": kind, "schema_digest": "d", "items": [_binding(r, depth - 1) for _ in range(r.randint(0, 3))]}
    if kind == "object":
        names = sorted(r.sample("pqrst", r.randint(0, 3)))
        return {"kind": kind, "schema_digest": "d", "fields": [{"name": n, "binding": _binding(r, depth - 1)} for n in names]}
    if kind == "field":
        return {"kind": kind, "schema_digest": "d", "source": r.choice("abc"), "path": ["x", "y"]}
    return _leaf(r)


def _sources(x):
    if x["kind"] in ("source", "field"):
        return [x["source"]]
    inner = [f["binding"] for f in x.get("fields", [])] + x.get("items", [])
    return list(dict.fromkeys(s for y in inner for s in _sources(y)))


def test_binding_sources(spark):
    r = random.Random(5)
    docs = [_binding(r, 4) for _ in range(150)]
    table = spark.createDataFrame([(k, json.dumps(d), "clash") for k, d in enumerate(docs)] + [(999, None, "clash")], "k long, doc string, path string").select("k", "doc", "path")
    walked = bi.walk(table, ["k"], "doc")
    assert walked.filter("defect is not null").count() == 0
    got = {}
    for row in bi.source_nodes(walked, ["k"]).orderBy("k", "position").collect():
        got.setdefault(row["k"], []).append(row["source"])
    assert got == {k: _sources(d) for k, d in enumerate(docs) if _sources(d)}
    assert bi.walk(table.filter("false"), ["k"], "doc").count() == 0


GOOD = '{"kind":"source","schema_digest":"d","source":"a"}'


@pytest.mark.parametrize(
    "text, path, defect",
    [
        ("[]", "$", "NOT_AN_OBJECT"), ("no json", "$", "NOT_AN_OBJECT"), ("null", "$", "NOT_AN_OBJECT"), ('{"kind":1}', "$", "KIND_INVALID"), ("{}", "$", "KIND_INVALID"), ('{"kind":"source"}', "$", "FIELDS_INVALID"),
        (GOOD.replace('"d"', "null"), "$", "SCHEMA_NOT_TEXT"), (GOOD.replace('"a"', '""'), "$", "SOURCE_INVALID"), (GOOD.replace('"a"', "null"), "$", "SOURCE_INVALID"),
        ('{"kind":"field","schema_digest":"d","source":"a","path":[]}', "$", "PATH_INVALID"), ('{"kind":"field","schema_digest":"d","source":"a","path":["x",null]}', "$", "PATH_INVALID"),
        ('{"kind":"field","schema_digest":"d","source":"a","path":"x"}', "$", "PATH_INVALID"), ('{"kind":"list","schema_digest":"d","items":{}}', "$", "ITEMS_NOT_ARRAY"),
        ('{"kind":"tuple","schema_digest":"d","items":[' + GOOD + ",null]}", "$.items[1]", "NOT_AN_OBJECT"), ('{"kind":"object","schema_digest":"d","fields":null}', "$", "FIELDS_NOT_ARRAY"),
        ('{"kind":"object","schema_digest":"d","fields":[{"name":"a","binding":' + GOOD + '},{"name":"b"}]}', "$.fields[1]", "FIELD_INVALID"),
        ('{"kind":"object","schema_digest":"d","fields":[{"name":"","binding":' + GOOD + "}]}", "$.fields[0]", "NAME_INVALID"),
        ('{"kind":"object","schema_digest":"d","fields":[{"name":"b","binding":' + GOOD + '},{"name":"a","binding":' + GOOD + "}]}", "$", "FIELDS_NOT_CANONICAL"),
        ('{"kind":"object","schema_digest":"d","fields":[{"name":"b","binding":[]},{"name":"a","binding":' + GOOD + "}]}", "$.fields[0].binding", "NOT_AN_OBJECT"),
    ],
)
def test_binding_defects(spark, text, path, defect):
    table = spark.createDataFrame([(1, text), (2, GOOD)], "k long, doc string")
    assert [tuple(r) for r in bi.first_defects(bi.walk(table, ["k"], "doc"), ["k"]).collect()] == [(1, path, defect)]


def test_precreated_follows_a_walk(spark):
    r = random.Random(8)
    nodes, edges, outputs, want = [], [], [], set()
    for plan in range(80):
        n = r.randint(1, 9)
        kinds = {i: r.choice(["module", "module", "parallel", "when", "map_module"]) for i in range(1, n + 1)}
        deps = {i: r.sample(range(i), min(i, r.randint(1, 3))) for i in kinds}
        nodes += [(plan, i, k) for i, k in kinds.items()]
        edges += [(plan, i, p, d) for i, ds in deps.items() for p, d in enumerate(ds)]
        outputs.append((plan, n))
        seen = set()

        def visit(i, scope):
            if i == 0 or i in seen:
                return
            seen.add(i)
            if kinds[i] == "module":
                want.add((plan, i, "/".join(scope)))
            for p, d in enumerate(deps[i][:1] if kinds[i] in ("when", "map_module") else deps[i]):
                visit(d, scope + ([f"parallel:{p}"] if kinds[i] == "parallel" else []))

        visit(n, [])
    got = precreated(spark.createDataFrame(nodes, "plan_id long, i int, kind string"), spark.createDataFrame(edges, "plan_id long, i int, position int, dep int"), spark.createDataFrame(outputs, "plan_id long, i int"))
    assert {tuple(x) for x in got.collect()} == want


@dataclass
class Inner:
    a: int
    b: list[str] = field(default_factory=list)


@dataclass
class Outer:
    inner: Inner
    more: dict[str, float] | None
    pair: tuple[int, str] = (0, "")


VALUES = [
    "null", "true", "1", "1.5", "1e300", "-3", "12345678901234567890", '"x"', "[]", "{}", "[1,2]", "[1,null]", '[1,"x"]', '["x"]', '{"a":1}', '{"a":1.5}', '{"a":1,"b":["x"]}', '{"a":1,"b":[1]}', '{"a":1,"c":2}',
    '{"inner":{"a":1},"more":null}', '{"inner":{"a":1},"more":{"x":1.5},"pair":[1,"x"]}', '{"inner":{"a":1},"more":{"x":1}}', '{"inner":{"a":1}}', '{"inner":{"a":"1"},"more":null}', '{"inner":{"a":1},"more":null,"pair":[1]}',
]


def _is(value, t):
    """By the same rules, for values as Python reads them."""
    shape, args = ty._shape(t)
    if shape == "any":
        return True
    if shape == "plain":
        return value is None if args[0] is type(None) else isinstance(value, args[0])
    if shape == "union":
        return any(_is(value, a) for a in args)
    if shape == "list":
        return isinstance(value, list) and all(_is(x, args[0]) for x in value)
    if shape == "tuple":
        return isinstance(value, list) and len(value) == len(args) and all(map(_is, value, args))
    if shape == "map":
        return isinstance(value, dict) and all(_is(k, args[0]) and _is(x, args[1]) for k, x in value.items())
    if shape == "record":
        return isinstance(value, dict) and all(_is(value[n], a) if n in value else optional for n, a, optional in ty._fields(t))
    return False


def test_values_of_types(spark):
    kinds = [str, int, float, bool, None, list[int], list[int | None], tuple[int, str], dict[str, int], dict[str, float] | None, dict[int, int], Inner, Outer, Inner | list[str], float | None, bytes]
    rows = spark.createDataFrame([(t,) for t in VALUES], "t string").select("t", *(ty.fits(F.parse_json("t"), k).alias(f"c{j}") for j, k in enumerate(kinds)))
    for row in rows.collect():
        assert list(row)[1:] == [_is(json.loads(row["t"]), k) for k in kinds], row["t"]
    outer = spark.createDataFrame([(t,) for t in VALUES], "t string").select("t", ty.rehydrated(F.parse_json("t"), Outer).alias("o"), ty.rehydrated(F.parse_json("t"), dict[str, float] | None).alias("m"))
    got = {r["t"]: (r["o"] and r["o"]["inner"]["a"], r["m"]) for r in outer.collect()}
    assert got['{"inner":{"a":1},"more":{"x":1.5},"pair":[1,"x"]}'][0] == 1 and got['{"a":1.5}'] == (None, {"a": 1.5}) and got["[]"] == (None, None)


def test_schemas_of_types():
    assert ty.schema_text(list[int | None]) == '{"items":{"anyOf":[{"type":"integer"},{"type":"null"}]},"type":"array"}'
    assert ty.type_schema(Inner) == {"type": "object", "title": f"{__name__}.Inner", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False, "required": ["a"]}
    assert ty.type_schema(tuple[int, str]) == {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "string"}]}
    assert ty.type_schema(bytes) == {"type": "string", "contentEncoding": "hex"} and ty.type_schema(object) == {"pythonType": "builtins.object"}


def test_stored_grants(spark):
    cases = {
        None: ([], [], None), "no json": ([], [], None), '["gpu"]': ([], [], None), "{}": ([], [], "FIELDS"), '{"capabilities":[],"effects":{}}': ([], [], "NOT_LISTS"), '{"capabilities":[null],"effects":[]}': ([], [], "NOT_NAMES"),
        '{"capabilities":["b","a"],"effects":[]}': ([], [], "NOT_CANONICAL"), '{"capabilities":["a","a"],"effects":[]}': ([], [], "NOT_CANONICAL"), '{"capabilities":["a","b"],"effects":["c"]}': (["a", "b"], ["c"], None),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", it.stored_grant(F.col("t")).alias("g")).collect()
    assert {r["t"]: (r["g"]["capabilities"], r["g"]["effects"], r["g"]["defect"]) for r in rows} == cases


def test_resolutions(spark):
    rows = [("approval", '{"decision":"approve","comment":"c"}'), ("approval", '{"decision":"reject","reason":1}'), ("approval", "{}"), ("input", '{"value":1}'), ("input", "{}"), ("signal", '{"name":"s","value":1}'), ("signal", '{"name":"t","value":1}'), ("signal", '{"name":"s","value":"x"}')]
    table = spark.createDataFrame(rows, "kind string, t string").withColumn("v", F.parse_json("t"))
    got = table.select(it.approval(F.col("v")).alias("a"), it.resolution_defect(F.col("kind"), F.col("v"), F.lit("s"), int).alias("d")).collect()
    assert [r["d"] for r in got] == [None, None, "DECISION_INVALID", None, "OUTPUT_CONTRACT", None, "SIGNAL_NAME", "OUTPUT_CONTRACT"]
    assert got[0]["a"]["approved"] is True and got[0]["a"]["comment"] == "c" and got[1]["a"]["approved"] is False and got[1]["a"]["reason"] is None and got[2]["a"] is None


def test_repeated_keys(spark):
    texts = ['{"a":1,"a":2}', '{"a":{"b":1,"b":2},"c":[{"d":1},{"d":1,"d":1}]}', '{"a":1,"\\u0061":2}', "[]", "no", None, "[" * 100_000 + "]" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(jk.repeated(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in rows][:6] == [["$.a"], ["$.a.b", "$.c[1].d"], ["$.a"], [], None, None]


def test_planner_refuses(spark):
    def plan(request):
        for key in request.split():
            if key == "bad":
                raise ValueError(key)
            yield key, "m", []

    pl.register_planner(spark, "planlens_test_plan", plan, 2)
    spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "a b c"), (4, "bad"), (5, None), (6, "")], "id long, request string").createOrReplaceTempView("planlens_test_requests")
    got = {}
    for row in pl.planned(spark, "planlens_test_plan", "planlens_test_requests", "request", ("id",)).collect():
        got.setdefault(row["id"], []).append(row["refusal"] or row["key"])
    assert got == {1: ["a", "b"], 2: ["a", "PLAN_DUPLICATE_KEY"], 3: ["a", "b", "PLAN_LIMIT_EXCEEDED"], 4: ["PLAN_REQUEST_REFUSED"]}


@pytest.mark.parametrize("files", [1, 5])
def test_ready_tasks_whatever_the_batches(spark, tmp_path, files):
    r = random.Random(files)
    edges = [(p, i, d) for p in range(20) for i in range(1, 7) for d in r.sample(range(i), min(i, 2))]
    done = [(p, r.randint(0, 6)) for p in range(20) for _ in range(8)]
    for f in range(files):
        spark.createDataFrame(done[f::files], "plan_id long, i long").coalesce(1).write.mode("append").parquet(str(tmp_path / "done"))
    stream = spark.readStream.schema("plan_id long, i long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "done"))
    query = ready_tasks(stream, spark.createDataFrame(edges, "plan_id long, i long, dep long")).writeStream.outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "progress")).format("parquet").option("path", str(tmp_path / "ready")).start().awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "ready")).collect())
    have = set(done)
    tasks = {(p, i) for p, i, _ in edges}
    assert got == sorted(t for t in tasks if all((p, d) in have for p, i, d in edges if (p, i) == t))


def test_tasks_of_one_dependency_need_no_python_state(spark, tmp_path):
    spark.createDataFrame([(1, 0), (1, 0), (1, 1), (1, 2)], "plan_id long, i long").coalesce(1).write.parquet(str(tmp_path / "done"))
    edges = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 4, 3)], "plan_id long, i long, dep long")
    query = ready_tasks(spark.readStream.schema("plan_id long, i long").parquet(str(tmp_path / "done")), edges).writeStream.outputMode("append").trigger(availableNow=True)
    run = query.option("checkpointLocation", str(tmp_path / "progress")).format("parquet").option("path", str(tmp_path / "ready")).start()
    run.awaitTermination()
    held = {}
    for p in run.recentProgress:
        held |= {o["operatorName"]: max(o["numRowsTotal"], held.get(o["operatorName"], 0)) for o in p["stateOperators"]}
    assert held == {"applyInPandasWithState": 1, "dedupe": 3}
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "ready")).collect()) == [(1, 1), (1, 2), (1, 3)]


def _declaration(**changes):
    base = {"name": "a", "kind": "capability", "connector": "db", "operation": "read", "connector_version": None, "input_schema_digest": "0" * 64, "output_schema_digest": "f" * 64, "policy_tags": ["x", "y"]}
    return {k: v for k, v in (base | changes).items() if v != "DROP"}


def test_declaration_defects(spark):
    b = _declaration(name="b")
    cases = [
        ("[]", None), ("{}", (None, "NOT_AN_ARRAY")), (None, (None, "NOT_AN_ARRAY")), ([_declaration(), b], None), ([b, _declaration()], (None, "NOT_CANONICAL")), ([_declaration(), _declaration()], (1, "DUPLICATE_NAME")), ([1], (0, "NOT_AN_OBJECT")),
        ([_declaration(kind="effect")], (0, "KIND")), ([_declaration(kind="DROP")], (0, "KIND")), ([_declaration(connector="DROP")], (0, "FIELDS")), ([_declaration(more=1)], (0, "FIELDS")), ([_declaration(name="7")], (0, "name")),
        ([_declaration(), _declaration(name="b", operation="a b")], (1, "operation")), ([_declaration(connector_version=" ")], (0, "connector_version")), ([_declaration(output_schema_digest="F" * 64)], (0, "output_schema_digest")),
        ([_declaration(policy_tags=["y", "x"])], (0, "policy_tags")), ([_declaration(policy_tags=["x", None])], (0, "policy_tags")), ([_declaration(policy_tags="x")], (0, "policy_tags")), ([_declaration(policy_tags=[])], None),
    ]
    rows = [(k, x if x is None or isinstance(x, str) else json.dumps(x)) for k, (x, _) in enumerate(cases)]
    got = de.declaration_defects(spark.createDataFrame(rows, "k int, t string"), ["k"], "t", "capability").collect()
    assert {r["k"]: (r["place"], r["defect"]) for r in got} == {k: want for k, (_, want) in enumerate(cases) if want}
    effect = _declaration(kind="effect", idempotency="none", approval_required=True)
    rows = [(0, json.dumps([effect])), (1, json.dumps([effect | {"idempotency": "maybe"}])), (2, json.dumps([effect | {"approval_required": 1}]))]
    got = de.declaration_defects(spark.createDataFrame(rows, "k int, t string"), ["k"], "t", "effect").collect()
    assert {r["k"]: r["defect"] for r in got} == {1: "idempotency", 2: "approval_required"}


def test_requests_and_decisions(spark):
    whole = {c: "x" for c in de.REQUEST}
    requests = {json.dumps(whole): None, json.dumps(whole | {"run_id": 1}): "NOT_TEXT", json.dumps(whole | {"more": "x"}): "FIELDS", "[]": "FIELDS", "no": "FIELDS"}
    rows = spark.createDataFrame([(t,) for t in requests], "t string").select("t", de.request_defect(F.try_parse_json("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == requests
    good = {"allowed": True, "policy_id": "p", "reason_code": "ok"}
    decisions = [(good, None), (good | {"approval": None}, None), (good | {"allowed": 1}, "allowed"), (good | {"policy_id": ""}, "policy_id"), (good | {"reason_code": "a\n"}, "reason_code"), (good | {"approval": {"request_id": "r", "command_id": "c"}}, None), (good | {"approval": {"request_id": "r"}}, "approval"), (good | {"approval": 1, "allowed": 1}, "approval"), ([], "NOT_AN_OBJECT")]
    table = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in enumerate(decisions)], "k int, t string").select("k", de.decision_defect(F.try_parse_json("t")).alias("d"))
    assert {r["k"]: r["d"] for r in table.collect()} == {k: d for k, (_, d) in enumerate(decisions)}


def test_equal_texts_are_judged_once(spark):
    from planlens.operators import declarations as de
    from planlens.plans import bindings as bi

    seen = []

    def told(texts):
        seen.append(texts.count())
        return de.declaration_defects(texts, ["text_id"], "t", "effect")

    rows = [(k, ("[]", "{}", None, '[{"kind":"x"}]', "")[k % 5]) for k in range(500)]
    got = {r["k"]: (r["place"], r["defect"]) for r in bi.of_texts(spark.createDataFrame(rows, "k long, t string"), ["k"], "t", told).collect()}
    want = {1: (None, "NOT_AN_ARRAY"), 2: (None, "NOT_AN_ARRAY"), 3: (0, "KIND"), 4: (None, "NOT_AN_ARRAY")}
    assert seen == [5] and got == {k: want[k % 5] for k, _ in rows if k % 5}
