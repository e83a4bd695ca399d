"""Canonical texts and plan documents against Python's own JSON and a plain walk."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from planlens import queries as base
from planlens.document_queries import choices_of, documents_of, regions_of
from planlens.functions.canonical import canonical
from planlens.functions.expressions import canonical_json
from planlens.plans import documents as do
from planlens.plans import texts as tx
from planlens.plans.bridge import Bridge
from planlens.plans.metrics import analyse


def test_numbers(spark):
    r = random.Random(1)
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-5, 1e16, 1e15, 123456789012345680.0, 2e-3, 2.0**-44, 2e23, 1e23, 1e-4, 1.1e-4, 100.0, 1234567.0, 9007199254740993.0, 2 / 3, 1.7976931348623157e308]
    numbers += [round(r.uniform(-1e4, 1e4), r.randint(0, 6)) * 10.0 ** r.randint(-8, 10) for _ in range(3_000)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    for x, text in rows.select("x", canonical(F.col("x"), rows.schema["x"].dataType)).collect():
        assert float(text) == x and text == canonical_json(x)
    odd = spark.createDataFrame([(float("nan"), [1.0]), (1.0, [float("inf")]), (1.0, [None])], "x double, l array<double>")
    assert [r[0] for r in odd.select(canonical(F.struct("x", "l"), odd.schema)).collect()] == [None, None, '{"l":[null],"x":1.0}']


def test_texts_and_nesting(spark):
    schema = "a struct<b:string,`a\"`:array<double>,z:map<string,bigint>>, y boolean, bin binary"
    rows = [(("".join(map(chr, range(40))) + '"\\é😀\x7f', [1.5, None], {"b": 1, "a": None, "é": 2}), True, b"\x01\xff"), (None, None, None), (("x", [], {}), False, b"")]
    table = spark.createDataFrame(rows, schema)
    got = [r[0] for r in table.select(canonical(F.struct(*table.columns), table.schema)).collect()]
    assert got == [canonical_json({"a": a and {"b": a[0], 'a"': a[1], "z": a[2]}, "y": y, "bin": x}) for a, y, x in rows]
    with pytest.raises(TypeError):
        canonical(F.current_date(), spark.range(1).select(F.current_date().alias("d")).schema["d"].dataType)


def test_order_is_that_of_a_walk(spark):
    r = random.Random(3)
    rows, want = [], {}
    for plan in range(60):
        keys = [f"k{x:02d}" for x in r.sample(range(100), r.randint(1, 14))]
        deps = {k: ["$input"] if not j or r.random() < 0.2 else [r.choice(keys[:j]) for _ in range(r.randint(1, 4))] for j, k in enumerate(keys)}
        if plan % 10 == 9 and len(keys) > 2:
            deps[keys[0]] = [keys[-1]]
            deps[keys[-1]] = [keys[0]]
        rows += [(plan, k, deps[k]) for k in keys]
        found = analyse(sorted(keys), deps, {})
        want |= {(plan, k): j for j, k in enumerate(found["order"])}
    got = do.topological_labels(spark.createDataFrame(rows, "plan_id long, key string, dependencies array<string>")).collect()
    assert {(r["plan_id"], r["key"]): r["position"] for r in got} == want


def test_deep_chain(spark):
    rows = [(1, f"n{k:05d}", ["$input"] if k == 0 else [f"n{k - 1:05d}"]) for k in range(200)]
    got = do.topological_labels(spark.createDataFrame(rows, "plan_id long, key string, dependencies array<string>"))
    assert [r["key"] for r in got.orderBy("position").collect()] == [k for _, k, _ in rows]


@pytest.fixture(scope="module")
def stored(spark, data):
    b = Bridge(spark, data)
    choices = choices_of(b)
    return choices, regions_of(b), do.build(choices, regions_of(b)).limit(40).cache()


def test_one_changed_byte_is_found(spark, stored):
    choices, _, plans = stored
    r = random.Random(5)

    def changed(text):
        k = r.randrange(len(text))
        return text[:k] + ("x" if text[k] != "x" else "y") + text[k + 1 :]

    rows = [(p["plan_id"], changed(p["plan"]) if p["plan_id"] % 2 else p["plan"]) for p in plans.collect()]
    rows += [(-1, None), (-2, "not json"), (-3, "{}")]
    got = {x["plan_id"]: x["code"] for x in do.inconsistent(spark.createDataFrame(rows, "plan_id long, plan string"), choices.schema).collect()}
    # a byte of a digest that nothing is derived from, as an output schema's, is a choice of its own
    free = {p for p, code in got.items() if p > 0 and p % 2 and code is None}
    assert all(code == (None if p % 2 == 0 and p >= 0 else do.INVALID) for p, code in got.items() if p not in free)
    assert len(free) < 0.6 * sum(p % 2 for p, _ in rows if p > 0)
    trusted = {x["plan_id"]: x["code"] for x in do.revalidated(spark.createDataFrame(rows, "plan_id long, plan string"), stored[0], stored[1]).collect()}
    assert all((code is None) == (p >= 0 and p % 2 == 0) for p, code in trusted.items())


def test_choices_come_back(stored):
    choices, regions, plans = stored
    ids = [r["plan_id"] for r in plans.select("plan_id").collect()]
    nodes, back = do.derived_choices(plans, choices.schema)
    columns = ["plan_id", *do.CHOICE]
    assert sorted(map(repr, nodes.select(columns).collect())) == sorted(map(repr, choices.filter(F.col("plan_id").isin(ids)).select(columns).collect()))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, regions.filter(F.col("plan_id").isin(ids)).select(back.columns).collect()))


def test_written_parts_come_back_as_texts(stored):
    choices, _, plans = stored
    columns = ("budget", "key", "effects", "execution")
    got = do.derived_choices(plans, choices.schema, columns, columns[::2])[0]
    values = do.derived_choices(plans, choices.schema)[0].select("plan_id", *(canonical(F.col(c), choices.schema[c].dataType).alias(c) if c in ("budget", "effects") else c for c in columns))
    assert got.columns == values.columns and sorted(map(repr, got.collect())) == sorted(map(repr, values.collect()))


def test_broken_graphs_have_no_document(spark, stored):
    choices, regions, _ = stored
    one = choices.filter(F.col("plan_id") == choices.first()["plan_id"])
    lost = one.withColumn("dependencies", F.when(F.col("key") == "n0001", F.array(F.lit("n9999"))).otherwise(F.col("dependencies")))
    ring = one.withColumn("dependencies", F.when(F.col("key") == "n0001", F.array(F.lit("n0001"))).otherwise(F.col("dependencies")))
    for broken in (lost, ring):
        assert [r["plan"] for r in do.build(broken, regions).collect()] == [None]
    assert do.build(choices.limit(0), regions).count() == 0


def test_texts_are_dealt_once_and_never_sorted(spark, data):
    plan = documents_of(Bridge(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan


def test_large_plans_have_the_same_texts(spark, stored, monkeypatch):
    choices, regions, plans = stored
    ids = [r["plan_id"] for r in plans.select("plan_id").limit(12).collect()]
    some = choices.filter(F.col("plan_id").isin(ids))
    few = {r["plan_id"]: r["plan"] for r in do.build(some, regions).collect()}
    monkeypatch.setattr(do, "sizes_above", lambda rows: rows.groupBy("plan_id").count().filter("count > 3").select("plan_id"))
    assert {r["plan_id"]: r["plan"] for r in do.build(some, regions).collect()} == few and len(few) == 12


def test_repeated_and_lacking_steps_are_inconsistent(spark, stored):
    choices, _, plans = stored
    text = plans.first()["plan"]
    steps = text[text.index('"steps":[') + 9 : text.index(',{"budget":null')]
    rows = [(1, text), (2, text.replace(steps, steps + "," + steps)), (3, text.replace(steps + ",", ""))]
    got = do.inconsistent(spark.createDataFrame(rows, "plan_id long, plan string"), choices.schema).collect()
    assert {r["plan_id"]: r["code"] for r in got} == {1: None, 2: do.INVALID, 3: do.INVALID}


@pytest.mark.parametrize("name", ["g15_inconsistent_plans", "v07_revalidated_plans", "g06_derived_choices", "g05_plan_documents"])
def test_texts_are_made_by_workers_in_one_pass(spark, data, name, monkeypatch):
    monkeypatch.setattr(do.Scratch, "save", lambda *_, **__: pytest.fail("a table is written before the result"))
    plan = base.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "from_json" not in plan
    assert "lambdafunction" not in plan[plan.index("MapInArrow") :]  # what is done for each node before a text is read


def test_nodes_and_choices_have_the_same_texts(spark, data):
    b = Bridge(spark, data)
    got = {r["plan_id"]: r["plan"] for r in documents_of(b).collect()}
    assert got == {r["plan_id"]: r["plan"] for r in do.build(choices_of(b), regions_of(b)).collect()} and None not in got.values()


def test_batches_end_with_a_plan():
    rows = [k for k in range(40) for _ in range(1 + k * 7 % 11)] + [None] * 3
    for size in (1, 2, 5, 300):
        batches = pa.table({"plan_id": pa.array(rows, pa.int64()), "j": range(len(rows))}).to_batches(max_chunksize=size)
        found = [(plan_id, batch.column("j").to_pylist()[start:end]) for batch in do.whole_plans(batches) for plan_id, start, end in do.places(batch)]
        assert [p for p, _ in found] == [*range(40), None] and [j for _, js in found for j in js] == list(range(len(rows)))


def struct(**kinds):
    return StructType([StructField(n, k) for n, k in kinds.items()])


KINDS = [
    struct(cpu=LongType()), ArrayType(struct(name=StringType(), policy=StringType())), MapType(StringType(), ArrayType(BooleanType())),
    ArrayType(struct(model=StringType())), struct(cost_usd=DoubleType(), tool_calls=IntegerType()),
]


def a_plan(r, size):
    """A plan with odd names, its text, and the values that it was written from."""
    name = lambda: "".join(r.choice('ab"\\\n\x01é😀,:{}[]') for _ in range(r.randint(0, 4)))
    keys = [f"{k}{name()}" for k in range(size)]
    choices = []
    for k, key in enumerate(keys):
        deps = tuple(r.choice(keys[:k]) for _ in range(r.randint(1, 3))) if k and r.random() < 0.8 else (do.INPUT,)
        values = (
            r.choice([None, {"cpu": r.choice([None, -3, 2**63 - 1])}]), [{"name": name(), "policy": r.choice([None, name()])} for _ in range(r.randint(0, 2))], {name(): [r.choice([True, False, None])] for _ in range(2)},
            r.choice([None, [], [{"model": name()}]]), {"cost_usd": r.choice([None, 1e16, 1e-7, -0.0, 0.1]), "tool_calls": r.choice([None, 7])},
        )
        choices.append((key, deps, tuple(name() for _ in deps), name(), name(), name(), *values))
    region = name(), name(), tuple(keys[-1:]), (name(),)
    return tx.plan_text(region, written(choices)), choices, region


def written(choices):
    return [(*c[:6], *(tx.writer(k)(v) for k, v in zip(KINDS, c[6:], strict=True)), tx._stated(c[-1])) for c in choices]


def judged_plainly(text):
    """The same by parsing all of a text."""
    choices, region = tx._parsed(text)
    try:
        return all(type(x) is str for c in choices for x in (c[0], *c[3:6])) and bool(choices) and tx.plan_text(region, written(choices)) == text
    except (ValueError, TypeError, AttributeError):
        return False


def test_patterns_find_what_parsing_finds():
    r, reader = random.Random(11), tx.Reader(KINDS)
    for size in range(1, 60):
        text, choices, region = a_plan(r, 1 + size % 9)
        assert reader.consistent(text) and judged_plainly(text)
        steps = json.loads(text)["steps"][:-1]
        assert reader.document(text) == (sorted(choices, key=lambda c: [s["control"]["key"] for s in steps].index(c[0])), region)
        for _ in range(60):
            k = r.randrange(len(text))
            other = text[:k] + r.choice(['x', '"', "\\", "", "1", "null", ",", " "]) + text[k + r.randint(0, 2) :]
            assert reader.consistent(other) == judged_plainly(other)


def test_values_of_another_type_are_inconsistent():
    reader = tx.Reader(KINDS)
    values = {"cpu": 1}, [], {}, [], {"cost_usd": 0.5, "tool_calls": 7}
    texts = [tx.writer(k)(v) for k, v in zip(KINDS, values, strict=True)]
    of = lambda k, text: tx.plan_text(("r", "s", ("a",), ("o",)), [("a", (do.INPUT,), ("s",), "o", "m", "d", *texts[:k], text, *texts[k + 1 :], True)])
    assert reader.consistent(of(0, texts[0]))
    for k, text in ((0, '{"cpu":9223372036854775808}'), (0, '{"cpu":1.0}'), (0, '{"cpu":01}'), (0, '{"cpu":1,"gpu":1}'), (0, "{}"), (1, "{}"), (4, '{"cost_usd":1,"tool_calls":7}'), (4, '{"cost_usd":0.50,"tool_calls":7}'), (4, '{"cost_usd":NaN,"tool_calls":7}'), (4, '{"cost_usd":1e400,"tool_calls":7}')):
        assert not reader.consistent(of(k, text)), text
    read = reader.document(of(4, '{"cost_usd":1,"tool_calls":"7"}'))[0][0]
    assert read[-1] == {"cost_usd": 1.0, "tool_calls": None} and read[0] == "a"
    for budget, text in (('{"cost_usd":1,"tool_calls":"7"}', '{"cost_usd":1.0,"tool_calls":null}'), ('{"cost_usd":1e400,"tool_calls":7}', None), ('{"cost_usd":NaN,"tool_calls":7}', None)):
        assert tx.Reader(KINDS, ("budget",)).document(of(4, budget))[0][0][6:] == (*values[:4], text)
    for text in (None, "", "[" * 100_000, '{"steps":[null,1]}', of(0, texts[0]).replace('"m"', '"\\ud800"')):
        assert not reader.consistent(text) and reader.document(text)[1] is not None


def test_a_long_plan_takes_work_by_its_nodes():
    size = 20_000
    chain = [(f"n{k:05d}", (f"n{k - 1:05d}" if k else do.INPUT,), ("s",), "o", "m", "d", "null", "[]", "{}", "[]", "null", False) for k in range(size)]
    text = tx.plan_text(("r", "s", (chain[-1][0],), ("o",)), chain[::-1])
    assert [s["control"]["key"] for s in json.loads(text)["steps"][:-1]] == [c[0] for c in chain]
    assert tx.Reader(KINDS).consistent(text)
