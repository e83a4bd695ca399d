"""Replay fixtures: refusals, export by tasks and commit, and the gates of a bundle that is read back."""

import json

import pytest
from pyspark.sql import functions as F

from planlens.functions import expressions
from planlens.sources import bundles
from planlens.workspace import BATCH_BYTES, BATCH_SETTING


def frames(spark, runs):
    nodes = [(r, i, f"m{i}", "d" * 64, None if i == 2 else i) for r in range(1, 7) for i in (1, 2, 3) if r != 5]
    edges = [(r, i, 0, i - 1) for r, i, *_ in nodes] + [(r, 3, 1, 1) for r, i, *_ in nodes if i == 3]
    accepted = [(r, i) for r, i, *_ in nodes if (r, i) != (4, 2)]
    return (
        spark.createDataFrame(runs, "run_id long, tenant_id long, status string"), spark.createDataFrame(nodes, "plan_id long, i int, module_id string, module_digest string, tool_calls long"),
        spark.createDataFrame(edges, "plan_id long, i int, position int, dep int"), spark.createDataFrame(accepted + accepted[:1], "plan_id long, i int"),
    )


RUNS = [(1, 7, "SUCCEEDED"), (2, None, "SUCCEEDED"), (3, 7, "PAUSED"), (4, 7, "SUCCEEDED"), (5, 7, "SUCCEEDED"), (6, 7, "FAILED"), (8, 7, None)]


@pytest.fixture(scope="module")
def made(spark):
    return bundles.projected(*frames(spark, RUNS)).cache()


def test_refusals_and_texts(made):
    got = {r["run_id"]: r for r in made.collect()}
    assert {k: r["refusal"] for k, r in got.items()} == {1: None, 2: None, 3: "RUN_NOT_TERMINAL", 4: "HISTORY_INCOMPLETE", 5: "HISTORY_INCOMPLETE", 6: "RUN_NOT_SUCCESSFUL", 8: "RUN_NOT_SUCCESSFUL"}
    body = got[2]["body"]
    held = json.loads(body)
    assert body == json.dumps(held, sort_keys=True, separators=(",", ":")) and held["source"]["tenant_id"] is None
    assert [s["dependencies"] for s in held["accepted_steps"]] == [[0], [1], [2, 1]] and [s["tool_calls"] for s in held["accepted_steps"]] == [1, None, 3]


def test_round_trip_and_damage(spark, made, tmp_path):
    path = f"file://{tmp_path}/bundle"
    bundles.export(made.repartition(3), path)
    rows = {r["run_id"]: r for r in bundles.load(spark, path).collect()}
    assert set(rows) == {1, 2} and all(r["defect"] is None and r["steps"] == 3 for r in rows.values())
    with pytest.raises(Exception, match="already exists"):
        bundles.export(made, path)
    # a part of a task that ran twice isn't named, so it isn't read
    parts = sorted((tmp_path / "bundle/parts").glob("*.txt"), key=lambda p: p.stat().st_size)
    (tmp_path / "bundle/parts/stray.txt").write_bytes(parts[-1].read_bytes())
    assert bundles.load(spark, path).count() == 2
    # a repeated line, which is right in itself
    parts[-1].write_bytes(parts[-1].read_bytes() * 2)
    for crc in parts[-1].parent.glob(".*.crc"):
        crc.unlink()
    assert [r["name"] for r in bundles.damaged_parts(spark, path).collect()] == [parts[-1].name]
    assert bundles.load(spark, path).filter("defect = 'ARTIFACT_INTEGRITY'").count() >= 2


def test_gates_of_the_manifest(spark, made, tmp_path):
    path, manifest = f"file://{tmp_path}/bundle", tmp_path / "bundle/manifest.json"
    with pytest.raises(ValueError, match="TRACE_NOT_REPLAYABLE"):
        bundles.load(spark, path)
    bundles.export(made.filter("run_id = 3"), path)
    assert bundles.load(spark, path).count() == 0
    whole = manifest.read_text()
    for text, code in ((whole + " ", "FIXTURE_INVALID"), ("{", "FIXTURE_INVALID"), ("[]", "FIXTURE_INVALID"), (whole.replace("0.2.0", "9"), "FIXTURE_VERSION_UNSUPPORTED")):
        manifest.write_text(text)
        with pytest.raises(ValueError, match=code):
            bundles.load(spark, path)


def test_a_failed_write_leaves_no_bundle(spark, made, tmp_path):
    path = f"file://{tmp_path}/bundle"
    broken = made.repartition(4).select(F.when(F.col("run_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("body")).cast("string").alias("body"))
    with pytest.raises(Exception, match="lost"):
        bundles.export(broken, path)
    with pytest.raises(ValueError, match="TRACE_NOT_REPLAYABLE"):
        bundles.load(spark, path)
    assert not list((tmp_path / "bundle").glob("manifest*"))


def test_first_gate_wins(spark, made):
    body = made.filter("run_id = 1").first()["body"]
    cases = {
        "not JSON": body[:-1], "not canonical": body.replace("{", "{ ", 1).replace("0.2.0", "9"), "version": body.replace("0.2.0", "9").replace('"m1"', '"m9"'), "fields": body.replace('"tenant_id":7', '"tenant_id":"7"'),
        "plan digest": body.replace('"m1"', '"m9"'), "derived graph": body.replace('"module_digest":"d', '"module_digest":"e', 1),
    }
    lines = spark.createDataFrame([("x", k, v) for k, v in cases.items()], "digest string, k string, body string")
    for k, _ in cases.items():
        (row,) = bundles.defects(lines.filter(F.col("k") == k)).collect()
        assert row["reason"] == k
    assert bundles.defects(spark.createDataFrame([("x", body), (None, None)], "digest string, body string")).select("reason").distinct().count() == 2


def test_only_texts_that_arent_made_again_go_to_python(spark, made):
    body = made.filter("run_id = 1").first()["body"]
    texts = {"whole": body, "version": body.replace("0.2.0", "9"), "plan": body.replace('"m1"', '"m9"'), "graph": body.replace('"module_digest":"d', '"module_digest":"e', 1), "blank": body.replace("{", "{ ", 1), "field": body.replace('"tenant_id":7', '"tenant_id":"7"'), "none": None}
    read = spark.sparkContext.accumulator(0)
    spark.conf.unset(BATCH_SETTING)

    @F.pandas_udf("string")
    def counted(texts):
        read.add(int(texts.notna().sum()))
        return texts.map(expressions._canonical_or_null)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(bundles, "canonical_text", counted)
        found = bundles.defects(spark.createDataFrame([("x", t) for t in texts.values()], "digest string, body string").coalesce(1)).collect()
    assert [r["reason"] for r in found] == ["digest", "version", "plan digest", "derived graph", "not canonical", "fields", "not JSON"] and read.value == 2
    bundles.defects(spark.createDataFrame([("x", body)], "digest string, body string"))
    assert spark.conf.get(BATCH_SETTING) == BATCH_BYTES
