"""Blob store, fixtures, and streams on small inputs."""

from pyspark.sql import functions as F

from planlens.sources import artifacts, fixtures
from planlens.streaming import log
from planlens.workspace import Scratch


def test_blobs(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    values = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),), (None,)], "content binary")
    assert artifacts.put(values, root).distinct().count() == 2
    assert artifacts.put(values, root).distinct().count() == 2
    got = artifacts.get(spark, root).collect()
    assert sorted(bytes(r["content"]) for r in got) == [b"one", b"two"] and all(r["intact"] for r in got)
    victim = next(p for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.startswith("."))
    victim.write_bytes(b"changed")
    assert sorted(r["intact"] for r in artifacts.get(spark, root).collect()) == [False, True]


def test_fixtures(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "plan_id long, i int, module_id string")
    edges = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1)], "plan_id long, i int, position int, dep int")
    path = f"file://{tmp_path}/plans"
    fixtures.save(fixtures.documents(nodes, edges), path)
    (row,) = fixtures.load(spark, path).collect()
    assert row["intact"] and [(n["i"], n["dependencies"], n["module_id"]) for n in row["nodes"]] == [(1, [0], "a"), (2, [1], "b")]
    spark.read.text(path).select(F.replace("value", F.lit('"a"'), F.lit('"x"')).alias("value")).write.text(f"{path}-tampered")
    assert not fixtures.load(spark, f"{path}-tampered").first()["intact"]


def test_run_states(spark, tmp_path):
    steps = ["RUN_STARTED", "TASK_READY", "RUN_PAUSED", "RUN_COMPLETED", "RUN_RESUMED", "RUN_FAILED", "RUN_STARTED"]
    rows = [(k, 7, t) for k, t in enumerate(steps)] + [(99, 8, "RUN_RESUMED")]
    events = spark.createDataFrame(rows, "event_id long, run_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/log/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/log/events.parquet")
    got = {r["run_id"]: (r["state"], r["steps"], r["refused"]) for r in log.catch_up(log.run_states(stream), Scratch(spark, "t"), "states", "update").collect()}
    assert got == {7: ("FAILED", 4, 2), 8: ("NEW", 0, 1)}


def test_tail_of_a_file_and_of_part_files(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/parts/events.parquet")
    for name, folder in (("parts", f"{tmp_path}/parts"), ("file", data)):
        stream = log.tail(spark, folder, "events.parquet", events.schema)
        assert log.catch_up(stream, Scratch(spark, name), "rows").count() == events.count() > 0
