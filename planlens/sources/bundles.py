"""Replay fixtures of successful runs: refused, exported and read back behind gates.

A fixture is one canonical JSON text for a run: its plan with a digest, the
executed graph, the accepted steps and where it comes from. Many fixtures are one
bundle: tasks write parts of lines (digest, tab, text) under names of their own,
and the driver's commit writes the bundle's manifest last. What the manifest
doesn't name isn't part of the bundle, so a task that fails or runs twice leaves
nothing to read, and a bundle without a manifest is no bundle. The manifest holds
a row for each part: its name, its fixtures and a sum of their digests.

A plan's steps meet in one row, as its text does. Null texts are written by no
task. A bundle of no fixtures has a manifest without parts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from planlens.functions.canonical import canonical, digest_of, list_text, object_text, string_text
from planlens.functions.expressions import canonical_text
from planlens.workspace import ship_package

#: Version of fixtures without generated plans, kind of their source, states of runs that haven't ended, and the codes of refusals.
VERSION, KIND = "0.2.0", "native_workflow_run"
UNENDED = ("PENDING", "RUNNING", "PAUSED")
NOT_TERMINAL, NOT_SUCCESSFUL, INCOMPLETE = "RUN_NOT_TERMINAL", "RUN_NOT_SUCCESSFUL", "HISTORY_INCOMPLETE"
INVALID, UNSUPPORTED, DAMAGED, NO_BUNDLE = "FIXTURE_INVALID", "FIXTURE_VERSION_UNSUPPORTED", "ARTIFACT_INTEGRITY", "TRACE_NOT_REPLAYABLE"

LINES = "digest string, body string"
FIXTURE = """accepted_steps array<struct<dependencies:array<int>,i:int,module_digest:string,module_id:string,tool_calls:bigint>>,
 executed_graph array<struct<dependencies:array<int>,i:int,module_digest:string,module_id:string>>, source struct<kind:string,run_id:bigint,tenant_id:bigint>,
 version string, workflow struct<digest:string,ir:struct<nodes:array<struct<dependencies:array<int>,i:int,module_id:string>>>,workflow_id:string>"""
_KINDS = {"dependencies": ArrayType(IntegerType()), "i": IntegerType(), "module_digest": StringType(), "module_id": StringType(), "tool_calls": LongType()}


def _texts(steps: Column, *names: str) -> Column:
    """Steps as a list of objects of these fields."""
    one = lambda s: object_text(**{n: canonical(s[n], _KINDS[n]) for n in names})
    return list_text(F.transform(steps, one))


def projected(runs: DataFrame, nodes: DataFrame, edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """run_id, refusal, body of every run: its fixture, or the first reason why there is none.

    ``accepted`` has plan_id, i of the tasks with an accepted boundary. A run
    without tasks has no output and is incomplete.
    """
    deps = edges.groupBy("plan_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "dep"))), lambda x: x["dep"]).alias("dependencies"))
    steps = nodes.select("plan_id", "i", "module_digest", "module_id", "tool_calls").join(deps, ["plan_id", "i"], "left")
    return projected_rows(runs, steps.withColumn("after", F.lit(False)).unionByName(accepted.select("plan_id", "i", F.lit(True).alias("after")), allowMissingColumns=True))


def projected_rows(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """The same of ``rows`` that hold both sides: tasks (plan_id, i, dependencies, module_digest, module_id, tool_calls; ``after`` false) and accepted boundaries (plan_id, i; ``after`` true).

    Only the plan deals them, so rows that are dealt by plan stay where they are.
    """
    step = F.struct("i", "dependencies", "module_digest", "module_id", F.col("tool_calls").cast("long").alias("tool_calls"))
    ended = runs.filter("status = 'SUCCEEDED'").select(F.col("run_id").alias("plan_id"))
    graphs = rows.join(ended, "plan_id", "left_semi").groupBy(F.col("plan_id").alias("run_id")).agg(
        F.sort_array(F.collect_list(F.when(~F.col("after"), step))).alias("steps"), F.collect_set(F.when(F.col("after"), F.col("i"))).alias("accepted"))
    whole = (F.size(F.array_except(F.transform("steps", lambda s: s["i"]), "accepted")) == 0) & ~F.exists("steps", lambda s: s["dependencies"].isNull()) & (F.size("steps") > 0)
    joined = runs.select("run_id", "tenant_id", "status").join(graphs.select("run_id", "steps", whole.alias("whole")), "run_id", "left")
    refusal = (
        F.when(F.col("status").isin(*UNENDED), NOT_TERMINAL).when(~F.col("status").eqNullSafe("SUCCEEDED"), NOT_SUCCESSFUL)
        .when(~F.coalesce("whole", F.lit(False)), INCOMPLETE)
    )
    ready = joined.select("run_id", "tenant_id", "steps", refusal.alias("refusal")).withColumn("ir", object_text(nodes=_texts(F.col("steps"), "dependencies", "i", "module_id")))
    source = object_text(kind=string_text(F.lit(KIND)), run_id=F.col("run_id").cast("string"), tenant_id=F.coalesce(F.col("tenant_id").cast("string"), F.lit("null")))
    workflow = object_text(digest=string_text(digest_of(F.col("ir"))), ir=F.col("ir"), workflow_id=string_text(F.concat(F.lit("plan-"), F.col("run_id").cast("string"))))
    body = object_text(
        accepted_steps=_texts(F.col("steps"), "dependencies", "i", "module_digest", "module_id", "tool_calls"), executed_graph=_texts(F.col("steps"), "dependencies", "i", "module_digest", "module_id"),
        source=source, version=string_text(F.lit(VERSION)), workflow=workflow,
    )
    return ready.select("run_id", "refusal", F.when(F.col("refusal").isNull(), body).alias("body"))


def defects(lines: DataFrame) -> DataFrame:
    """run_id, steps, digest, defect, reason of every line (digest, body): the first gate that a fixture doesn't pass.

    Gates in order: JSON, canonical form, version, fields and types, digest of
    the plan, derived graph, digest of the whole. A fixture with an earlier
    defect than the last two has null in what couldn't be read.
    """
    read = lines.select("digest", "body", F.from_json("body", FIXTURE, {"mode": "PERMISSIVE"}).alias("v"))
    ir = object_text(nodes=_texts(F.col("v.workflow.ir.nodes"), "dependencies", "i", "module_id"))
    of = lambda *names: F.transform("v.accepted_steps", lambda s: F.struct(*(s[n].alias(n) for n in names)))
    workflow = object_text(digest=string_text(F.col("v.workflow.digest")), ir=ir, workflow_id=string_text(F.col("v.workflow.workflow_id")))
    source = object_text(kind=string_text(F.col("v.source.kind")), run_id=F.col("v.source.run_id").cast("string"), tenant_id=F.coalesce(F.col("v.source.tenant_id").cast("string"), F.lit("null")))
    again = object_text(
        accepted_steps=_texts(F.col("v.accepted_steps"), "dependencies", "i", "module_digest", "module_id", "tool_calls"), executed_graph=_texts(F.col("v.executed_graph"), "dependencies", "i", "module_digest", "module_id"),
        source=source, version=string_text(F.col("v.version")), workflow=workflow,
    )
    # a text that is made again from its values is canonical; only others are read by Python
    read = read.withColumn("same", F.coalesce(again == F.col("body"), F.lit(False)))
    read = read.withColumn("plain", canonical_text(F.when(~F.col("same"), F.col("body"))))
    read = read.withColumn("version", F.when(F.col("same"), F.col("v.version")).otherwise(F.get_json_object("plain", "$.version")))
    derived = F.col("v.executed_graph") == of("dependencies", "i", "module_digest", "module_id")
    gates = (
        (~F.col("same") & F.col("plain").isNull(), INVALID, "not JSON"),
        (~F.col("same") & (F.col("plain") != F.col("body")), INVALID, "not canonical"),
        (~F.col("version").eqNullSafe(VERSION), UNSUPPORTED, "version"),
        (~F.col("same"), INVALID, "fields"),
        (~digest_of(ir).eqNullSafe(F.col("v.workflow.digest")), INVALID, "plan digest"),
        (~derived.eqNullSafe(F.lit(True)), INVALID, "derived graph"),
        (~digest_of(F.col("body")).eqNullSafe(F.col("digest")), DAMAGED, "digest"),
    )
    first = F.coalesce(*(F.when(fails, F.struct(F.lit(code).alias("defect"), F.lit(reason).alias("reason"))) for fails, code, reason in gates))
    return read.select(F.col("v.source.run_id").alias("run_id"), F.size("v.accepted_steps").alias("steps"), "digest", first.alias("d")).select("run_id", "steps", "digest", "d.defect", "d.reason")


@dataclass
class Part(WriterCommitMessage):
    """A part that a task has written."""

    name: str
    fixtures: int
    digests: int


def _sum_of(digest: str) -> int:
    return int(digest[:12], 16)


def _file(store: fs.FileSystem, path: str, data: bytes) -> None:
    """The bytes under a hidden name first, then renamed."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(data)
    store.move(hidden, f"{folder}/{name}")


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        store, base = fs.FileSystem.from_uri(path)
        if store.get_file_info(f"{base}/manifest.json").type != fs.FileType.NotFound:
            raise ValueError(f"{INVALID}: output already exists: {path}")
        store.create_dir(f"{base}/parts", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, base = fs.FileSystem.from_uri(self.path)
        name, count, digests = f"{uuid.uuid4().hex}.txt", 0, 0
        with store.open_output_stream(f"{base}/parts/{name}") as out:
            for batch in iterator:
                for body in batch.column(batch.schema.get_field_index("body")).to_pylist():
                    if body is not None:
                        digest = hashlib.sha256(body.encode()).hexdigest()
                        out.write(f"{digest}\t{body}\n".encode())
                        count, digests = count + 1, digests + _sum_of(digest)
        return Part(name, count, digests)

    def commit(self, messages: list[Part | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        parts = [{"digests": str(m.digests), "fixtures": m.fixtures, "name": m.name} for m in sorted((m for m in messages if m), key=lambda m: m.name)]
        _file(store, f"{base}/manifest.json", json.dumps({"parts": parts, "version": VERSION}, sort_keys=True, separators=(",", ":")).encode())

    def abort(self, messages: list[Part | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{base}/parts/{m.name}")


class ReplayBundle(DataSource):
    """``frame.write.format("replay_bundle").mode("append").save(uri)`` of a frame with a text column ``body``."""

    @classmethod
    def name(cls) -> str:
        return "replay_bundle"

    def schema(self) -> str:
        return "body string"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"])


def export(fixtures: DataFrame, path: str) -> None:
    """Write the ``body`` of all rows as a new bundle at a URI; refused where one is."""
    spark = fixtures.sparkSession
    ship_package(spark)
    spark.dataSource.register(ReplayBundle)
    fixtures.filter("body is not null").select("body").write.format("replay_bundle").mode("append").save(path)


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """name, fixtures, digests of the parts that a bundle's manifest names; a ValueError with its code where there is none or it is of another version."""
    store, base = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{base}/manifest.json").type == fs.FileType.NotFound:
        raise ValueError(f"{NO_BUNDLE}: no manifest at {path}")
    with store.open_input_stream(f"{base}/manifest.json") as f:
        raw = f.read().decode()
    try:
        held = json.loads(raw)
        version, parts = held["version"], [(p["name"], p["fixtures"], p["digests"]) for p in held["parts"]]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"{INVALID}: manifest at {path}") from e
    if json.dumps(held, sort_keys=True, separators=(",", ":")) != raw:
        raise ValueError(f"{INVALID}: manifest isn't canonical at {path}")
    if version != VERSION:
        raise ValueError(f"{UNSUPPORTED}: {version}")
    return spark.createDataFrame(parts, "name string, fixtures long, digests string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """name (of the part), digest, body of all fixtures in parts that the manifest names."""
    named = parts_of(spark, path)
    value = F.split("value", "\t", 2)
    every = spark.read.schema("value string").text(f"{path}/parts").select(F.col("_metadata.file_name").alias("name"), F.get(value, F.lit(0)).alias("digest"), F.get(value, F.lit(1)).alias("body"))
    return every.join(named.select("name"), "name", "left_semi")


def damaged_parts(spark: SparkSession, path: str) -> DataFrame:
    """name of the parts that are missing or hold other fixtures than the manifest says."""
    amount = F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")
    found = lines(spark, path).groupBy("name").agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
    both = parts_of(spark, path).filter("fixtures > 0").join(found, "name", "left")
    return both.filter(~F.col("n").eqNullSafe(F.col("fixtures")) | ~F.col("total").eqNullSafe(F.col("digests").cast("decimal(38,0)"))).select("name")


def load(spark: SparkSession, path: str) -> DataFrame:
    """run_id, steps, digest, defect, reason of every fixture of a bundle; a fixture in a part that isn't as written is damaged."""
    odd = damaged_parts(spark, path).select("name", F.lit(True).alias("odd"))
    marked = lines(spark, path).join(odd, "name", "left")
    return defects(marked.select(F.when(F.col("odd"), F.lit(None)).otherwise(F.col("digest")).alias("digest"), "body"))
