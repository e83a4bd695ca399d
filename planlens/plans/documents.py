"""Plans as canonical documents: built from resolved choices, read back, checked against themselves and against a rebuilt one.

A document is one JSON text. Its executable steps stand in the order in which a
depth-first walk frees them: a step comes after the last of its dependencies,
and of steps freed together the smaller key comes first. Rows of nodes are dealt
by plan, and Python workers write and read a plan's text (``texts``). A plan's
nodes meet in one task, as its text does; its size is the only bound.

``choices`` has plan_id, key, dependencies (keys, or ``$input``), input_schemas
(digests, one for each dependency), output_schema, module_id, module_digest,
execution, capabilities, effects, models, budget (structs and arrays of structs).
``regions`` has plan_id, region_id, input_schema, outputs (keys), output_schemas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from planlens.functions.canonical import canonical, digest_of, let
from planlens.plans.doubling import ancestry
from planlens.plans.gathered import inside, sizes_above, walk
from planlens.plans.metrics import labelled
from planlens.plans.texts import CONTRACT, INPUT, Reader, plan_text, writer
from planlens.workspace import Scratch, ship_package

#: The codes of refusals.
INVALID, UNTRUSTED = "PLAN_SIGNATURE_INVALID", "PLAN_SIGNATURE_UNTRUSTED"
CHOICE = ("key", "dependencies", "input_schemas", "output_schema", "module_id", "module_digest", *CONTRACT)
REGION = ("region_id", "input_schema", "outputs", "output_schemas")
#: Characters of texts and rows after which a worker passes them on.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 4_096


def topological_labels(nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """plan_id, key, position (from 0) of nodes (plan_id, key, dependencies) in the order of a depth-first walk.

    Nodes on or behind a cycle or a missing node have no position and no row. Plans of few nodes are ordered in a row each.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "labels")
    large = scratch.save(sizes_above(nodes), "large")
    if large.isEmpty():
        return _few_labels(nodes)
    rest = nodes.join(large, "plan_id", "left_semi")
    links = rest.select("plan_id", F.col("key").alias("i"), F.explode("dependencies").alias("dep")).filter(F.col("dep") != INPUT)
    depths = ancestry(rest.select("plan_id", F.col("key").alias("i"), F.lit(0).alias("wall_time_ms")), links)
    many = labelled(rest.select("plan_id", "key", "dependencies").join(depths.select("plan_id", F.col("i").alias("key"), "depth"), ["plan_id", "key"]))
    return _few_labels(nodes.join(large, "plan_id", "left_anti")).unionByName(many)


def _few_labels(nodes: DataFrame) -> DataFrame:
    plans = nodes.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("key", "dependencies"))).alias("nodes"))
    ordered = plans.select("plan_id", F.transform("nodes", lambda n: n["key"]).alias("keys"), _walk("nodes").alias("order"))
    return ordered.select("plan_id", "keys", F.posexplode("order").alias("position", "k")).select("plan_id", F.get("keys", F.col("k") - 1).alias("key"), "position")


def _walk(nodes: str) -> Column:
    return let(inside(F.transform(nodes, lambda n: n["key"]), F.transform(nodes, lambda n: n["dependencies"]), INPUT), walk)


def whole_plans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that stand by plan (the first column), again as batches, none of which ends within a plan."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        if held and held[-1].column(0)[-1].as_py() != ids[0].as_py():
            yield pa.concat_batches(held)
            held = []
        ends = pc.run_end_encode(ids).run_ends
        last = ends[-2].as_py() if len(ends) > 1 else 0
        if last:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def places(batch: pa.RecordBatch) -> Iterator[tuple[object, int, int]]:
    """plan_id, first row and end of each plan of a batch."""
    runs, start = pc.run_end_encode(batch.column(0)), 0
    for plan_id, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        yield plan_id, start, end
        start = end


def _batches(rows: Iterable[tuple], schema: pa.Schema, texts: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``texts`` of their last columns are long."""
    held, chars = [], 0
    made = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        chars += sum([len(t) for t in row[len(row) - texts :] if t is not None])
        if chars >= BATCH_CHARS or len(held) >= BATCH_ROWS:
            yield made()
            held, chars = [], 0
    if held:
        yield made()


def texts(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterable[tuple]], names: tuple[str, ...] = ("plan",)) -> DataFrame:
    """plan_id and texts of these names, as ``read`` makes them of whole plans' rows.

    ``rows`` (plan_id first) are dealt by plan already; only they are sorted, so texts are never shuffled or sorted.
    """
    ship_package(rows.sparkSession)
    schema = StructType([rows.schema[0], *(StructField(n, StringType()) for n in names)])
    arrow, n = to_arrow_schema(schema), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for batch in whole_plans(batches) for row in read(batch)), arrow, n)

    return rows.sortWithinPartitions(rows.columns[0]).mapInArrow(run, schema)


def _stated(budget: Column, kind: StructType) -> Column:
    """Whether a budget states any limit."""
    out = F.lit(False)
    for f in kind.fields:
        out = out | budget.getField(f.name).isNotNull()
    return F.coalesce(out, F.lit(False))


def _built(batch: pa.RecordBatch) -> Iterator[tuple]:
    """plan_id, text of plans' rows: choices with canonical texts, and regions."""
    tuples = lambda values: [v if v is None else tuple(v) for v in values]
    columns = {c: batch.column(c).to_pylist() for c in (*CHOICE, "stated")}
    choices = list(zip(*(tuples(v) if c in ("dependencies", "input_schemas") else v for c, v in columns.items()), strict=True))
    regions = list(zip(*(batch.column(c).to_pylist() for c in REGION), strict=True))
    kinds = batch.column("is_region").to_pylist()
    for plan_id, start, end in places(batch):
        own = [choices[j] for j in range(start, end) if not kinds[j]]
        for j in range(start, end) if own else ():
            if kinds[j]:
                yield plan_id, plan_text(regions[j], own)


def build(choices: DataFrame, regions: DataFrame) -> DataFrame:
    """plan_id, plan (canonical text), plan_digest. A plan with a cycle or a missing dependency has a null text."""
    kinds = choices.schema
    written = (canonical(F.col(c), kinds[c].dataType).alias(c) for c in CONTRACT)
    nodes = choices.select("plan_id", *CHOICE[:6], *written, _stated(F.col("budget"), kinds["budget"].dataType).alias("stated"), F.lit(False).alias("is_region"))
    both = nodes.unionByName(regions.select("plan_id", *REGION, F.lit(True).alias("is_region")), allowMissingColumns=True)
    made = texts(both.filter("plan_id is not null").repartition("plan_id"), _built)
    return made.withColumn("plan_digest", digest_of(F.col("plan")))


def _reread(plans: DataFrame, kinds: list[DataType], read: Callable[[Reader, object, str | None], Iterable[tuple]], schema: StructType, written: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``read`` makes of each text of ``plans`` (plan_id, plan)."""
    ship_package(plans.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kinds, written)
        pairs = (pair for batch in batches for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return _batches((row for plan_id, text in pairs for row in read(reader, plan_id, text)), arrow)

    return plans.select("plan_id", "plan").mapInArrow(run, schema)


def derived_choices(plans: DataFrame, choices: StructType, columns: tuple[str, ...] = CHOICE, written: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The choices (these columns of them) and regions that texts were built from; ``written`` names what of CONTRACT is given as canonical texts."""
    text, several, kinds = StringType(), ArrayType(StringType()), [choices[c].dataType for c in CONTRACT]
    of = lambda names, types: StructType([plans.schema["plan_id"], *(StructField(n, k) for n, k in zip(names, types, strict=True))])
    types = dict(zip(CHOICE, [text, several, several, text, text, text, *(text if c in written else k for c, k in zip(CONTRACT, kinds, strict=True))], strict=True))
    chosen = [CHOICE.index(c) for c in columns]
    nodes = _reread(plans, kinds, lambda r, plan_id, plan: ((plan_id, *[c[k] for k in chosen]) for c in r.document(plan)[0]), of(columns, [types[c] for c in columns]), written)
    return nodes, _reread(plans, kinds, lambda r, plan_id, plan: [(plan_id, *r.document(plan)[1])], of(REGION, [text, text, several, several]))


def inconsistent(plans: DataFrame, choices: StructType) -> DataFrame:
    """plan_id, code: INVALID for each text that isn't what its own choices give, else null.

    Choices are derived from the text and the plan is built again from them: a
    changed definition digest, address, binding, output node or any byte that no
    choice explains makes the texts differ, and so does a text that isn't a plan.
    A text is judged in its row, whatever its size.
    """
    kinds = [choices[c].dataType for c in CONTRACT]
    for kind in kinds:
        writer(kind)  # types without a canonical form are refused before any task
    code = StructType([plans.schema["plan_id"], StructField("code", StringType())])
    return _reread(plans, kinds, lambda r, plan_id, plan: [(plan_id, None if r.consistent(plan) else INVALID)], code)


def judged(plans: DataFrame, now: str = "now") -> DataFrame:
    """plan_id, code: UNTRUSTED for each stored text (``plan``) that differs from the one beside it, or is none, else null."""
    return plans.select("plan_id", F.when(~F.col("plan").eqNullSafe(F.col(now)) | F.col("plan").isNull(), UNTRUSTED).alias("code"))


def revalidated(stored: DataFrame, choices: DataFrame, regions: DataFrame) -> DataFrame:
    """plan_id, code: UNTRUSTED for each stored text that differs from the plan built from what is trusted now, else null."""
    now = build(choices, regions).select("plan_id", F.col("plan").alias("now"))
    return judged(stored.join(now, "plan_id", "left"))
