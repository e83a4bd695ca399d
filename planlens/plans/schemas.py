"""Whether values of one schema may go where another is expected, over tables of schemas and of pairs.

A schema is a canonical JSON text. Its alternatives are itself and, if it has
``anyOf``, the alternatives of these, at any depth; they are made once for each
distinct schema, and each distinct pair is judged once, however many edges have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.workspace import Scratch

#: Python types that take anything.
ANYTHING = ("builtins.object", "typing.Any")


def alternatives(schemas: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """schema, alternative (texts) of distinct ``schemas`` (schema), in as many rounds as alternatives nest."""
    scratch = scratch or Scratch(schemas.sparkSession, "schemas")
    nested = F.expr("try_variant_get(try_parse_json(alternative), '$.anyOf', 'array<variant>')")
    new = scratch.save(schemas.select("schema", F.col("schema").alias("alternative")).distinct(), "round=0")
    k = 0
    while not new.isEmpty():
        k += 1
        opened = new.select("schema", F.explode(nested).alias("v"))
        kinds = F.expr("schema_of_variant(v)")
        new = scratch.save(opened.filter(kinds.startswith("OBJECT")).select("schema", F.to_json("v").alias("alternative")).distinct(), f"round={k}")
    return schemas.sparkSession.read.schema("schema string, alternative string").parquet(*(scratch.path(f"round={j}") for j in range(k + 1))).distinct()


def _at(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def compatible(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """source, target, compatible of distinct ``pairs`` (source, target) of canonical schema texts.

    A schema without any demand goes with all; equal ones go together; an integer
    is a number; a target with alternatives takes what one of them takes.
    """
    distinct = pairs.select("source", "target").distinct()
    options = alternatives(distinct.select(F.col("target").alias("schema")), scratch).withColumnRenamed("schema", "target")
    source, option = F.col("source"), F.col("alternative")
    takes = (
        (option == "{}") | (source == "{}") | (source == option) | F.coalesce(_at(option, "pythonType").isin(*ANYTHING), F.lit(False))
        | F.coalesce((_at(option, "type") == "number") & (_at(source, "type") == "integer"), F.lit(False))
    )
    return distinct.join(options, "target").groupBy("source", "target").agg(F.bool_or(takes).alias("compatible"))


def incompatible_edges(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows of ``edges`` (source, target, more columns) whose schemas don't go together."""
    bad = compatible(edges, scratch).filter(~F.col("compatible")).select("source", "target")
    return edges.join(bad, ["source", "target"], "left_semi")
