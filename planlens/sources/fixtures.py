"""Plans as JSON documents with digests: export, load, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "array<struct<dependencies:array<int>,i:int,module_id:string>>"


def documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, body, digest: each plan as one JSON text with sorted fields."""
    deps = edges.groupBy("plan_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "dep"))), lambda x: x["dep"]).alias("dependencies"))
    node = F.struct("i", F.struct("dependencies", "i", "module_id").alias("n"))
    listed = nodes.join(deps, ["plan_id", "i"]).groupBy("plan_id").agg(F.transform(F.sort_array(F.collect_list(node)), lambda x: x["n"]).alias("nodes"))
    body = F.to_json(F.struct("nodes", "plan_id"))
    return listed.select("plan_id", body.alias("body")).withColumn("digest", F.sha2("body", 256))


def save(plans: DataFrame, path: str) -> None:
    """One line for each plan: its digest, a tab, its body."""
    plans.select(F.concat_ws("\t", "digest", "body").alias("value")).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """plan_id, nodes, digest, intact; a digest stored twice is one plan."""
    lines = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).select(F.get("p", F.lit(0)).alias("digest"), F.get("p", F.lit(1)).alias("body"))
    parsed = lines.select("digest", (F.sha2("body", 256) == F.col("digest")).alias("intact"), F.from_json("body", f"nodes {NODES}, plan_id bigint").alias("v"))
    return parsed.select("v.plan_id", "v.nodes", "digest", "intact").dropDuplicates(["digest"])
