"""Queries over a catalog of pinned functions and templates; see ``queries``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.functions.registry import Catalog, Module
from planlens.functions.registry import applied as apply_module
from planlens.functions.registry import resolved
from planlens.plans.bridge import Bridge
from planlens.queries import query


@dataclass(frozen=True)
class Marked:
    mark: str
    times: int = 2


CATALOG = Catalog({
    "reversed_text": Module("text.reverse", "1", "STRING", "STRING", "reverse(x)"),
    "upper_text": Module("text.upper", "1", "STRING", "STRING", "upper(x)"),
    "marked_text": Module("text.mark", "2", "STRING", "STRING", "concat(repeat(config.mark, CAST(config.times AS INT)), x)", Marked),
})
_DIGESTS_SQL = """CASE turn WHEN 0 THEN sha256('{"body":"reverse(x)","config":{},"input":"STRING","module_id":"text.reverse","output":"STRING","version":"1"}')
 WHEN 1 THEN CASE WHEN i % 2 = 0 THEN sha256('{"body":"upper(x)","config":{},"input":"STRING","module_id":"text.upper","output":"STRING","version":"1"}') END
 WHEN 2 THEN CASE WHEN i % 3 <> 0 THEN sha256('{"body":"concat(repeat(config.mark, CAST(config.times AS INT)), x)","config":{"mark":"' || module_id || '","times":' || CASE WHEN i % 3 = 1 THEN i ELSE 2 END
 || '},"input":"STRING","module_id":"text.mark","output":"STRING","version":"2"}') END END"""


@query("k06_pinned_modules", f"""SELECT plan_id, i, digest, CASE WHEN turn = 3 THEN 'NOT_REGISTERED' WHEN turn = 1 AND i % 2 = 1 THEN 'CONFIG_NOT_ACCEPTED' WHEN turn = 2 AND i % 3 = 0 THEN 'CONFIG_INVALID'
 WHEN p_size % 5 = 0 THEN 'DIGEST_MISMATCH' END AS defect FROM (SELECT plan_id, i, p_size, turn, {_DIGESTS_SQL} AS digest FROM (SELECT *, p_size % 4 AS turn FROM node))""")  # fmt: skip
def pinned_modules(b: Bridge) -> DataFrame:
    """A request of each node for one of four aliases; a fifth pins a digest that no module has."""
    turn, i = F.col("p_size") % 4, F.col("i")
    alias = F.get(F.array(*map(F.lit, ("reversed_text", "upper_text", "marked_text", "lower_text"))), turn.cast("int"))
    mark = F.to_json(F.struct(F.col("module_id").alias("mark"), F.when(i % 3 == 1, i).alias("times")))
    config = F.when((turn == 1) & (i % 2 == 1), '{"times":1}').when((turn == 1), "{}").when(turn == 2, F.when(i % 3 == 0, '{"mark":7}').otherwise(mark))
    requests = b.node.select("plan_id", "i", alias.alias("alias"), F.when(F.col("p_size") % 5 == 0, F.sha2(F.lit("another"), 256)).alias("pin"), config.alias("config"))
    return resolved(requests, CATALOG).select("plan_id", "i", "digest", "defect")


@query("k05_template_results", """SELECT event_id, CASE WHEN k % 4 < 3 AND event_type IS NOT NULL THEN repeat(event_type, CASE k % 4 WHEN 0 THEN 2 ELSE CAST(k % 4 AS INTEGER) END) || payload END AS result, reverse(payload) AS plain
 FROM (SELECT *, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM event)""")  # fmt: skip
def template_results(b: Bridge) -> DataFrame:
    """A template with the configuration of each row, one in four with a field it hasn't, beside a pinned function called by SQL."""
    k = F.get_json_object("payload", "$.k").cast("long")
    config = F.to_json(F.struct(F.col("event_type").alias("mark"), F.when(k % 4 != 0, k % 4).alias("times"), F.when(k % 4 == 3, 1).alias("more")))
    CATALOG.install(b.spark, {"reversed_text": CATALOG.modules["reversed_text"].digest()})
    rows = b.event.select("event_id", F.col("payload").alias("x"), config.alias("config"))
    return apply_module(rows, CATALOG.modules["marked_text"]).select("event_id", "result", F.expr("reversed_text(x)").alias("plain"))
