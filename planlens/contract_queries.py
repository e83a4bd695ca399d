"""More registered queries: contracts, orders, evidence and sets; see ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlens.functions import authoring as au
from planlens.functions import expressions as fx
from planlens.operators import contracts as co
from planlens.operators import events as ev
from planlens.operators import ledger as lg
from planlens.plans import alignment as al
from planlens.plans.bridge import Bridge
from planlens.queries import query


@query("p04_literals", "SELECT event_id, 'fixed' AS label, 2.5 + value AS shifted FROM event")
def literals(b: Bridge) -> DataFrame:
    return b.event.select("event_id", F.lit("fixed").alias("label"), (F.lit(2.5) + F.col("value")).alias("shifted"))


@query("p05_tuples", "SELECT event_id, run_id AS first, event_type AS second FROM event")
def tuples(b: Bridge) -> DataFrame:
    pair = b.event.select("event_id", au.parallel(F.col("run_id"), F.col("event_type")).alias("t"))
    return pair.select("event_id", F.col("t._0").alias("first"), F.col("t._1").alias("second"))


@query("p08_executable_nodes", "SELECT plan_id, i, module_id FROM node WHERE module_id IS NOT NULL AND tool_calls IS NOT NULL")
def executable_nodes(b: Bridge) -> DataFrame:
    return b.node.filter(F.col("module_id").isNotNull() & F.col("tool_calls").isNotNull()).select("plan_id", "i", "module_id")


@query("p13_executor_supports", "SELECT p_partkey, coalesce(CASE WHEN p_size % 4 <> 0 THEN p_size END, -1) >= 10 AND coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size * 100 END, -1) >= 2000 AS supported FROM part")
def executor_supports(b: Bridge) -> DataFrame:
    cpu, memory = F.when(F.col("p_size") % 4 != 0, F.col("p_size")), F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 100)
    return b.table("part").select("p_partkey", co.executor_supports(cpu, memory, F.lit(10), F.lit(2000)).alias("supported"))


@query("p18_exact_fields", "SELECT event_id, event_id % 3 = 0 AS exact FROM event")
def exact_fields(b: Bridge) -> DataFrame:
    given = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("outputs"), F.lit("nodes"))).otherwise(F.array(F.lit("nodes")))
    return b.event.select("event_id", co.has_exactly(given, ("nodes", "outputs")).alias("exact"))


@query("p21_secret_keys", "SELECT event_id, event_id % 4 IN (0, 1) AS secret FROM event")
def secret_keys(b: Bridge) -> DataFrame:
    names = F.array(*map(F.lit, ("API-Key", "password", "model", "Tokens")))
    name = F.get(names, (F.col("event_id") % 4).cast("int"))
    nested = F.concat(F.lit('{"endpoint":[{"note":"token","options":{"'), name, F.lit('": 1}}],"payload":'), F.col("payload"), F.lit("}"))
    return b.event.select("event_id", fx.has_secret_key(nested).alias("secret"))


@query("p23_selectors", "SELECT plan_id, count(*) FILTER (effectful) = 1 AS resolved, count(*) FILTER (effectful) AS found FROM node GROUP BY plan_id")
def selectors(b: Bridge) -> DataFrame:
    return co.exactly_one(b.node, "plan_id", F.col("effectful"))


@query("p24_dropped_field", "SELECT event_id, run_id FROM event")
def dropped_field(b: Bridge) -> DataFrame:
    whole = b.event.select("event_id", F.struct("run_id", F.col("payload").alias("models")).alias("v"))
    return whole.select("event_id", F.col("v").dropFields("models").alias("v")).select("event_id", "v.*")


@query("p26_environment", "SELECT event_id, 'LANG,PATH' AS kept FROM event")
def environment(b: Bridge) -> DataFrame:
    held = F.create_map(*map(F.lit, ("PATH", "a", "SECRET_TOKEN", "b", "LANG", "c")))
    kept = F.map_filter(held, lambda k, v: k.isin("PATH", "LANG", "TZ"))
    return b.event.select("event_id", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("kept"))


@query("j01_runs_definitions", "SELECT run_id, status, p_brand AS definition FROM run JOIN part ON run_id % 50 = p_partkey")
def runs_definitions(b: Bridge) -> DataFrame:
    definitions = b.table("part").select("p_partkey", F.col("p_brand").alias("definition"))
    return b.run.join(definitions, F.col("run_id") % 50 == F.col("p_partkey")).select("run_id", "status", "definition")


@query("j08_updated_tasks", "SELECT n.plan_id, n.i, CASE WHEN r.status = 'PAUSED' THEN 'BLOCKED' ELSE 'READY' END AS task_status FROM node n JOIN run r ON n.plan_id = r.run_id")
def updated_tasks(b: Bridge) -> DataFrame:
    return b.node.join(b.run, F.col("plan_id") == F.col("run_id")).select("plan_id", "i", F.when(F.col("status") == "PAUSED", "BLOCKED").otherwise("READY").alias("task_status"))


@query("j13_generated_nodes", "SELECT coalesce(n.plan_id, a.plan_id) AS plan_id, coalesce(n.module_id, a.module_id) AS module_id, coalesce(n.c, 0) AS expected, coalesce(a.c, 0) AS actual FROM (SELECT plan_id, module_id, count(*) AS c FROM node GROUP BY ALL) n FULL JOIN (SELECT plan_id, module_id, count(*) AS c FROM plan_after GROUP BY ALL) a ON n.plan_id = a.plan_id AND n.module_id = a.module_id")
def generated_nodes(b: Bridge) -> DataFrame:
    return al.uses(b.versions).withColumnsRenamed({"old_uses": "expected", "new_uses": "actual"})


@query("j15_records_without_boundary", "SELECT plan_id, i FROM node n WHERE NOT EXISTS (SELECT 1 FROM plan_after a WHERE a.plan_id = n.plan_id AND a.i = n.i)")
def records_without_boundary(b: Bridge) -> DataFrame:
    return b.node.join(b.plan_after.select("plan_id", "i"), ["plan_id", "i"], "left_anti").select("plan_id", "i")


@query("j20_event_task_boundary", """WITH done AS (SELECT event_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS k FROM event WHERE event_type = 'TASK_COMPLETED')
 SELECT e.event_id, n.plan_id, n.i, a.i IS NOT NULL AS at_boundary FROM done e JOIN node n ON n.plan_id = e.run_id AND n.i = e.k LEFT JOIN plan_after a ON a.plan_id = n.plan_id AND a.i = n.i""")  # fmt: skip
def event_task_boundary(b: Bridge) -> DataFrame:
    """A run's completions in order, each with its task and whether the task is in the accepted plan; one task for an event."""
    done = b.event.filter("event_type = 'TASK_COMPLETED'").select("event_id", F.col("run_id").alias("plan_id"), F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")).alias("i"))
    tasks = done.join(b.node.select("plan_id", "i"), ["plan_id", "i"])
    boundary = b.plan_after.select("plan_id", "i", F.lit(True).alias("kept"))
    return tasks.join(boundary, ["plan_id", "i"], "left").select("event_id", "plan_id", "i", F.coalesce("kept", F.lit(False)).alias("at_boundary"))


@query("j21_recorded_reads", "SELECT d.doc_id, d.lang || ':' || coalesce(CAST(l.quality AS VARCHAR), 'none') AS read FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def recorded_reads(b: Bridge) -> DataFrame:
    recorded = b.table("labels").select("doc_id", F.col("quality").cast("string").alias("q"))
    return b.table("documents").select("doc_id", "lang").join(recorded, "doc_id", "left").select("doc_id", F.concat_ws(":", "lang", F.coalesce("q", F.lit("none"))).alias("read"))


@query("j23_declared_endpoints", "SELECT s_nationkey, count(*) = 1 AS single FROM supplier GROUP BY s_nationkey")
def declared_endpoints(b: Bridge) -> DataFrame:
    return b.table("supplier").groupBy("s_nationkey").agg((F.count("*") == 1).alias("single"))


@query("a16_usage_totals", "SELECT CAST(sum(wall_time_ms) AS BIGINT) AS wall_time_ms, CAST(sum(tool_calls) AS BIGINT) AS tool_calls, sum(CAST(cost_usd AS DECIMAL(12,2)))::DOUBLE AS cost_usd FROM node")
def usage_totals(b: Bridge) -> DataFrame:
    return b.node.agg(F.sum("wall_time_ms").alias("wall_time_ms"), F.sum("tool_calls").alias("tool_calls"), F.sum(F.col("cost_usd").cast("decimal(12,2)")).cast("double").alias("cost_usd"))


@query("a22_ready_counts", "SELECT plan_id, count(*) FILTER (i > 1 AND NOT effectful) AS ready FROM node GROUP BY plan_id")
def ready_counts(b: Bridge) -> DataFrame:
    return b.node.groupBy("plan_id").agg(F.count_if((F.col("i") > 1) & ~F.col("effectful")).alias("ready"))


@query("a24_distinct_artifacts", "SELECT DISTINCT module_digest AS digest FROM node ORDER BY digest")
def distinct_artifacts(b: Bridge) -> DataFrame:
    return b.node.select(F.col("module_digest").alias("digest")).dropDuplicates().orderBy("digest")


@query("a27_ordered_keys", "SELECT plan_id, string_agg(module_id, ',' ORDER BY first) AS modules FROM (SELECT plan_id, module_id, min(i) AS first FROM node GROUP BY plan_id, module_id) GROUP BY plan_id")
def ordered_keys(b: Bridge) -> DataFrame:
    listed = b.node.groupBy("plan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "module_id"))), lambda x: x["module_id"]).alias("m"))
    return listed.select("plan_id", F.array_join(F.array_distinct("m"), ",").alias("modules"))


@query("w04_charge_ordinals", "SELECT task_id, turn, row_number() OVER (PARTITION BY task_id, status ORDER BY turn) - 1 AS ordinal FROM attempt")
def charge_ordinals(b: Bridge) -> DataFrame:
    return b.attempt.select("task_id", "turn", (F.row_number().over(Window.partitionBy("task_id", "status").orderBy("turn")) - 1).alias("ordinal"))


@query("w05_latest_request", "SELECT run_id, event_id, value FROM event WHERE event_type = 'TASK_READY' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) = 1")
def latest_request(b: Bridge) -> DataFrame:
    asked = b.event.filter("event_type = 'TASK_READY'")
    return asked.groupBy("run_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("w07_first_divergences", "SELECT plan_id, min(i) AS i FROM node n WHERE NOT EXISTS (SELECT 1 FROM plan_after a WHERE a.plan_id = n.plan_id AND a.i = n.i) GROUP BY plan_id")
def first_divergences(b: Bridge) -> DataFrame:
    return al.divergence(al.changes(b.versions)).filter("kind = 'DELETION'").select("plan_id", "i")


@query("o05_history_order", "SELECT run_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS log FROM event GROUP BY run_id")
def history_order(b: Bridge) -> DataFrame:
    return b.event.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("log"))


@query("o06_canonical_order", "SELECT plan_id, bool_and(ok) AS canonical FROM (SELECT plan_id, coalesce(module_id > lag(module_id) OVER (PARTITION BY plan_id ORDER BY i), true) AS ok FROM node) GROUP BY plan_id")
def canonical_order(b: Bridge) -> DataFrame:
    listed = b.node.groupBy("plan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "module_id"))), lambda x: x["module_id"]).alias("m"))
    return listed.select("plan_id", co.in_order(F.col("m")).alias("canonical"))


@query("u05_invariants", "SELECT plan_id, count(*) FILTER (module_id = 'Brand#7') = 0 AS none_of, count(*) FILTER (module_id IN ('Brand#1', 'Brand#2')) > 0 AS any_of FROM node GROUP BY plan_id")
def invariants(b: Bridge) -> DataFrame:
    sets = b.node.groupBy("plan_id").agg(F.collect_set("module_id").alias("m"))
    return sets.select("plan_id", (F.size(F.array_intersect("m", F.array(F.lit("Brand#7")))) == 0).alias("none_of"), (F.size(F.array_intersect("m", F.array(F.lit("Brand#1"), F.lit("Brand#2")))) > 0).alias("any_of"))


@query("f11_json_paths", "SELECT event_id, json_extract_string(payload, '$.k') AS k, json_extract_string(payload, '$.none') AS none FROM event")
def json_paths(b: Bridge) -> DataFrame:
    return b.event.select("event_id", F.get_json_object("payload", "$.k").alias("k"), F.get_json_object("payload", "$.none").alias("none"))


@query("f17_milliseconds", "SELECT event_id, CASE WHEN (event_id * 250) % 1000 = 0 THEN event_id * 250 // 1000 END AS ms FROM event")
def milliseconds(b: Bridge) -> DataFrame:
    return b.event.select("event_id", co.whole_milliseconds(F.col("event_id") * 250).alias("ms"))


@query("f19_prefixes", "SELECT plan_id, i, CASE WHEN i % 2 = 0 THEN 'n' || i ELSE 'dynamic:n' || i END AS name FROM node")
def prefixes(b: Bridge) -> DataFrame:
    name = F.concat(F.when(F.col("i") % 2 == 0, "nodes/").otherwise("dynamic:"), F.lit("n"), F.col("i").cast("string"))
    return b.node.select("plan_id", "i", fx.without_prefix(name, "nodes/").alias("name"))


@query("f22_input_digests", "SELECT plan_id, i, CASE WHEN count(*) = 1 THEN min(CAST(dep AS VARCHAR)) ELSE sha256('{\"ordered_input_schemas\":[' || string_agg('\"' || dep || '\"', ',' ORDER BY position) || ']}') END AS input_digest FROM edge GROUP BY plan_id, i")
def input_digests(b: Bridge) -> DataFrame:
    deps = b.edge.groupBy("plan_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "dep"))), lambda x: x["dep"].cast("string")).alias("d"))
    many = F.sha2(F.concat(F.lit('{"ordered_input_schemas":['), F.array_join(F.transform("d", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]}")), 256)
    return deps.select("plan_id", "i", F.when(F.size("d") == 1, F.get("d", F.lit(0))).otherwise(many).alias("input_digest"))


@query("v05_grant_ceiling", "SELECT DISTINCT plan_id, module_id AS beyond FROM node WHERE effectful AND module_id NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def grant_ceiling(b: Bridge) -> DataFrame:
    granted = b.spark.createDataFrame([(f"Brand#{k}",) for k in (1, 2, 3)], "module_id string")
    return b.node.filter("effectful").join(F.broadcast(granted), "module_id", "left_anti").select("plan_id", F.col("module_id").alias("beyond")).distinct()


@query("v06_approval_eligibility", "SELECT n.plan_id, n.i, c.c_mktsegment IS NOT NULL AS eligible FROM node n LEFT JOIN customer c ON c.c_custkey = n.plan_id % 500 AND c.c_acctbal > 5000 WHERE n.effectful AND n.approval_required")
def approval_eligibility(b: Bridge) -> DataFrame:
    approvers = b.table("customer").filter("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    needs = b.node.filter("effectful and approval_required")
    return needs.join(approvers, F.col("c_custkey") == F.col("plan_id") % 500, "left").select("plan_id", "i", F.col("c_mktsegment").isNotNull().alias("eligible"))


@query("d02_control_signatures", "SELECT n.plan_id, n.s <> coalesce(a.s, '') AS changed FROM (SELECT plan_id, string_agg(module_id, '>' ORDER BY i) AS s FROM node GROUP BY plan_id) n LEFT JOIN (SELECT plan_id, string_agg(module_id, '>' ORDER BY i) AS s FROM plan_after GROUP BY plan_id) a USING (plan_id)")
def control_signatures(b: Bridge) -> DataFrame:
    of = lambda df, name: df.groupBy("plan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "module_id"))), lambda x: x["module_id"]), ">").alias(name))
    both = of(b.node, "old").join(of(b.plan_after, "new"), "plan_id", "left")
    return both.select("plan_id", (F.col("old") != F.coalesce("new", F.lit(""))).alias("changed"))


@query("l02_expired_leases", "SELECT task_id, turn FROM attempt WHERE status = 'ABANDONED' OR tokens > 1200")
def expired_leases(b: Bridge) -> DataFrame:
    return b.attempt.filter((F.col("status") == "ABANDONED") | (F.col("tokens") > 1200)).select("task_id", "turn")


@query("l09_latest_checkpoints", "SELECT task_id, max(turn) AS turn, arg_max(tokens, turn) AS tokens FROM attempt GROUP BY task_id")
def latest_checkpoints(b: Bridge) -> DataFrame:
    return b.attempt.groupBy("task_id").agg(F.max("turn").alias("turn"), F.max_by("tokens", "turn").alias("tokens"))


@query("l10_fences", "SELECT plan_id, i, (tool_calls IS NULL) <> effectful AS fenced FROM node")
def fences(b: Bridge) -> DataFrame:
    return b.node.select("plan_id", "i", (F.col("tool_calls").isNull() != F.col("effectful")).alias("fenced"))


@query("l14_effect_pairs", "SELECT plan_id, i, NOT approval_required AS paired FROM node WHERE effectful")
def effect_pairs(b: Bridge) -> DataFrame:
    order = Window.partitionBy("plan_id", "i").orderBy("kind")
    records = lg.effect_records(b.node).withColumn("next", F.lead("kind").over(order))
    return records.filter("kind = 'ATTEMPTED'").select("plan_id", "i", (F.coalesce("next", F.lit("")) == "COMMITTED").alias("paired"))


@query("l17_provenance", "SELECT plan_id, i FROM node WHERE (tool_calls IS NULL) <> (CASE WHEN effectful THEN module_id END IS NULL)")
def provenance(b: Bridge) -> DataFrame:
    tasks = b.node.withColumn("region", F.when(F.col("effectful"), F.col("module_id")))
    return co.provenance_defects(tasks, ("tool_calls", "region")).select("plan_id", "i")


@query("l18_model_metering", "SELECT task_id, turn, tokens <= 300 + turn * 100 AS fits FROM attempt")
def model_metering(b: Bridge) -> DataFrame:
    metered = b.attempt.select("task_id", "turn", F.col("tokens").alias("tokens_actual"), (300 + F.col("turn") * 100).alias("tokens_reserved"))
    return co.fits_reservation(metered, ("tokens",)).select("task_id", "turn", "fits")


@query("n06_budget_values", "SELECT plan_id, i, CASE WHEN v < 0 THEN 'negative' WHEN v <> floor(v) THEN 'not-whole' END AS defect FROM (SELECT plan_id, i, (p_size - 10) * 0.5 AS v FROM node)")
def budget_values(b: Bridge) -> DataFrame:
    return b.node.select("plan_id", "i", co.budget_defect(F.lit("tool_calls"), (F.col("p_size") - 10) * F.lit(0.5)).alias("defect"))


@query("n07_token_splits", "SELECT task_id, turn, CASE WHEN turn % 3 = 0 THEN true ELSE turn % 3 = 1 END AS valid FROM attempt")
def token_splits(b: Bridge) -> DataFrame:
    inside = F.when(F.col("turn") % 3 == 1, F.col("tokens")).when(F.col("turn") % 3 == 2, F.col("tokens") + 1)
    return b.attempt.select("task_id", "turn", co.token_split(F.col("tokens"), inside, F.when(F.col("turn") % 3 != 0, F.lit(0))).alias("valid"))


@query("n08_identity_conflicts", "SELECT module_id, i, count(DISTINCT module_digest) AS kinds FROM node GROUP BY ALL HAVING count(DISTINCT module_digest) > 1")
def identity_conflicts(b: Bridge) -> DataFrame:
    return lg.key_conflicts(b.node, ("module_id", "i"), "module_digest")


@query("n13_decisions_once", "SELECT run_id, event_type, min(event_id) AS event_id FROM event WHERE event_type IN ('TASK_READY', 'TASK_FAILED') GROUP BY run_id, event_type")
def decisions_once(b: Bridge) -> DataFrame:
    decided = ev.allowed_only(b.event, ("TASK_READY", "TASK_FAILED"))
    return co.first_of_kind(decided, ("run_id", "event_type"), "event_id").select("run_id", "event_type", "event_id")


@query("n12_inherited_decisions", "SELECT e.plan_id, e.i, d.i AS decided_at FROM edge e JOIN edge d ON d.plan_id = e.plan_id AND d.position = 0 AND d.i = e.dep AND e.position = 0 AND e.i > 1")
def inherited_decisions(b: Bridge) -> DataFrame:
    first = b.edge.filter("position = 0").select("plan_id", "i", "dep")
    contexts = first.filter("i > 1").select("plan_id", "i", F.array("dep", "i").alias("context"))
    decisions = first.select("plan_id", F.col("i").alias("decided_at"), F.array("i").alias("scope"))
    return co.inherited(decisions, contexts).select("plan_id", "i", "decided_at")


@query("n24_command_defects", """WITH sent AS (SELECT event_id, CASE event_type WHEN 'RUN_STARTED' THEN 'approve' WHEN 'TASK_READY' THEN 'pause' WHEN 'ATTEMPT_HEARTBEAT' THEN 'signal' WHEN 'TASK_COMPLETED' THEN 'reject' ELSE 'restart' END AS kind,
 CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM event)
 SELECT event_id, kind, CASE WHEN kind = 'restart' THEN 'unknown-type' WHEN k % 7 = 0 THEN 'no-id' WHEN kind = 'signal' AND k % 3 = 1 THEN 'fields' WHEN kind = 'pause' AND k % 3 = 2 THEN 'fields'
  WHEN kind IN ('approve', 'reject') AND k % 5 = 4 THEN 'fields' WHEN kind IN ('approve', 'reject') AND k % 5 = 3 THEN 'blank' END AS defect FROM sent""")  # fmt: skip
def command_defects(b: Bridge) -> DataFrame:
    """The log's events as commands: with optional fields or none, without an id, with a field too few or too many, with a blank request."""
    sent = b.event.withColumn("k", F.get_json_object("payload", "$.k").cast("long"))
    kind = F.when(F.col("event_type") == "RUN_STARTED", "approve").when(F.col("event_type") == "TASK_READY", "pause").when(F.col("event_type") == "ATTEMPT_HEARTBEAT", "signal").when(F.col("event_type") == "TASK_COMPLETED", "reject").otherwise("restart")
    k = F.col("k")
    value = lambda test: F.when(test, F.lit("x"))
    request = F.when(k % 5 == 4, F.lit(None).cast("string")).when(k % 5 == 3, " ").otherwise(F.concat(F.lit("r"), k.cast("string")))
    made = sent.select("event_id", kind.alias("kind"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("c"), "event_id")).alias("command_id"), F.struct(
        F.when(F.col("event_type").isin("RUN_STARTED", "TASK_COMPLETED"), request).alias("request_id"), value((F.col("event_type") == "RUN_STARTED") & (k % 2 == 0)).alias("comment"),
        value(F.col("event_type").isin("TASK_READY", "TASK_COMPLETED") & (k % 2 == 0)).alias("reason"), value(F.col("event_type") == "ATTEMPT_HEARTBEAT").alias("name"),
        value((F.col("event_type") == "ATTEMPT_HEARTBEAT") & (k % 3 != 1)).alias("value"), value((F.col("event_type") == "TASK_READY") & (k % 3 == 2)).alias("task_id"),
    ).alias("f"))
    listed = lambda test: F.array_compact(F.array(*(F.when(test(F.col(f"f.{c}")), F.lit(c)) for c in ("request_id", "comment", "reason", "name", "value", "task_id"))))
    return made.select("event_id", "kind", co.command_defect(F.col("kind"), F.col("command_id"), listed(lambda c: c.isNotNull()), listed(lambda c: F.trim(c) == "")).alias("defect"))


@query("n25_run_snapshots", "SELECT run_id, tenant_id, status, max(event_id) AS cursor FROM run LEFT JOIN event USING (run_id) GROUP BY ALL")
def run_snapshots(b: Bridge) -> DataFrame:
    last = b.event.groupBy("run_id").agg(F.max("event_id").alias("cursor"))
    return b.run.join(last, "run_id", "left").select("run_id", "tenant_id", "status", "cursor")


@query("n33_value_integrity", "SELECT doc_id, n_chars = length(text) AS size_matches FROM documents")
def value_integrity(b: Bridge) -> DataFrame:
    return b.table("documents").select("doc_id", (F.col("n_chars") == F.length("text")).alias("size_matches"))
