"""Registered queries on paths, imported plans, ledgers, leases, adoptions and evidence; see ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planlens.operators import audits as au
from planlens.operators import ledger as lg
from planlens.plans import metrics as me
from planlens.plans import paths as pa
from planlens.plans.bridge import Bridge
from planlens.queries import query

# --- paths ---------------------------------------------------------------------


@query("a08_critical_paths", """WITH RECURSIVE walk AS (SELECT e.plan_id, e.i, n.wall_time_ms AS ms FROM edge e JOIN node n ON n.plan_id = e.plan_id AND n.i = e.i WHERE e.dep = 0
 UNION ALL SELECT e.plan_id, e.i, w.ms + n.wall_time_ms FROM walk w JOIN edge e ON e.plan_id = w.plan_id AND e.dep = w.i JOIN node n ON n.plan_id = e.plan_id AND n.i = e.i),
 path AS (SELECT plan_id, i, CASE WHEN count(*) = count(ms) THEN max(ms) END AS ms FROM walk GROUP BY plan_id, i)
 SELECT p.plan_id, CASE WHEN count(*) = count(p.ms) THEN max(p.ms) END AS wall_time_ms FROM path p WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.plan_id = p.plan_id AND e.dep = p.i) GROUP BY p.plan_id""")  # fmt: skip
def critical_paths(b: Bridge) -> DataFrame:
    b.keep_nodes()
    return pa.wall_budget(b.node, b.edge)


@query("d03_dependency_keys", """WITH RECURSIVE reach AS (SELECT plan_id, i, dep FROM edge WHERE dep <> 0
 UNION SELECT r.plan_id, r.i, e.dep FROM reach r JOIN node n ON n.plan_id = r.plan_id AND n.i = r.dep JOIN edge e ON e.plan_id = r.plan_id AND e.i = r.dep WHERE n.tool_calls IS NULL AND e.dep <> 0)
 SELECT r.plan_id, r.i, r.dep AS dependency FROM reach r JOIN node o ON o.plan_id = r.plan_id AND o.i = r.i JOIN node n ON n.plan_id = r.plan_id AND n.i = r.dep WHERE o.tool_calls IS NOT NULL AND n.tool_calls IS NOT NULL""")  # fmt: skip
def dependency_keys(b: Bridge) -> DataFrame:
    b.keep_nodes("tool_calls")
    return pa.dependency_keys(b.edge, b.node.filter("tool_calls is not null"))


@query("d05_executed_paths", """WITH RECURSIVE live AS (SELECT e.plan_id, e.i, e.dep FROM edge e JOIN node n ON n.plan_id = e.plan_id AND n.i = e.i
  WHERE e.dep <> 0 AND (e.i < 4 OR e.i % 2 = 1 OR n.tool_calls IS NULL OR n.effectful OR e.position = 0)),
 kept AS (SELECT plan_id, max(i) AS i FROM node GROUP BY plan_id UNION SELECT l.plan_id, l.dep FROM kept k JOIN live l ON l.plan_id = k.plan_id AND l.i = k.i)
 SELECT plan_id, i FROM kept""")  # fmt: skip
def executed_paths(b: Bridge) -> DataFrame:
    branches = b.node.filter("i >= 4 and i % 2 = 0 and tool_calls is not null")
    decisions = branches.select("plan_id", "i", F.when(F.col("effectful"), 1).otherwise(2).alias("selected"))
    return pa.executed_path(b.edge, decisions, b.node.groupBy("plan_id").agg(F.max("i").alias("i")))


@query("g13_order_frontier", """WITH done AS (SELECT plan_id, i FROM node WHERE effectful), need AS (SELECT plan_id, i, dep FROM edge UNION SELECT plan_id, i, i - 1 FROM node WHERE approval_required)
 SELECT plan_id, i FROM need WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.plan_id = need.plan_id AND d.i = need.i)
 GROUP BY plan_id, i HAVING bool_and(dep = 0 OR EXISTS (SELECT 1 FROM done d WHERE d.plan_id = need.plan_id AND d.i = need.dep))""")  # fmt: skip
def order_frontier(b: Bridge) -> DataFrame:
    order = b.node.filter("approval_required").select("plan_id", "i", (F.col("i") - 1).alias("dep"))
    return lg.frontier(b.edge.select("plan_id", "i", "dep").unionByName(order), b.node.filter("effectful").select("plan_id", "i"))


# --- imported plans ------------------------------------------------------------


@query("g07_imported_plans", """WITH step AS (SELECT plan_id, i, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN plan_id % 5 = 0 THEN -i ELSE i END) AS place, module_id,
  CASE WHEN NOT (effectful AND approval_required AND p_size % 2 = 0) THEN (i - 1) // 3 END AS logical_step, module_digest, tool_calls AS budget FROM plan_after),
 marked AS (SELECT s.*, module_id IS NOT NULL AND logical_step IS NOT NULL AS whole, row_number() OVER (PARTITION BY plan_id, module_id, logical_step ORDER BY place) > 1 AS again,
  EXISTS (SELECT 1 FROM edge e LEFT JOIN step d ON d.plan_id = e.plan_id AND d.i = e.dep WHERE e.plan_id = s.plan_id AND e.i = s.i AND e.dep <> 0 AND (d.place IS NULL OR d.place >= s.place)) AS loose FROM step s),
 judged AS (SELECT plan_id, i, place, CASE WHEN loose THEN 'UNKNOWN_OR_FORWARD_DEPENDENCY' WHEN (module_id IS NULL) <> (logical_step IS NULL) THEN 'PARTIAL_IDENTITY' WHEN whole AND again THEN 'DUPLICATE_REPLAY_KEY' WHEN whole AND (module_digest IS NULL OR budget IS NULL) THEN 'INCOMPLETE_DEFINITION' WHEN NOT whole AND budget IS NOT NULL THEN 'CONTROL_WITH_CONTRACT' END AS defect FROM marked)
 SELECT plan_id, arg_min(defect, place) AS defect, arg_min(i, place) AS i FROM judged WHERE defect IS NOT NULL GROUP BY plan_id""")  # fmt: skip
def imported_plans(b: Bridge) -> DataFrame:
    order = F.when(F.col("plan_id") % 5 == 0, -F.col("i")).otherwise(F.col("i"))
    named = ~(F.col("effectful") & F.col("approval_required") & (F.col("p_size") % 2 == 0))
    steps = b.plan_after.select(
        "plan_id", "i", F.row_number().over(Window.partitionBy("plan_id").orderBy(order)).alias("place"), "module_id",
        F.when(named, F.floor((F.col("i") - 1) / 3)).alias("logical_step"), "module_digest", F.col("tool_calls").alias("budget"),
    )
    return au.imported_defects(steps, b.edge)


@query("g10_reused_modules", "SELECT plan_id, module_id, count(*) AS uses, count(*) FILTER (NOT approval_required) AS implicit FROM node GROUP BY plan_id, module_id HAVING count(*) > 1 AND count(*) FILTER (NOT approval_required) > 0")
def reused_modules(b: Bridge) -> DataFrame:
    return au.reuse_defects(b.node.withColumn("explicit", F.col("approval_required")))


@query("n15_changed_descriptors", """SELECT * FROM (SELECT n.plan_id, n.i, CASE WHEN n.module_digest <> a.module_digest THEN 'module_digest' WHEN n.tool_calls IS DISTINCT FROM a.tool_calls + CASE WHEN a.effectful AND a.p_size % 3 = 0 THEN 1 ELSE 0 END THEN 'budget' END AS changed
 FROM node n JOIN plan_after a ON a.plan_id = n.plan_id AND a.i = n.i) WHERE changed IS NOT NULL""")  # fmt: skip
def changed_descriptors(b: Bridge) -> DataFrame:
    fields = lambda f, budget: f.select("plan_id", "i", "module_digest", budget.alias("budget"), "effectful")
    now = fields(b.plan_after, F.col("tool_calls") + F.when(F.col("effectful") & (F.col("p_size") % 3 == 0), 1).otherwise(0))
    both = fields(b.node, F.col("tool_calls")).alias("d").join(now.alias("m"), ["plan_id", "i"])
    return both.select("plan_id", "i", au.first_difference("d", "m", ("module_digest", "budget", "effectful")).alias("changed")).filter("changed is not null")


@query("n23_replay_registry", "SELECT module_id, p_size AS logical_step, min(module_digest) AS module_digest, count(DISTINCT module_digest) AS digests FROM node GROUP BY ALL")
def replay_registry(b: Bridge) -> DataFrame:
    return b.node.groupBy("module_id", F.col("p_size").alias("logical_step")).agg(F.min("module_digest").alias("module_digest"), F.count_distinct("module_digest").alias("digests"))


@query("o07_sorted_declarations", """SELECT plan_id, string_agg(d, ',' ORDER BY d) AS declarations FROM (SELECT plan_id, '{"approval_required":' || approval_required || ',"name":"' || module_id || '"}' AS d FROM node WHERE effectful) GROUP BY plan_id""")
def sorted_declarations(b: Bridge) -> DataFrame:
    text = F.to_json(F.struct("approval_required", F.col("module_id").alias("name")))
    return b.node.filter("effectful").groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("declarations"))


# --- ledgers, leases, adoption ---------------------------------------------------

_STATES = {"TASK_READY": "RESERVED", "ATTEMPT_HEARTBEAT": "ATTEMPTED", "TASK_COMPLETED": "COMMITTED"}


@query("l04_ledger_defects", """WITH log AS (SELECT run_id, event_id, CASE event_type WHEN 'TASK_READY' THEN 'RESERVED' WHEN 'ATTEMPT_HEARTBEAT' THEN 'ATTEMPTED' WHEN 'TASK_COMPLETED' THEN 'COMMITTED' END AS state FROM event),
 stepped AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY event_id) AS before FROM log WHERE state IS NOT NULL)
 SELECT * FROM (SELECT run_id, event_id, state, CASE WHEN before IS NULL AND state <> 'RESERVED' THEN 'NOT_RESERVED' WHEN before = 'COMMITTED' THEN 'AFTER_COMMIT' WHEN before IS NOT NULL AND state = 'RESERVED' THEN 'RESERVED_TWICE' WHEN state = 'COMMITTED' AND before <> 'ATTEMPTED' THEN 'NOT_ATTEMPTED' END AS defect FROM stepped) WHERE defect IS NOT NULL""")  # fmt: skip
def ledger_defects(b: Bridge) -> DataFrame:
    states = F.create_map(*(F.lit(x) for pair in _STATES.items() for x in pair))
    log = b.event.select("run_id", "event_id", F.try_element_at(states, F.col("event_type")).alias("state")).filter("state is not null")
    return au.ledger_defects(log, ("run_id",), "event_id").select("run_id", "event_id", "state", "defect")


@query("l02_lapsed_leases", """WITH beat AS (SELECT run_id, event_id, event_type, created_at, lead(created_at) OVER (PARTITION BY run_id ORDER BY created_at, event_id) AS next_at FROM event)
 SELECT run_id, event_id, next_at FROM beat WHERE event_type = 'ATTEMPT_HEARTBEAT' AND next_at > created_at + INTERVAL 5 MINUTE""")  # fmt: skip
def lapsed(b: Bridge) -> DataFrame:
    return au.lapsed_leases(b.event).filter("event_type = 'ATTEMPT_HEARTBEAT'").select("run_id", "event_id", "next_at")


@query("l13_definition_adoption", """SELECT a.plan_id, CASE WHEN r.run_id IS NULL THEN 'RUN_NOT_FOUND' WHEN status IS DISTINCT FROM 'RUNNING' THEN 'RUN_NOT_RUNNING' WHEN n.wall_time_ms IS NULL THEN 'NO_ACCEPTED_BOUNDARY'
 WHEN n.module_digest = a.module_digest THEN 'ALREADY_ADOPTED' WHEN n.effectful THEN 'DEFINITION_CHANGED' ELSE 'ADOPTED' END AS outcome
 FROM plan_after a LEFT JOIN run r ON r.run_id = a.plan_id LEFT JOIN node n ON n.plan_id = a.plan_id AND n.i = 1 WHERE a.i = 1""")  # fmt: skip
def definition_adoption(b: Bridge) -> DataFrame:
    proposed = b.plan_after.filter("i = 1").select("plan_id", F.col("module_digest").alias("proposed"))
    expected = F.when(F.col("effectful"), F.sha2("module_digest", 256)).otherwise(F.col("module_digest"))
    source = b.node.filter("i = 1").select("plan_id", F.col("wall_time_ms").isNotNull().alias("accepted"), F.col("module_digest").alias("current"), expected.alias("expected"))
    runs = b.run.select(F.col("run_id").alias("plan_id"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"))
    joined = proposed.join(runs, "plan_id", "left").join(source, "plan_id", "left")
    return joined.select("plan_id", au.adoption_outcome(*map(F.col, ("status", "accepted", "current", "expected", "proposed"))).alias("outcome"))


@query("n09_effect_lookups", """WITH led AS (SELECT plan_id, module_id, row_number() OVER (PARTITION BY plan_id, module_id ORDER BY i) - 1 AS ordinal, i, module_digest, approval_required FROM node WHERE effectful),
 asked AS (SELECT plan_id, module_id, row_number() OVER (PARTITION BY plan_id, module_id ORDER BY i) - 1 AS ordinal, module_digest FROM plan_after WHERE effectful OR tool_calls = 2)
 SELECT a.plan_id, a.module_id, a.ordinal, CASE WHEN l.plan_id IS NULL THEN 'RESERVE' WHEN l.module_digest <> a.module_digest THEN 'IDENTITY_CONFLICT' WHEN l.approval_required THEN 'ATTEMPT' ELSE 'RECOVERED' END AS outcome
 FROM asked a LEFT JOIN led l ON l.plan_id = a.plan_id AND l.module_id = a.module_id AND l.ordinal = a.ordinal""")  # fmt: skip
def effect_lookups(b: Bridge) -> DataFrame:
    key = ("plan_id", "module_id", "ordinal")
    orders = lambda f: lg.effect_orders(f).join(f, ["plan_id", "i", "module_id"])
    ledger = orders(b.node).select(*key, F.col("module_digest").alias("request_digest"), F.when(F.col("approval_required"), "ATTEMPTED").otherwise("COMMITTED").alias("status"))
    asked = b.plan_after.withColumn("effectful", F.col("effectful") | F.coalesce(F.col("tool_calls") == 2, F.lit(False)))
    return au.effect_lookups(orders(asked).select(*key, F.col("module_digest").alias("request_digest")), ledger, key).select(*key, "outcome")


@query("n16_materializations", """WITH log AS (SELECT plan_id, module_id, i, module_digest, first_value(module_digest) OVER (PARTITION BY plan_id, module_id ORDER BY i) AS first_digest FROM node)
 SELECT plan_id, module_id, i, first_digest FROM log WHERE module_digest <> first_digest""")  # fmt: skip
def materializations(b: Bridge) -> DataFrame:
    log = b.node.withColumnRenamed("module_digest", "plan_digest")
    return au.conflicting_materializations(log, ("plan_id", "module_id"), "i").select("plan_id", "module_id", "i", "first_digest")


@query("n19_proposed_effects", """SELECT n.plan_id, n.i, CASE WHEN n.module_id <> a.module_id THEN 'adapter' WHEN n.module_digest <> a.module_digest THEN 'request_digest' WHEN n.tool_calls IS NOT NULL AND n.tool_calls IS DISTINCT FROM a.tool_calls + a.p_size % 2 THEN 'connector_version' END AS mismatch
 FROM plan_after a JOIN node n ON n.plan_id = a.plan_id AND n.i = a.i WHERE n.effectful""")  # fmt: skip
def proposed_effects(b: Bridge) -> DataFrame:
    fields = lambda f, version: f.select("plan_id", "i", F.col("module_id").alias("adapter"), F.col("module_digest").alias("request_digest"), version.alias("connector_version"))
    recorded, proposed = fields(b.node.filter("effectful"), F.col("tool_calls")), fields(b.plan_after, F.col("tool_calls") + F.col("p_size") % 2)
    both = proposed.alias("p").join(recorded.alias("r"), ["plan_id", "i"])
    return both.select("plan_id", "i", au.first_difference("p", "r", ("adapter", "request_digest", "connector_version"), where_recorded=True).alias("mismatch"))


@query("j18_request_mismatches", """SELECT * FROM (SELECT a.plan_id, a.i, CASE WHEN n.plan_id IS NULL THEN 'task' WHEN a.plan_id % 7 = 0 THEN 'tenant_id' WHEN n.module_digest <> a.module_digest THEN 'definition_digest' END AS mismatch
 FROM (SELECT plan_id, i + (p_size % 2) AS i, module_digest FROM plan_after) a LEFT JOIN (SELECT node.* FROM node JOIN run ON run_id = plan_id) n ON n.plan_id = a.plan_id AND n.i = a.i) WHERE mismatch IS NOT NULL""")  # fmt: skip
def request_mismatches(b: Bridge) -> DataFrame:
    tenants = b.run.select(F.col("run_id").alias("plan_id"), "tenant_id")
    tenant = F.when(F.col("plan_id") % 7 == 0, -1 - F.col("tenant_id")).otherwise(F.col("tenant_id"))
    asked = b.plan_after.select("plan_id", (F.col("i") + F.col("p_size") % 2).alias("i"), F.col("module_digest").alias("definition_digest")).join(tenants.select("plan_id", tenant.alias("tenant_id")), "plan_id", "left")
    held = b.node.select("plan_id", "i", F.col("module_digest").alias("definition_digest"), F.lit(True).alias("held")).join(tenants, "plan_id")
    both = asked.alias("a").join(held.alias("t"), ["plan_id", "i"], "left")
    mismatch = F.when(F.col("t.held").isNull(), "task").otherwise(au.first_difference("a", "t", ("tenant_id", "definition_digest")))
    return both.select("plan_id", "i", mismatch.alias("mismatch")).filter("mismatch is not null")


# --- executors -----------------------------------------------------------------

_EXECUTOR = {"isolations": ("process", "container"), "images": ("Brand#1", "Brand#2", "Brand#3"), "cpu": 30, "memory_bytes": 40 << 20, "labels": '["Brand#1","Brand#2","Brand#3","Brand#4","Brand#5"]'}


@query("f12_executor_labels", """SELECT plan_id, i FROM node WHERE (NOT effectful OR module_id IN ('Brand#1', 'Brand#2', 'Brand#3')) AND p_size <= 30 AND (tool_calls IS NULL OR tool_calls << 23 <= 41943040)
 AND (NOT approval_required OR module_id IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')) AND i <> 3""")  # fmt: skip
def executor_labels(b: Bridge) -> DataFrame:
    tasks = b.node.select(
        "plan_id", "i", F.when(F.col("i") == 3, "vm").when(F.col("effectful"), "container").otherwise("process").alias("isolation"), F.when(F.col("effectful"), F.col("module_id")).alias("image"), F.col("p_size").alias("cpu"),
        F.shiftleft("tool_calls", 23).alias("memory_bytes"), F.when(F.col("approval_required"), F.to_json(F.array("module_id"))).otherwise("[]").alias("labels"),
    )
    return tasks.filter(au.fits_executor(_EXECUTOR)).select("plan_id", "i")


@query("f18_environments", """SELECT plan_id, i, CASE WHEN i = 4 THEN 'isolation' WHEN p_size % 3 = 0 THEN 'image-not-pinned' WHEN effectful AND p_size % 3 = 1 THEN 'image-missing' WHEN approval_required AND p_size % 2 = 0 THEN 'lock' WHEN tool_calls - 1 < 1 THEN 'cpu' END AS defect FROM node""")
def environments(b: Bridge) -> DataFrame:
    size = F.col("p_size")
    image = F.when(size % 3 == 0, F.concat("module_id", F.lit(":latest"))).when(size % 3 == 2, F.concat("module_id", F.lit("@sha256:"), "module_digest"))
    lock = F.when(F.col("approval_required"), F.concat(F.when(size % 2 == 0, "md5:").otherwise("sha256:"), "module_digest"))
    isolation = F.when(F.col("i") == 4, "jail").when(F.col("effectful"), "container").otherwise("process")
    return b.node.select("plan_id", "i", au.environment_defect(isolation, image, lock, F.col("tool_calls") - 1).alias("defect"))


# --- evidence ------------------------------------------------------------------

_NUMBER_SQL = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE format('{{:g}}', {0}) END"


@query("f15_number_texts", f"SELECT event_id, {_NUMBER_SQL.format('v')} AS text FROM (SELECT event_id, value * 1.25 AS v FROM event)")
def number_texts(b: Bridge) -> DataFrame:
    return b.event.select("event_id", au.number_text(F.col("value") * 1.25).alias("text"))


_PLAN_RULES = [(1, "plan_fanout", 1.0, 0.0), (2, "plan_budget_cost_usd", 0.25, 0.015), (3, "plan_budget_tool_calls", 20.0, 2.0)]
_SAYS = " UNION ALL ".join(
    f"SELECT plan_id, {rank} AS rank, CASE WHEN v > {upper} THEN '{au.METRICS[metric][1]} is ' || {_NUMBER_SQL.format('v')} || '; policy allows at most {upper:g} ({metric}).' WHEN v < {lower} THEN '{au.METRICS[metric][1]} is ' || {_NUMBER_SQL.format('v')} || '; policy requires at least {lower:g} ({metric}).' END AS message, CASE WHEN v > {upper} THEN '{au.METRICS[metric][0]}' ELSE '{au.METRICS[metric][0].replace('EXCEEDED', 'BELOW_MINIMUM')}' END AS code FROM (SELECT plan_id, CAST({column} AS DOUBLE) AS v FROM metric)"
    for (rank, metric, upper, lower), column in zip(_PLAN_RULES, ("max_fanout", "cost_usd", "tool_calls"))
)


@query("v15_evidence_texts", f"""WITH metric AS (SELECT plan_id, max_fanout, tool_calls, cost_usd FROM (SELECT plan_id, CASE WHEN count(*) = count(tool_calls) THEN CAST(sum(tool_calls) AS BIGINT) END AS tool_calls,
 CASE WHEN count(*) = count(cost_usd) THEN CAST(sum(CAST(cost_usd AS DECIMAL(28,10))) AS DOUBLE) END AS cost_usd FROM node GROUP BY plan_id) JOIN (SELECT plan_id, max(n) AS max_fanout FROM (SELECT plan_id, dep, count(*) AS n FROM edge GROUP BY plan_id, dep) GROUP BY plan_id) USING (plan_id)),
 said AS (SELECT * FROM ({_SAYS}) WHERE message IS NOT NULL), listed AS (SELECT plan_id, arg_min(code, rank) AS code, string_agg(message, chr(10) ORDER BY rank) AS messages FROM said GROUP BY plan_id)
 SELECT m.plan_id, coalesce('PLAN REFUSED: ' || code || chr(10) || messages, 'PLAN APPROVED: plan-' || m.plan_id) AS evidence FROM metric m LEFT JOIN listed l ON l.plan_id = m.plan_id""")  # fmt: skip
def evidence_texts(b: Bridge) -> DataFrame:
    metrics = me.fan_out(b.edge).join(me.aggregate_budget(b.node), "plan_id").selectExpr("plan_id", "max_fanout as plan_fanout", "cost_usd as plan_budget_cost_usd", "tool_calls as plan_budget_tool_calls")
    names = [r[1] for r in _PLAN_RULES]
    long = metrics.selectExpr("plan_id", f"stack({len(names)}, " + ", ".join(f"'{n}', cast({n} as double)" for n in names) + ") as (metric, value)")
    rules = b.spark.createDataFrame(_PLAN_RULES, "rank int, metric string, upper double, lower double")
    broken = [F.col(c) for c in ("metric", "value", "upper", "lower")]
    said = long.join(rules, "metric").filter("value > upper or value < lower").select("plan_id", "rank", au.rule_code(*broken).alias("code"), au.rule_message(*broken).alias("message"))
    return au.evidence_text(said, metrics.select("plan_id", F.concat(F.lit("plan-"), F.col("plan_id").cast("string")).alias("artifact_id")))
