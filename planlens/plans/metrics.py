"""Plan metrics: composition, fan-out, grants, budgets, depths, order and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from planlens.functions.canonical import let
from planlens.plans.doubling import ancestry
from planlens.plans.gathered import is_whole, node_rows, sizes_above, solved, solved_keys
from planlens.workspace import Scratch

#: Rounds before deep plans go on by doubling.
SHALLOW = 12


def null_poisoned_sum(column: str) -> Column:
    """The sum, or null if any value is null."""
    return F.when(F.count("*") == F.count(column), F.sum(column))


def exact_cost(column: str) -> Column:
    """Null-poisoned sum in decimals, as a double."""
    return F.when(F.count("*") == F.count(column), F.sum(F.col(column).cast("decimal(28,10)"))).cast("double")


def aggregate_budget(nodes: DataFrame) -> DataFrame:
    """plan_id, tool_calls, cost_usd: what all nodes of a plan may use; unbounded if one is."""
    return nodes.groupBy("plan_id").agg(null_poisoned_sum("tool_calls").alias("tool_calls"), exact_cost("cost_usd").alias("cost_usd"))


def fan_out(edges: DataFrame) -> DataFrame:
    """plan_id, max_fanout: the most consumers of one node, the plan's input included."""
    return edges.groupBy("plan_id", "dep").agg(F.count("*").alias("consumers")).groupBy("plan_id").agg(F.max("consumers").alias("max_fanout"))


def composition(nodes: DataFrame) -> DataFrame:
    """plan_id, module_id, module_digest, uses."""
    return nodes.groupBy("plan_id", "module_id", "module_digest").agg(F.count("*").alias("uses"))


def composition_rollup(nodes: DataFrame) -> DataFrame:
    """Per plan and module: its digests in order and all its uses."""
    return composition(nodes).groupBy("plan_id", "module_id").agg(F.sum("uses").alias("uses"), F.array_join(F.sort_array(F.collect_list("module_digest")), ",").alias("digests"))


def required_grant(nodes: DataFrame) -> DataFrame:
    """plan_id, grants: sorted names of the modules with effects."""
    return nodes.filter("effectful").groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_set("module_id")), ",").alias("grants"))


def approvals(nodes: DataFrame) -> DataFrame:
    """plan_id, approvals: sorted module:node pairs of effects that need approval."""
    pair = F.format_string("%s:%04d", "module_id", "i")
    return nodes.filter("effectful and approval_required").groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("approvals"))


def indexed_depths(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None, rounds: int = SHALLOW) -> DataFrame:
    """plan_id, i, depth of nodes whose dependencies end in the plan's input (dep 0).

    Round k takes the nodes all of whose dependencies earlier rounds took, so k is
    their depth; plans with nodes left after ``rounds`` rounds go on by doubling,
    as most plans are shallow and a round costs less. Rows are dealt by plan and
    node: no plan is gathered in one task. A node on or behind a cycle or a missing
    node has no depth and no row. Plans of few edges are solved in a row each instead.
    """
    scratch = scratch or Scratch(edges.sparkSession, "depths")
    links = scratch.save(edges.select("plan_id", "i", "dep"), "links")
    large = scratch.save(sizes_above(links), "large")
    few = links if large.isEmpty() else links.join(large, "plan_id", "left_anti")
    made = solved(None, few, 0).select("plan_id", F.inline(node_rows())).select("plan_id", "i", (F.col("edges") + 1).alias("depth"))
    if large.isEmpty():
        return made
    return made.unionByName(_depths_by_rounds(scratch.save(links.join(large, "plan_id", "left_semi"), "many"), scratch, rounds))


def _depths_by_rounds(links: DataFrame, scratch: Scratch, rounds: int) -> DataFrame:
    waiting = scratch.save(links.groupBy("plan_id", "i").agg(F.count_if(F.col("dep") != 0).alias("waiting")), "waiting0")
    depth = 0
    while depth < rounds:
        depth += 1
        taken = scratch.save(waiting.filter("waiting = 0").select("plan_id", "i"), f"taken/depth={depth}")
        if taken.isEmpty():
            break
        freed = links.join(taken.withColumnRenamed("i", "dep"), ["plan_id", "dep"]).groupBy("plan_id", "i").agg(F.count("*").alias("freed"))
        rest = waiting.filter("waiting > 0").join(freed, ["plan_id", "i"], "left")
        waiting = scratch.save(rest.select("plan_id", "i", (F.col("waiting") - F.coalesce("freed", F.lit(0))).alias("waiting")), f"waiting{depth}")
        scratch.drop(f"waiting{depth - 1}")
    schema = StructType([*taken.schema.fields, StructField("depth", IntegerType())])
    done = links.sparkSession.read.schema(schema).parquet(scratch.path("taken"))
    deep = waiting.select("plan_id").distinct()  # what is left there was never taken
    if depth < rounds or deep.isEmpty():
        return done
    deep = scratch.save(deep, "deep")
    left = links.join(deep, "plan_id", "left_semi")
    every = left.select("plan_id", "i").distinct().withColumn("wall_time_ms", F.lit(0))
    found = ancestry(every, left.filter("dep <> 0")).filter("depth is not null")
    return done.join(deep, "plan_id", "left_anti").unionByName(found.select("plan_id", "i", "depth"))


def analyse(keys: list[str], deps: dict[str, list[str]], wall: dict[str, float | None], outputs: list[str] | None = None) -> dict:
    """Order, depth, reachability and critical path of one small graph in the driver's or a task's memory; ``$input`` is no node.

    Ready nodes are taken depth first: of those that become ready together the
    smallest key comes first. A cycle leaves ``cyclic`` true and no order. A node
    without a wall time makes the critical path unknown if it lies on a path to
    an output.
    """
    inside = {k: [d for d in deps[k] if d != "$input"] for k in keys}
    missing = sorted({d for k in keys for d in inside[k]} - set(keys))
    users: dict[str, list[str]] = {k: [] for k in keys}
    for k in keys:
        for d in dict.fromkeys(inside[k]):
            users.get(d, []).append(k)
    waiting = {k: len(dict.fromkeys(inside[k])) for k in keys}
    ready = sorted((k for k in keys if not waiting[k]), reverse=True)
    order: list[str] = []
    while ready:
        k = ready.pop()
        order.append(k)
        freed = []
        for u in users[k]:
            waiting[u] -= 1
            if not waiting[u]:
                freed.append(u)
        ready += sorted(freed, reverse=True)
    depth: dict[str, int] = {}
    path: dict[str, float | None] = {}
    for k in order:
        depth[k] = 1 + max((depth[d] for d in inside[k]), default=0)
        before = [path[d] for d in inside[k]]
        path[k] = None if wall.get(k) is None or None in before else wall[k] + max(before, default=0)
    ends = outputs if outputs is not None else [k for k in keys if not users[k]]
    seen, stack = set(), [k for k in ends if k in inside]
    while stack:
        k = stack.pop()
        if k not in seen:
            seen.add(k)
            stack += [d for d in inside[k] if d in inside]
    walls = [path.get(k) for k in ends]
    return {
        "cyclic": len(order) < len(keys) and not missing, "missing": missing, "order": order,
        "max_depth": max(depth.values(), default=0), "unreachable": sorted(set(keys) - seen),
        "critical_path_ms": None if not walls or None in walls else max(walls),
    }


def graph_metrics(nodes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Metrics of every plan of ``nodes`` (plan_id, key, dependencies, wall_time_ms): nodes, max_depth, cyclic, missing, unreachable, topological, critical_path_ms.

    Outputs are the nodes without users. ``topological`` lists the keys as a
    depth-first walk frees them; nodes on or behind a cycle or a missing node
    aren't in it, and a plan with one has no critical path.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "graph")
    large = scratch.save(sizes_above(nodes), "large_plans")
    few = nodes if large.isEmpty() else nodes.join(large, "plan_id", "left_anti")
    plans = solved_keys(few.select("plan_id", "key", "dependencies", F.col("wall_time_ms").cast("double").alias("own")), "$input").select("*", F.flatten("before").alias("users"))
    ends = F.filter(F.zip_with("order", "found", lambda k, f: F.struct(k.alias("k"), f["ms"].alias("ms"), f["unknown"].alias("unknown"))), lambda x: ~F.array_contains("users", x["k"]))
    plans = plans.select(
        "plan_id", is_whole().alias("whole"), F.col("n").alias("nodes"), (F.array_max(F.transform("found", lambda f: f["edges"])) + 1).alias("max_depth"),
        F.array_join(F.transform("order", lambda k: F.get("keys", k - 1)), ",").alias("topological"),
        let(ends, lambda e: F.when(~F.exists(e, lambda x: x["unknown"]), F.array_max(F.transform(e, lambda x: x["ms"])))).alias("critical_path_ms"),
    )
    plans = scratch.save(plans, "few_plans")
    rest = scratch.save(plans.filter(~F.col("whole")).select("plan_id").unionByName(large), "rest_plans")
    made = plans.filter("whole").select("plan_id", "nodes", "max_depth", F.lit(False).alias("cyclic"), F.lit("").alias("missing"), F.lit("").alias("unreachable"), "topological", "critical_path_ms")
    return made if rest.isEmpty() else made.unionByName(_graphs(nodes.join(rest, "plan_id", "left_semi"), scratch))


def _graphs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for plans of many nodes and broken ones, by doubling."""
    links = nodes.select("plan_id", "key", F.explode(F.array_distinct("dependencies")).alias("dep")).filter("dep <> '$input'")
    found = scratch.save(ancestry(nodes.select("plan_id", F.col("key").alias("i"), "wall_time_ms"), links.withColumnRenamed("key", "i"), scratch), "ancestry")
    order = labelled(nodes.select("plan_id", "key", "dependencies").join(found.select("plan_id", F.col("i").alias("key"), "depth"), ["plan_id", "key"]))
    order = order.groupBy("plan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "key"))), lambda x: x["key"]), ",").alias("topological"))
    lacking = links.join(nodes.select("plan_id", F.col("key").alias("dep")), ["plan_id", "dep"], "left_anti")
    lacking = lacking.groupBy("plan_id").agg(F.array_join(F.sort_array(F.collect_set("dep")), ",").alias("missing"))
    ends = found.join(links.select("plan_id", F.col("dep").alias("i")).distinct(), ["plan_id", "i"], "left_anti")
    longest = ends.groupBy("plan_id").agg(F.when(F.count("*") == F.count("path_ms"), F.max("path_ms")).alias("critical_path_ms"))
    summary = found.groupBy("plan_id").agg(
        F.count("*").cast("int").alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.bool_or("cyclic").alias("endless"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("used"), F.col("i")))), ",").alias("unreachable"),
    )
    whole = summary.join(order, "plan_id", "left").join(lacking, "plan_id", "left").join(longest, "plan_id", "left")
    return whole.select(
        "plan_id", "nodes", "max_depth", (F.col("endless") & F.col("missing").isNull()).alias("cyclic"), F.coalesce("missing", F.lit("")).alias("missing"), "unreachable", F.coalesce("topological", F.lit("")).alias("topological"), "critical_path_ms",
    )


def labelled(nodes: DataFrame) -> DataFrame:
    """plan_id, key, position (from 0) in the order of a depth-first walk of nodes (plan_id, key, dependencies, depth).

    A node's label is the greatest label of its dependencies, the last of them in
    the order, and its own key; labels sort as the walk goes. They are made in one
    pass over a plan's nodes by depth. Nodes without a depth are left out.
    """
    placed = nodes.filter("depth is not null").withColumn("r", F.row_number().over(Window.partitionBy("plan_id").orderBy("depth", "key")))
    links = placed.select("plan_id", "r", F.explode("dependencies").alias("key")).join(placed.select("plan_id", "key", F.col("r").alias("before")), ["plan_id", "key"])
    links = links.groupBy("plan_id", "r").agg(F.collect_set("before").alias("before"))
    rows = placed.join(links, ["plan_id", "r"], "left").groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("r", "key", F.coalesce("before", F.array().cast("array<int>")).alias("before")))).alias("graph"))
    label = "array<string>"
    last = lambda made, n: F.coalesce(F.array_max(F.transform(n["before"], lambda d: F.get(made, d - 1))), F.array().cast(label))
    made = F.aggregate("graph", F.array().cast(f"array<{label}>"), lambda made, n: F.array_append(made, F.concat(last(made, n), F.array(n["key"]))))
    ordered = F.sort_array(made)
    return rows.select("plan_id", F.posexplode(ordered).alias("position", "label")).select("plan_id", F.element_at("label", -1).alias("key"), "position")


def keyed_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbered nodes and edges as rows of the graph kernel; keys sort as numbers."""
    key = lambda c: F.when(F.col(c) == 0, F.lit("$input")).otherwise(F.format_string("n%05d", c))
    deps = edges.groupBy("plan_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", key("dep").alias("dep")))), lambda x: x["dep"]).alias("dependencies"))
    return nodes.join(deps, ["plan_id", "i"]).select("plan_id", key("i").alias("key"), "dependencies", "wall_time_ms")


def topology_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id and a digest of its nodes' modules and dependencies."""
    deps = edges.groupBy("plan_id", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "dep"))), lambda x: x["dep"].cast("string")), "+").alias("deps"))
    line = F.concat_ws("|", F.format_string("%05d", "i"), "module_id", "deps")
    return nodes.join(deps, ["plan_id", "i"]).groupBy("plan_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ";"), 256).alias("topology_digest"))


