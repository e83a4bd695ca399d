"""Validation of plan fragments: ranked codes, the first of which is the answer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.plans.metrics import analyse

#: What a fragment and a node consist of, and the version.
FRAGMENT_FIELDS, NODE_FIELDS, VERSION = ("fragment_id", "nodes", "outputs", "version"), ("dependencies", "key", "module_alias"), "0.2.0"
#: Codes of refusals.
FORM, VERSION_UNSUPPORTED, TOPOLOGY, LIMIT, SCHEMA = "PLAN_FRAGMENT_INVALID", "PLAN_FRAGMENT_VERSION_UNSUPPORTED", "PLAN_TOPOLOGY_INVALID", "PLAN_LIMIT_EXCEEDED", "PLAN_SCHEMA_INVALID"
NOT_ALLOWED, ESCALATION, OVER_BUDGET = "PLAN_MODULE_NOT_ALLOWED", "PLAN_CAPABILITY_ESCALATION", "PLAN_BUDGET_EXCEEDED"
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]{0,127}")
INPUT = "$input"


@dataclass(frozen=True)
class Limits:
    max_nodes: int = 1_000
    max_depth: int = 1_000
    max_fanout: int = 1_000
    budget: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Entry:
    """A module of the catalog: arity and schemas, and what it may use."""

    inputs: tuple[str, ...] = ("any",)
    output: str = "any"
    budget: dict[str, float | None] = field(default_factory=dict)
    effects: tuple[str, ...] = ()


def decode(fragment: dict) -> str | None:
    """The first defect of a fragment's form, or none."""
    if tuple(sorted(fragment)) != FRAGMENT_FIELDS:
        return FORM
    if fragment["version"] != VERSION:
        return VERSION_UNSUPPORTED
    keys = []
    for node in fragment["nodes"]:
        if tuple(sorted(node)) != NODE_FIELDS:
            return FORM
        if not _NAME.fullmatch(node["key"]) or not _NAME.fullmatch(node["module_alias"]):
            return FORM
        if not all(d == INPUT or _NAME.fullmatch(d) for d in node["dependencies"]):
            return FORM
        keys.append(node["key"])
    if keys != sorted(keys):
        return FORM
    if len(set(keys)) < len(keys):
        return TOPOLOGY
    return None if all(map(_NAME.fullmatch, fragment["outputs"])) else FORM


def resolve(fragment: dict, catalog: dict[str, Entry], limits: Limits, grant: tuple[str, ...] | None = None) -> str | None:
    """The first violation in the fixed order of checks, or none."""
    if code := decode(fragment):
        return code
    nodes = {n["key"]: n for n in fragment["nodes"]}
    outputs = fragment["outputs"]
    if not nodes:
        return TOPOLOGY
    if len(nodes) > limits.max_nodes:
        return LIMIT
    if not outputs:
        return TOPOLOGY
    if len(set(outputs)) < len(outputs):
        return TOPOLOGY
    if any(o not in nodes for o in outputs):
        return TOPOLOGY
    keys = list(nodes)
    found = analyse(keys, {k: nodes[k]["dependencies"] for k in keys}, {}, outputs)
    if found["missing"]:
        return TOPOLOGY
    if found["unreachable"]:
        return TOPOLOGY
    for k in keys:
        if nodes[k]["module_alias"] not in catalog:
            return NOT_ALLOWED
        deps = nodes[k]["dependencies"]
        if len(set(deps)) < len(deps):
            return TOPOLOGY
        if len(deps) != len(catalog[nodes[k]["module_alias"]].inputs):
            return SCHEMA
    if found["cyclic"]:
        return TOPOLOGY
    if found["max_depth"] > limits.max_depth:
        return LIMIT
    users = Counter(d for k in keys for d in nodes[k]["dependencies"])
    if max(users.values(), default=0) > limits.max_fanout:
        return LIMIT
    entries = {k: catalog[nodes[k]["module_alias"]] for k in keys}
    for k in keys:
        for want, dep in zip(entries[k].inputs, nodes[k]["dependencies"]):
            if dep != INPUT and want != "any" and entries[dep].output not in ("any", want):
                return SCHEMA
    if grant is not None and any(e not in grant for k in keys for e in entries[k].effects):
        return ESCALATION
    for dimension, limit in limits.budget.items():
        values = [entries[k].budget.get(dimension) for k in keys]
        if None in values or sum(values) > limit:
            return OVER_BUDGET
    return None


def first_violations(fragments: DataFrame, catalog: dict[str, Entry], limits: Limits) -> DataFrame:
    """plan_id and the first violation of every fragment (plan_id, nodes array of key, module_alias, dependencies; outputs), in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = []
            for nodes, outputs in zip(frame["nodes"], frame["outputs"]):
                plain = [{"key": n["key"], "module_alias": n["module_alias"], "dependencies": list(n["dependencies"])} for n in nodes]
                codes.append(resolve({"fragment_id": "f", "version": VERSION, "nodes": plain, "outputs": list(outputs)}, catalog, limits))
            yield pd.DataFrame({"plan_id": frame["plan_id"], "code": codes})

    return fragments.select("plan_id", "nodes", "outputs").mapInPandas(run, "plan_id long, code string")


def numbered_violations(nodes: DataFrame, edges: DataFrame, catalog: dict[str, Entry], limits: Limits) -> DataFrame:
    """plan_id and the first violation of numbered plans.

    Nodes are counted first, and the few checks before that limit made as flags, so
    that only plans of at most ``max_nodes`` nodes are collected to a row.
    """
    rows = fragment_nodes(nodes, edges)
    named = F.coalesce(F.col("key").rlike(rf"\A{_NAME.pattern}\z") & F.col("module_alias").rlike(rf"\A{_NAME.pattern}\z"), F.lit(False))
    keys = rows.groupBy("plan_id", "key").agg(F.count("*").alias("n"), F.bool_and(named).alias("named"))
    plans = keys.groupBy("plan_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.bool_and("named").alias("named")).filter(F.col("n") > limits.max_nodes)
    code = F.when(~F.col("named"), FORM).when(F.col("most") > 1, TOPOLOGY).otherwise(LIMIT)
    small = collected(rows.join(plans.select("plan_id"), "plan_id", "left_anti"))
    return first_violations(small, catalog, limits).unionByName(plans.select("plan_id", code.alias("code")))


def fragment_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """plan_id, key, module_alias, dependencies of the nodes of numbered plans, and whether another depends on them."""
    key = lambda c: F.when(F.col(c) == 0, F.lit(INPUT)).otherwise(F.format_string("n%05d", c))
    deps = edges.groupBy("plan_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", key("dep").alias("d")))), lambda x: x["d"]).alias("dependencies"))
    used = edges.select("plan_id", F.col("dep").alias("i")).distinct().withColumn("used", F.lit(True))
    alias = F.replace("module_id", F.lit("#"), F.lit("-"))
    return nodes.join(deps, ["plan_id", "i"]).join(used, ["plan_id", "i"], "left").select("plan_id", key("i").alias("key"), alias.alias("module_alias"), "dependencies", "used")


def fragments_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Fragments of numbered plans; the nodes that nothing depends on are the outputs."""
    return collected(fragment_nodes(nodes, edges))


def collected(rows: DataFrame) -> DataFrame:
    """A fragment for each plan of ``fragment_nodes``."""
    ends = F.sort_array(F.collect_list(F.when(F.col("used").isNull(), F.col("key"))))
    return rows.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("key", "module_alias", "dependencies"))).alias("nodes"), ends.alias("outputs"))
