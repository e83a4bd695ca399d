"""A catalog of trusted functions: fixed ones, and templates with a typed configuration, all pinned by digest.

A function is a SQL expression over ``x``, and over ``config`` if it comes from a
template. Its digest covers identity, types, expression and configuration, so a
function that changed has another one. ``install`` checks all pins before it
makes any of them callable, and what it makes are SQL functions, which Spark
inlines. ``resolved`` checks requests that are rows; the catalog has a few rows of
its own and templates' digests are computed for each row in the JVM.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.functions import typed as ty
from planlens.functions.canonical import canonical, digest_of, object_text, string_text
from planlens.functions.expressions import canonical_json, digest, matches_schema

#: Codes of refusals, in the order in which they are checked.
UNKNOWN, NO_CONFIG, BAD_CONFIG, CHANGED = "NOT_REGISTERED", "CONFIG_NOT_ACCEPTED", "CONFIG_INVALID", "DIGEST_MISMATCH"
_STABLE = re.compile(r"[a-z][a-z0-9_]*")


@dataclass(frozen=True)
class Module:
    """A function from ``x`` of one SQL type to another; a template if it has a data class of its configuration."""

    module_id: str
    version: str
    source: str
    target: str
    body: str
    config: type | None = None

    def identity(self) -> dict[str, str]:
        return {"body": self.body, "input": self.source, "module_id": self.module_id, "output": self.target, "version": self.version}

    def configured(self, config: Mapping[str, Any] | None) -> dict[str, Any]:
        """The whole configuration, defaults included; a ValueError with its code if it isn't one."""
        if self.config is None:
            if config:
                raise ValueError(f"{NO_CONFIG}: {self.module_id}")
            return {}
        if not isinstance(config, Mapping) or not matches_schema(dict(config), ty.type_schema(self.config)):
            raise ValueError(f"{BAD_CONFIG}: {self.module_id}")
        return dataclasses.asdict(self.config(**config))

    def digest(self, config: Mapping[str, Any] | None = None) -> str:
        return digest({**self.identity(), "config": self.configured(config)})


class Catalog:
    """Modules by alias; an alias is a name that SQL can call."""

    def __init__(self, modules: Mapping[str, Module]):
        for alias, m in modules.items():
            if not _STABLE.fullmatch(alias):
                raise ValueError(f"alias isn't a stable name: {alias!r}")
            if not m.version.strip() or not m.module_id.strip():
                raise ValueError(f"{alias} has no identity or version")
        self.modules = dict(sorted(modules.items()))

    def checked(self, alias: str, pin: str | None, config: Mapping[str, Any] | None = None) -> Module:
        if alias not in self.modules:
            raise ValueError(f"{UNKNOWN}: {alias}")
        m = self.modules[alias]
        found = m.digest(config)
        if pin is not None and pin != found:
            raise ValueError(f"{CHANGED}: {alias}")
        return m

    def install(self, spark: SparkSession, pins: Mapping[str, str | None], configs: Mapping[str, Mapping[str, Any]] | None = None) -> None:
        """Make the pinned modules callable in SQL by alias; none of them if one is refused."""
        configs = configs or {}
        ready = [(alias, self.checked(alias, pin, configs.get(alias))) for alias, pin in pins.items()]
        for alias, m in ready:
            body = m.body
            if m.config:
                held = canonical_json(m.configured(configs.get(alias))).replace("\\", "\\\\").replace("'", "\\'")
                body = f"element_at(transform(array(from_json('{held}', '{ty.ddl(m.config)}')), config -> {body}), 1)"
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {alias}(x {m.source}) RETURNS {m.target} RETURN {body}")


def configuration(v: Column, record: type) -> Column:
    """The typed configuration of a VARIANT with the data class's defaults; null if it doesn't fit or has other fields."""
    members = F.try_variant_get(v, "$", "map<string,variant>")
    names, fields = [f.name for f in dataclasses.fields(record)], []
    for (name, kind, optional), f in zip(ty._fields(record), dataclasses.fields(record)):
        value = F.try_variant_get(F.try_element_at(members, F.lit(name)), "$", ty.ddl(kind))
        default = F.lit(None if not optional else f.default if f.default is not dataclasses.MISSING else f.default_factory()).cast(ty.ddl(kind))
        fields.append(F.when(F.map_contains_key(members, name), value).otherwise(default).alias(name))
    only = F.forall(F.map_keys(members), lambda k: k.isin(*names))
    return F.when(ty.fits(v, record) & only, F.struct(*fields))


def _digest_with(m: Module, config: Column) -> Column:
    return digest_of(object_text(config=config, **{k: string_text(F.lit(x)) for k, x in m.identity().items()}))


def resolved(requests: DataFrame, catalog: Catalog) -> DataFrame:
    """``requests`` (alias, pin, config as JSON text) with digest and defect: the first reason why a request is refused.

    A null pin asks for no digest. A null alias isn't registered; a fixed module
    takes no configuration but a null or empty one; a template needs one.
    """
    spark = requests.sparkSession
    v = F.try_parse_json("config")
    defect, found = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    rows = requests.withColumn("_v", v)
    for alias, m in catalog.modules.items():
        mine = F.col("alias") == alias
        if m.config:
            name = f"_{alias}"
            rows = rows.withColumn(name, F.when(mine, configuration(F.col("_v"), m.config)))
            kind = spark.range(0).select(configuration(F.parse_json(F.lit("{}")), m.config).alias("c")).schema["c"].dataType
            defect = defect.when(mine & F.col(name).isNull(), BAD_CONFIG)
            found = found.when(mine & F.col(name).isNotNull(), _digest_with(m, canonical(F.col(name), kind)))
        else:
            empty = F.col("config").isNull() | F.coalesce(F.size(F.try_variant_get("_v", "$", "map<string,variant>")) == 0, F.lit(False)) | F.coalesce(F.schema_of_variant("_v") == "VOID", F.lit(False))
            defect = defect.when(mine & ~empty, NO_CONFIG)
            found = found.when(mine & empty, m.digest())
    known = F.coalesce(F.col("alias").isin(*catalog.modules), F.lit(False))
    rows = rows.withColumn("digest", found).withColumn("defect", F.when(~known, UNKNOWN).otherwise(defect))
    rows = rows.withColumn("defect", F.coalesce("defect", F.when(F.col("pin").isNotNull() & (F.col("pin") != F.col("digest")), CHANGED)))
    return rows.select(*requests.columns, "digest", "defect")


def applied(rows: DataFrame, m: Module, out: str = "result") -> DataFrame:
    """``rows`` (x, config as JSON text, others) with the module's result; null where the configuration is refused."""
    if m.config is None:
        return rows.withColumn(out, F.expr(m.body))
    typed = rows.withColumn("config", configuration(F.try_parse_json("config"), m.config))
    return typed.withColumn(out, F.when(F.col("config").isNotNull(), F.expr(m.body))).drop("config")
