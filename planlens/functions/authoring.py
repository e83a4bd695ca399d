"""Dataflow building blocks as Columns: projection, structures, branches, maps over collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(value: Column, path: str) -> Column:
    """A field at a dotted path."""
    for name in path.split("."):
        value = value.getField(name)
    return value


def structured(**fields: Column) -> Column:
    """An object with its fields in order of name."""
    return F.struct(*(fields[name].alias(name) for name in sorted(fields)))


def parallel(*values: Column) -> Column:
    """A tuple of independent values."""
    return F.struct(*(v.alias(f"_{k}") for k, v in enumerate(values)))


def when(condition: Column, then: Column, otherwise: Column) -> Column:
    """A branch on data. For branches with effects split the rows instead; see ``split``."""
    return F.when(condition, then).otherwise(otherwise)


def split(rows: DataFrame, condition: Column, then: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each branch sees its own rows only; a null condition counts as false."""
    held = F.coalesce(condition, F.lit(False))
    return then(rows.filter(held)).unionByName(otherwise(rows.filter(~held)))


def map_over(rows: DataFrame, owner: str, items: str, key: Callable[[Column], Column], step: Callable[[Column], Column], out: str = "mapped") -> DataFrame:
    """``step`` of every item of an array, in input order, with instances identified by ``key``.

    Keys of one row must be distinct; a row that repeats one fails the job.
    """
    keys = F.transform(items, key)
    distinct = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.col(items)).otherwise(F.raise_error(F.concat(F.lit("repeated map key in "), F.col(owner).cast("string"))))
    instance = lambda x: F.substring(F.sha2(key(x).cast("string"), 256), 1, 24)
    return rows.select("*", F.transform(distinct, lambda x: F.struct(instance(x).alias("instance"), step(x).alias("value"))).alias(out))
