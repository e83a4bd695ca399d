"""Columns by their very names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")
