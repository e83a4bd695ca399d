"""Names that a JSON text repeats within one object: Spark's parsers keep one of them in silence."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Pairs(list):
    """An object's names and values as they stand in the text."""


def repeated_keys(text: str | None) -> list[str] | None:
    """Paths of names that stand twice or more in their object, sorted, each once; None for no text, or one that isn't JSON or nests too deep to be read."""
    if text is None:
        return None
    try:
        todo, found = [("$", json.loads(text, object_pairs_hook=_Pairs))], set()
    except (ValueError, RecursionError):
        return None
    while todo:
        path, value = todo.pop()
        if isinstance(value, _Pairs):
            seen: set[str] = set()
            for name, inner in value:
                if name in seen:
                    found.add(f"{path}.{name}")
                seen.add(name)
                todo.append((f"{path}.{name}", inner))
        elif isinstance(value, list):
            todo += [(f"{path}[{j}]", inner) for j, inner in enumerate(value)]
    return sorted(found)


def repeated(text: Column) -> Column:
    """``repeated_keys`` of a column."""

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(repeated_keys)

    return find(text)
