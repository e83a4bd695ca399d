"""Scalar expressions: names, digests, units, sets, canonical JSON."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from collections.abc import Set as AbstractSet
from dataclasses import fields, is_dataclass
from enum import Enum
from functools import singledispatch
from pathlib import PurePath

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from planlens.workspace import ship_package

#: Bytes of each memory unit.
MEMORY_UNITS = {"KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
#: Names in plans, and names in access declarations, which may be longer.
STABLE_NAME = r"\A[A-Za-z][A-Za-z0-9_.-]{0,127}\z"
ACCESS_NAME = r"\A[A-Za-z][A-Za-z0-9_.-]*\z"
SHA256_HEX = "^[0-9a-f]{64}$"
#: Configuration keys that hold secrets.
SECRET_KEYS = ("api_key", "credential", "credentials", "password", "secret", "token")
INLINE_LIMIT = 16_384


def memory_bytes(text: Column) -> Column:
    """Bytes of a text such as 512MiB; null if it isn't a positive amount with a unit."""
    number = F.expr("null").cast("long")
    out = number
    for unit, size in MEMORY_UNITS.items():
        digits = F.regexp_extract(text, rf"\A([1-9][0-9]*){unit}\z", 1)
        out = F.coalesce(out, F.when(digits != "", digits.cast("long") * F.lit(size)))
    return out


def replay_key(module_id: Column, step: Column) -> Column:
    return F.concat(F.lit("replay-v1:"), module_id, F.lit("@"), step.cast("string"))


def instance_id(key: Column, scope: Column) -> Column:
    """24 hex digits that identify a step in a scope."""
    return F.substring(F.sha2(F.concat(F.lit('{"replay_key":"'), key, F.lit('","scope":"'), scope, F.lit('"}')), 256), 1, 24)


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def is_secret_key(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("-"), F.lit("_"))).isin(*SECRET_KEYS)


def has_secret_key(text: Column) -> Column:
    """Whether a JSON text has a key that holds a secret, at any depth."""
    names = "|".join(k.replace("_", "[_-]") for k in SECRET_KEYS)
    return text.rlike(rf'(?i)(?<!\\)"(?:{names})"\s*:')


def without_prefix(name: Column, prefix: str) -> Column:
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(name)


def stored_form(text: Column, limit: int = INLINE_LIMIT) -> Column:
    """Where a value is kept: inline up to ``limit`` bytes, else as an artifact; nowhere if null."""
    return F.when(text.isNull(), "UNAVAILABLE").when(F.octet_length(text) <= limit, "INLINE").otherwise("ARTIFACT")


@singledispatch
def _plain(value):
    """What ``json`` can write for a value that it doesn't know."""
    if is_dataclass(value) and not isinstance(value, type):
        return {f.name: getattr(value, f.name) for f in fields(value)}
    raise TypeError(f"{type(value).__name__} has no canonical form")


_plain.register(Enum)(lambda value: value.value)
_plain.register(bytes)(lambda value: {"$bytes": value.hex()})
_plain.register(PurePath)(str)
_plain.register(AbstractSet)(lambda value: sorted(value, key=canonical_json))
_plain.register(Mapping)(dict)
_plain.register(Sequence)(list)


def _with_text_keys(value):
    """``value``, if no mapping in its lists and mappings has another key than text."""
    open_ = [value]
    while open_:
        item = open_.pop()
        if isinstance(item, dict):
            if not all(isinstance(k, str) for k in item):
                raise TypeError("keys must be text")
            open_ += item.values()
        elif isinstance(item, list | tuple):
            open_ += item
    return value


def canonical_json(value) -> str:
    """Sorted keys, no blanks, characters as they are; sets in order of their items' text; what JSON can't hold is refused."""
    return json.dumps(_with_text_keys(value), default=lambda v: _with_text_keys(_plain(v)), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_data(value):
    """Plain JSON data of a value."""
    return json.loads(canonical_json(value))


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def _canonical_or_null(text: str | None) -> str | None:
    try:
        return None if text is None else canonical_json(json.loads(text))
    except ValueError:
        return None


def canonical_text(text: Column) -> Column:
    """Canonical form of JSON texts, in Arrow batches of bounded bytes; null where a text isn't JSON."""
    ship_package(SparkSession.active())

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_canonical_or_null)

    return F.pandas_udf(run, StringType())(text)


def name_uuid(name: Column) -> Column:
    """Version-5 UUIDs of names in the URL space."""
    space = F.unhex(F.lit(uuid.NAMESPACE_URL.hex))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: What each simple type of a schema takes; no boolean is a number.
SIMPLE_TYPES = {
    "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
}


def _fits(value, schema) -> bool:
    """Like ``matches_schema``; true and false are schemas too."""
    return schema if isinstance(schema, bool) else isinstance(schema, Mapping) and matches_schema(value, schema)


def _fits_items(value, schema: Mapping) -> bool:
    if not isinstance(value, list | tuple):
        return False
    each = schema.get("prefixItems", [schema.get("items", {})] * len(value))
    return len(each) == len(value) and all(isinstance(s, Mapping) and matches_schema(v, s) for v, s in zip(value, each))


def _fits_fields(value, schema: Mapping) -> bool:
    known, others = schema.get("properties", {}), schema.get("additionalProperties", {})
    whole = isinstance(value, Mapping) and all(k in value for k in schema.get("required", ()))
    return whole and all(_fits(v, known.get(k, others)) for k, v in value.items())


_BY_TYPE = {"array": _fits_items, "object": _fits_fields} | {k: (lambda value, _, fits=fits: fits(value)) for k, fits in SIMPLE_TYPES.items()}


def matches_schema(value, schema: Mapping) -> bool:
    """Whether plain JSON data fits a schema of the small subset used for values.

    A schema without a known type takes anything, unless it names a Python type.
    """
    if isinstance(schema.get("anyOf"), Sequence):
        return any(isinstance(s, Mapping) and matches_schema(value, s) for s in schema["anyOf"])
    check = _BY_TYPE.get(schema.get("type"))
    return check(value, schema) if check else "pythonType" not in schema


def fits_schema(text: Column, schema: Mapping) -> Column:
    """Whether JSON texts fit a schema, in Arrow batches; null where a text isn't JSON."""

    def judge(one: str | None) -> bool | None:
        try:
            return None if one is None else matches_schema(json.loads(one), schema)
        except ValueError:
            return None

    return F.pandas_udf(lambda texts: texts.map(judge).astype("object"), BooleanType())(text)
