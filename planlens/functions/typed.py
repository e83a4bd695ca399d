"""Values against Python types: a type that is known when a query is planned becomes its schema, a test and a typed column.

Values are VARIANT columns, so nothing is decoded in Python. A whole number with 19
digits or more and a zero fraction (``10000000000000000000.0``) can't be told from an integer.
"""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlens.functions.expressions import canonical_json, digest

#: Names of plain types in schemas.
PLAIN = {str: "string", int: "integer", float: "number", bool: "boolean", type(None): "null"}
_DDL = {str: "string", int: "bigint", float: "double", bool: "boolean", type(None): "void"}


def _shape(annotation: Any) -> tuple[str, tuple]:
    """How a type is made: its constructor and arguments."""
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if annotation is Any:
        return "any", ()
    if annotation is None or annotation in PLAIN:
        return "plain", (type(None) if annotation is None else annotation,)
    if dataclasses.is_dataclass(annotation):
        return "record", ()
    if origin in (typing.Union, types.UnionType):
        return "union", args
    if origin in (list, Sequence):
        return "list", args or (Any,)
    if origin is tuple:
        return "tuple", args
    if origin in (dict, Mapping):
        return "map", args or (Any, Any)
    return "other", ()


def _fields(record: Any) -> list[tuple[str, Any, bool]]:
    """name, type, optional of a data class's fields."""
    hints = typing.get_type_hints(record)
    missing = dataclasses.MISSING
    return [(f.name, hints.get(f.name, Any), f.default is not missing or f.default_factory is not missing) for f in dataclasses.fields(record)]


def type_schema(annotation: Any) -> dict[str, Any]:
    """The schema of a type."""
    shape, args = _shape(annotation)
    if shape == "plain":
        return {"type": PLAIN[args[0]]}
    if shape == "record":
        fields = _fields(annotation)
        required = [name for name, _, optional in fields if not optional]
        made = {"type": "object", "title": f"{annotation.__module__}.{annotation.__qualname__}", "properties": {n: type_schema(t) for n, t, _ in fields}, "additionalProperties": False}
        return made | ({"required": required} if required else {})
    if shape == "other":
        return {"type": "string", "contentEncoding": "hex"} if annotation is bytes else {"pythonType": f"{annotation.__module__}.{annotation.__qualname__}"}
    return {
        "any": lambda: {}, "union": lambda: {"anyOf": [type_schema(a) for a in args]}, "list": lambda: {"type": "array", "items": type_schema(args[0])},
        "tuple": lambda: {"type": "array", "prefixItems": [type_schema(a) for a in args]}, "map": lambda: {"type": "object", "additionalProperties": type_schema(args[-1])},
    }[shape]()


def schema_text(annotation: Any) -> str:
    return canonical_json(type_schema(annotation))


def schema_digest(annotation: Any) -> str:
    return digest(type_schema(annotation))


def fits(v: Column, annotation: Any) -> Column:
    """Whether a VARIANT, read as a value of the type, is one; never null.

    A truth value is also an integer, an integer is no float, an absent value is null. A
    data class takes objects with its required fields, and leaves others out; a
    tuple takes arrays of its length; a type without a form in JSON takes nothing.
    """
    shape, args = _shape(annotation)
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    whole = kind.rlike(r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$")
    if shape == "any":
        return F.lit(True)
    if shape == "plain":
        tests = {str: kind == "STRING", bool: kind == "BOOLEAN", type(None): kind == "VOID", int: whole | (kind == "BOOLEAN"), float: kind.rlike("^(DOUBLE|FLOAT|DECIMAL)") & ~whole}
        return tests[args[0]]
    if shape == "union":
        out = F.lit(False)
        for a in args:
            out = out | fits(v, a)
        return out
    items, members = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    yes = lambda test: F.coalesce(test, F.lit(False))
    if shape == "list":
        return kind.startswith("ARRAY") & yes(F.forall(items, lambda x: fits(x, args[0])))
    if shape == "tuple":
        test = kind.startswith("ARRAY") & yes(F.size(items) == len(args))
        for j, a in enumerate(args):
            test = test & fits(F.get(items, j), a)
        return test
    is_object = kind.startswith("OBJECT")
    if shape == "map":
        keys = F.lit(True) if args[0] in (str, Any) else yes(F.size(members) == 0)
        return is_object & keys & yes(F.forall(F.map_values(members), lambda x: fits(x, args[1])))
    if shape == "record":
        for name, a, optional in _fields(annotation):
            there = yes(F.map_contains_key(members, name))
            is_object = is_object & F.when(there, fits(F.try_element_at(members, F.lit(name)), a)).otherwise(optional)
        return is_object
    return F.lit(False)


def ddl(annotation: Any) -> str:
    """The Spark type of a type's values; one that holds values of several forms stays VARIANT."""
    shape, args = _shape(annotation)
    if shape == "plain":
        return _DDL[args[0]]
    if shape == "union":
        some = [a for a in args if a is not type(None)]
        return ddl(some[0]) if len(some) == 1 else "variant"
    if shape == "list":
        return f"array<{ddl(args[0])}>"
    if shape == "map":
        return f"map<string,{ddl(args[1])}>"
    if shape == "record":
        return "struct<" + ",".join(f"`{n}`:{ddl(t)}" for n, t, _ in _fields(annotation)) + ">"
    return "variant"


def rehydrated(v: Column, annotation: Any) -> Column:
    """The typed value of a VARIANT that fits; null for one that doesn't."""
    return F.when(fits(v, annotation), F.try_variant_get(v, "$", ddl(annotation)))
