"""Canonical JSON of typed columns, written by the JVM: keys sorted, no blanks, characters as they are.

The text is built from the column's type, so a struct's keys are sorted when the
query is planned. What JSON can't hold (a non-finite number) makes the whole
text null; types without a canonical form are refused when the query is planned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DoubleType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructType

#: Characters with an escape of two characters.
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def string_text(x: Column) -> Column:
    """A quoted text; control characters without a short escape become \\u00XX."""
    short = x
    for plain, escaped in _SHORT.items():
        short = F.replace(short, F.lit(plain), F.lit(escaped))
    one = lambda c: F.when(c.rlike(r"^[\x00-\x1f]$"), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0")))).otherwise(c)
    body = F.when(~x.rlike(r'["\\\x00-\x1f]'), x).otherwise(F.array_join(F.transform(F.split(short, ""), one), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


#: Doubles whose usual text is already the shortest one.
_PLAIN_NUMBER = r"^-?[0-9]{1,6}\.(?:0|[0-9]{0,5}[1-9])$"


def number_text(x: Column) -> Column:
    """The shortest digits that give back a double; an exponent below 1e-4 and from 1e16 on.

    Of several 17-digit texts for one double the JVM (before Java 19) may take another than
    the nearest, and it writes the smallest subnormals with a digit too many.
    """
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    usual = lambda t: F.when(t.rlike(_PLAIN_NUMBER), t).otherwise(_shortest(x))
    return F.when(~bad, let(x.cast("string"), usual))


def _shortest(x: Column) -> Column:
    tries = [F.format_string(f"%.{k}e", x) for k in (14, 15, 16)]
    exact = F.coalesce(*(let(t, lambda t: F.when(t.cast("double") == x, t)) for t in tries), x.cast("string"))
    form = r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"
    parts = lambda t: F.struct(
        F.when(t.startswith("-"), "-").otherwise("").alias("sign"), F.length(F.regexp_extract(t, form, 1)).alias("whole"),
        F.concat(F.regexp_extract(t, form, 1), F.regexp_extract(t, form, 2)).alias("every"), F.coalesce(F.regexp_replace(F.regexp_extract(t, form, 3), "[+]", "").try_cast("int"), F.lit(0)).alias("power"),
    )
    laid = lambda p: F.struct(
        p["sign"].alias("sign"), F.regexp_replace(p["every"], "^0+|0+$", "").alias("digits"),
        (p["whole"] + p["power"] - F.length(p["every"]) + F.length(F.regexp_replace(p["every"], "^0+", ""))).alias("point"),
    )

    def text(p: Column) -> Column:
        digits, point, n, power = p["digits"], p["point"], F.length(p["digits"]), p["point"] - 1
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(n <= point, F.concat(F.rpad(digits, point, F.lit("0")), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )
        size = F.abs(power).cast("string")
        raised = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
        return F.concat(p["sign"], F.when(n == 0, "0.0").when(power.between(-4, 15), fixed).otherwise(raised))

    return let(let(let(exact, parts), laid), text)


def list_text(items: Column) -> Column:
    """An array of JSON texts as one; null if one of them is."""
    return let(items, lambda i: F.when(~F.exists(i, lambda t: t.isNull()), F.concat(F.lit("["), F.array_join(i, ","), F.lit("]"))))


def object_text(**fields: Column) -> Column:
    """JSON texts as an object; null if one of them is."""
    parts = [F.concat(F.lit(f'{"," if k else ""}"{name}":'), fields[name]) for k, name in enumerate(sorted(fields))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def canonical(x: Column, kind: DataType) -> Column:
    """The canonical JSON of a column of this type."""
    if isinstance(kind, StringType):
        text = string_text(x)
    elif isinstance(kind, BooleanType | ByteType | ShortType | IntegerType | LongType):
        text = x.cast("string")
    elif isinstance(kind, DoubleType):
        text = number_text(x)
    elif isinstance(kind, BinaryType):
        text = F.concat(F.lit('{"$bytes":"'), F.lower(F.hex(x)), F.lit('"}'))
    elif isinstance(kind, ArrayType):
        text = list_text(F.transform(x, lambda v: canonical(v, kind.elementType)))
    elif isinstance(kind, StructType):
        text = F.concat(
            F.lit("{"),
            *(y for k, f in enumerate(sorted(kind.fields, key=lambda f: f.name)) for y in (F.concat(F.lit("," if k else ""), string_text(F.lit(f.name)), F.lit(":")), canonical(x.getField(f.name), f.dataType))),
            F.lit("}"),
        )
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.array_sort(F.map_entries(x), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        items = F.transform(entries, lambda e: F.concat(string_text(e["key"]), F.lit(":"), canonical(e["value"], kind.valueType)))
        text = let(items, lambda i: F.when(~F.exists(i, lambda t: t.isNull()), F.concat(F.lit("{"), F.array_join(i, ","), F.lit("}"))))
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical form")
    return F.when(x.isNull(), F.lit("null")).otherwise(text)


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)
