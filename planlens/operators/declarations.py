"""What is wrong with stored access declarations, execution requests and policy decisions: ordered checks over VARIANT columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a declaration of each kind, of a request, and of an approval's reference.
COMMON = ("connector", "connector_version", "input_schema_digest", "kind", "name", "operation", "output_schema_digest", "policy_tags")
FIELDS = {"capability": COMMON, "effect": tuple(sorted((*COMMON, "approval_required", "idempotency")))}
IDEMPOTENCY = ("none", "optional", "required")
REQUEST = ("definition_digest", "run_id", "task_id", "tenant_id", "workflow_id")
REFERENCE = ("request_id", "command_id")
#: Fixed value: names of connectors, operations, policies and reasons, of any length.
STABLE = r"\A[A-Za-z][A-Za-z0-9_.-]*\z"
_LAST = 2**31 - 1


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _member(v: Column, name: str) -> Column:
    return F.try_element_at(_members(v), F.lit(name))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _matches(v: Column, pattern: str) -> Column:
    """A text that holds the pattern; false for anything else."""
    return (_kind(v) == "STRING") & F.coalesce(F.try_variant_get(v, "$", "string").rlike(pattern), F.lit(False))


def _names(v: Column) -> Column:
    return F.sort_array(F.map_keys(_members(v)))


def _first(*checks: tuple[Column, str | Column]) -> Column:
    """The name of the first failed check; null if none failed."""
    return F.coalesce(*(F.when(failed, name) for failed, name in checks))


def _own_defect(members: Column, kind: str) -> Column:
    at = lambda name: F.try_element_at(members, F.lit(name))
    tags = F.try_variant_get(at("policy_tags"), "$", "array<variant>")
    plain = F.try_variant_get(at("policy_tags"), "$", "array<string>")
    untidy = ~_kind(at("policy_tags")).startswith("ARRAY") | F.coalesce(F.exists(tags, lambda t: ~_matches(t, r"\S")), F.lit(True)) | F.coalesce(plain != F.array_sort(F.array_distinct(plain)), F.lit(True))
    checks = [
        (members.isNull(), "NOT_AN_OBJECT"), (~_matches(at("kind"), rf"\A{kind}\z"), "KIND"), (F.sort_array(F.map_keys(members)) != F.array(*map(F.lit, FIELDS[kind])), "FIELDS"),
        *((~_matches(at(c), STABLE), c) for c in ("name", "connector", "operation")),
        ((_kind(at("connector_version")) != "VOID") & ~_matches(at("connector_version"), r"\S"), "connector_version"),
        *((~_matches(at(c), r"\A[0-9a-f]{64}\z"), c) for c in ("input_schema_digest", "output_schema_digest")), (untidy, "policy_tags"),
    ]
    if kind == "effect":
        checks += [(~_matches(at("idempotency"), rf"\A({'|'.join(IDEMPOTENCY)})\z"), "idempotency"), (_kind(at("approval_required")) != "BOOLEAN", "approval_required")]
    return _first(*checks)


def declaration_defects(steps: DataFrame, keys: list[str], text: str, kind: str) -> DataFrame:
    """keys, place, defect: the first defect of each step's declarations (a JSON ``text``) of a kind, ``capability`` or ``effect``.

    In the order of a reader: each declaration's own, then a name that an earlier one has; at last the order
    of all (place null), which is that of their canonical texts. A text that is no array, or null, is NOT_AN_ARRAY. Steps without a defect have no row.
    """
    opened = steps.select(*keys, F.try_parse_json(text).alias("v"))
    items = F.when(_kind(F.col("v")).startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
    opened = opened.withColumn("items", items)
    each = opened.select(*keys, F.posexplode("items").alias("place", "d")).withColumn("m", _members(F.col("d")))
    named = each.select(*keys, "place", _own_defect(F.col("m"), kind).alias("own"), F.try_variant_get(F.try_element_at("m", F.lit("name")), "$", "string").alias("declared"))
    again = F.row_number().over(Window.partitionBy(*keys, "declared").orderBy("place")) > 1
    judged = named.select(*keys, "place", F.coalesce("own", F.when(again, "DUPLICATE_NAME")).alias("defect"))
    texts = F.transform("items", lambda d: F.to_json(d))
    of_all = opened.select(*keys, F.when(F.col("items").isNull(), -1).otherwise(_LAST).alias("place"), F.when(F.col("items").isNull(), "NOT_AN_ARRAY").when(texts != F.array_sort(texts), "NOT_CANONICAL").alias("defect"))
    first = judged.unionByName(of_all).filter("defect is not null").groupBy(*keys).agg(F.min(F.struct("place", "defect")).alias("x"))
    return first.select(*keys, F.when(F.col("x.place").between(0, _LAST - 1), F.col("x.place")).alias("place"), "x.defect")


def request_defect(v: Column) -> Column:
    """Why an execution request is refused, or null: other fields than its five, or one that is no text."""
    no_text = reduce(lambda a, b: a | b, (_kind(_member(v, c)) != "STRING" for c in REQUEST))
    return _first((_members(v).isNull() | F.coalesce(_names(v) != F.array(*map(F.lit, REQUEST)), F.lit(True)), "FIELDS"), (no_text, "NOT_TEXT"))


def decision_defect(v: Column) -> Column:
    """Why a policy's decision can't be recorded, or null: its approval's reference, its answer, its names."""
    approval = _member(v, "approval")
    stated = _kind(approval) != "VOID"
    blank = reduce(lambda a, b: a | b, (~_matches(_member(approval, c), r"\S") for c in REFERENCE))
    return _first(
        (_members(v).isNull(), "NOT_AN_OBJECT"), (stated & blank, "approval"), (_kind(_member(v, "allowed")) != "BOOLEAN", "allowed"),
        *((~_matches(_member(v, c), STABLE), c) for c in ("policy_id", "reason_code")),
    )
