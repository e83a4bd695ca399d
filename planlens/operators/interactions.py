"""What a resolved interaction gives its task, stored grants, and declarations as signatures, by column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from planlens.functions.typed import fits

#: Decisions of an approval.
DECISIONS = ("approve", "reject")


def _text(v: Column, name: str) -> Column:
    """A member that is a text; null otherwise."""
    member = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(member, "$", "string"))


def approval(resolution: Column) -> Column:
    """approved, comment, reason, command_id of an approval's resolution (VARIANT); null without a valid decision. A rejection is a value, not an error."""
    decision = _text(resolution, "decision")
    made = F.struct((decision == "approve").alias("approved"), *(_text(resolution, c).alias(c) for c in ("comment", "reason", "command_id")))
    return F.when(decision.isin(*DECISIONS), made)


def resolution_defect(kind: Column, resolution: Column, signal_name: Column, output: Any) -> Column:
    """Why a resolution gives no result, or null: its decision, its signal's name, or a value that isn't of the ``output`` type."""
    value = F.try_variant_get(resolution, "$.value", "variant")
    return (
        F.when((kind == "approval") & F.coalesce(~_text(resolution, "decision").isin(*DECISIONS), F.lit(True)), "DECISION_INVALID")
        .when((kind == "signal") & ~_text(resolution, "name").eqNullSafe(signal_name), "SIGNAL_NAME").when(kind.isin("input", "signal") & ~fits(value, output), "OUTPUT_CONTRACT")
    )


def stored_grant(text: Column) -> Column:
    """capabilities, effects, defect of a stored grant (JSON text).

    Anything but an object, as older rows hold, gives no access. An object must
    have exactly its two lists of names, sorted and without repeats; one that is wrong gives no access and a defect.
    """
    v = F.try_parse_json(text)
    members = F.try_variant_get(v, "$", "map<string,variant>")
    at = lambda name: F.try_element_at(members, F.lit(name))
    names = lambda name: F.try_variant_get(at(name), "$", "array<string>")
    each = lambda test: F.coalesce(test(F.lit("capabilities")) | test(F.lit("effects")), F.lit(True))
    item = lambda name: F.try_element_at(members, name)
    no_list = each(lambda n: ~F.coalesce(F.schema_of_variant(item(n)), F.lit("")).startswith("ARRAY"))
    no_name = each(lambda n: F.exists(F.try_variant_get(item(n), "$", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING"))
    loose = each(lambda n: F.try_variant_get(item(n), "$", "array<string>") != F.array_sort(F.array_distinct(F.try_variant_get(item(n), "$", "array<string>"))))
    fields = F.sort_array(F.map_keys(members)) != F.array(F.lit("capabilities"), F.lit("effects"))
    defect = F.when(members.isNull(), None).when(fields, "FIELDS").when(no_list, "NOT_LISTS").when(no_name, "NOT_NAMES").when(loose, "NOT_CANONICAL")
    none = F.array().cast("array<string>")
    whole = members.isNotNull() & defect.isNull()
    return F.struct(*(F.when(whole, names(c)).otherwise(none).alias(c) for c in ("capabilities", "effects")), defect.cast("string").alias("defect"))


def connector_signature(capabilities: Column, effects: Column) -> Column:
    """What a step asks of connectors, in the order of its declarations (arrays of structs)."""
    return F.transform(F.concat(capabilities, effects), lambda d: F.struct(*(d[c].alias(c) for c in ("name", "connector", "operation", "connector_version"))))


def policy_signature(capabilities: Column, effects: Column) -> Column:
    """What a step's declarations say to policies, in their order."""
    return F.transform(F.concat(capabilities, effects), lambda d: F.struct(*(d[c].alias(c) for c in ("name", "policy_tags", "approval_required"))))


def budget_signature(budget: Column, dimensions: tuple[str, ...] = ("cost_usd", "model_tokens", "tool_calls", "wall_time_ms")) -> Column:
    """A step's budget; a missing one is the budget without bounds."""
    return F.struct(*(budget[c].alias(c) for c in dimensions))
