"""Recorded against current behavior: comparison flags, outcomes, broker decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes of a replay.
PASS, CHANGED, DIVERGENCE, LIVE_FAILURE, EFFECT_VIOLATION, BUDGET_EXCEEDED = "PASS", "CHANGED", "REPLAY_DIVERGENCE", "REPLAY_LIVE_FAILURE", "REPLAY_EFFECT_VIOLATION", "REPLAY_BUDGET_EXCEEDED"
#: Why a read is refused, in order of the checks.
READ_LADDER = ("not-declared", "not-granted", "request-contract", "request-not-canonical", "policy-error", "invalid-decision", "policy-denied", "adapter-not-registered", "adapter-error", "response-contract", "response-not-canonical")
#: Why an effect is refused or how it ends, in order of the checks.
EFFECT_LADDER = ("not-declared", "not-granted", "request-contract", "request-not-canonical", "durability-unavailable", "identity-conflict", "already-committed", "policy-error", "invalid-decision", "policy-denied", "approval-required", "adapter-not-registered", "idempotency-required", "unsafe-retry", "approval-evidence-invalid", "adapter-error", "response-contract", "response-not-canonical")


def comparisons(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Per step: what differs; behavior is all but latency."""
    names = ("module_digest", "tool_calls", "cost_usd", "wall_time_ms")
    now = current.select("plan_id", "i", *(F.col(c).alias(f"{c}_now") for c in names))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"{c}_now"))
    flags = recorded.join(now, ["plan_id", "i"]).select("plan_id", "i", differs("module_digest").alias("output_changed"), differs("tool_calls").alias("tools_changed"), differs("cost_usd").alias("cost_changed"), differs("wall_time_ms").alias("latency_changed"))
    return flags.withColumn("behavior_changed", F.col("output_changed") | F.col("tools_changed") | F.col("cost_changed"))


def ladder(checks: dict[str, Column], order: tuple[str, ...], otherwise: str = "used") -> Column:
    """The first reason, in order, whose check fails."""
    out = None
    for reason in order:
        if reason in checks:
            out = out.when(checks[reason], reason) if out is not None else F.when(checks[reason], reason)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def outcomes(steps: DataFrame, budget: float) -> DataFrame:
    """Outcome of each replayed plan: effect violation, failure, divergence, budget, changed or pass, the first that holds."""
    per = steps.groupBy("plan_id").agg(F.bool_or("effect_violation").alias("effect"), F.bool_or("failed").alias("failed"), F.bool_or("diverged").alias("diverged"), F.sum("live_cost").alias("cost"), F.bool_or("behavior_changed").alias("changed"))
    result = F.when(F.col("effect"), EFFECT_VIOLATION).when(F.col("failed"), LIVE_FAILURE).when(F.col("diverged"), DIVERGENCE).when(F.col("cost") > budget, BUDGET_EXCEEDED).when(F.col("changed"), CHANGED).otherwise(PASS)
    return per.select("plan_id", result.alias("outcome"))
