"""Evidence, guardrails and what becomes of a recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CANON

# Least spend (minor units) by window length, and confidence factors.
MIN_SPEND = {7: 250_000, 14: 500_000, 28: 1_000_000, 56: 2_000_000}
RECENT_CHANGE_FACTOR, COMPOSITE_FACTOR = 0.6, 0.75


def evidence_state(owner: Column, spend: Column, impressions: Column) -> Column:
    return F.when(owner == "UNKNOWN", "NO_DECISION_UNIT").when((spend <= 0) & (impressions <= 0), "NOT_DELIVERING").otherwise("EVIDENCE")


def violations(df: DataFrame, floor: Column, min_spend: Column, max_percent: float = CANON.max_change_percent) -> Column:
    """Array of (code, field, source, limit) from kind, owner, unit_owns, spend, impressions, purchases and percent.

    Proposals of insufficient data are not checked against the evidence."""
    checked = df["kind"] != "INSUFFICIENT_DATA"
    row = lambda code, field, source, limit: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(source).alias("source"), limit.cast("double").alias("limit"))
    none = F.lit(None)
    state = evidence_state(df["owner"], df["spend"], df["impressions"])
    rules = (
        (state == "NO_DECISION_UNIT", row("NO_DECISION_UNIT", "unit", None, none)),
        ((state != "NO_DECISION_UNIT") & ~df["unit_owns"], row("DECISION_UNIT_NOT_BUDGET_OWNER", "unit", None, none)),
        (state == "NOT_DELIVERING", row("NOT_DELIVERING", "spend", None, none)),
        (df["purchases"] < floor, row("MIN_PURCHASES_NOT_MET", "purchases", "floors", floor)),
        (df["spend"] < min_spend, row("MIN_SPEND_NOT_MET", "spend", "min_spend", min_spend)),
        (F.abs(df["percent"]) > max_percent, row("MAX_CHANGE_PERCENT_EXCEEDED", "percent", "max_change", F.lit(max_percent))),
    )
    return F.array_compact(F.array(*[F.when(checked & F.coalesce(rule, F.lit(False)), what) for rule, what in rules]))


def adjusted_confidence(confidence: Column, recent_change: Column, composite_and_tired: Column) -> Column:
    out = confidence * F.when(recent_change, RECENT_CHANGE_FACTOR).otherwise(1.0) * F.when(composite_and_tired, COMPOSITE_FACTOR).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def judged(proposals: DataFrame, found: Column) -> DataFrame:
    """Proposals with violations; a rejected one is downgraded and says why."""
    v = proposals.withColumn("violations", found)
    bad = F.size("violations") > 0
    reason = F.array_join(F.transform("violations", lambda x: x["code"]), " | ")
    return v.withColumn("final_kind", F.when(bad, "INSUFFICIENT_DATA").otherwise(F.col("kind"))).withColumn("rejection_reason", F.when(bad, reason))


def accepted(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision changes a recommendation only if it is complete and undecided; of several the first counts."""
    first = decisions.groupBy("rec_id").agg(F.min_by("decision", F.struct("at", "decision")).alias("new"), F.min("at").alias("at"))
    ok = (F.col("status") == "COMPLETE") & F.col("decision").isNull() & F.col("new").isNotNull()
    r = recs.join(first, "rec_id", "left")
    return r.select("rec_id", "status", F.when(ok, F.col("new")).otherwise(F.col("decision")).alias("decision"), F.when(ok, F.col("at")).alias("decided_at"), F.when(F.col("new").isNotNull() & ~ok, F.when(F.col("status") != "COMPLETE", "NOT_COMPLETE").otherwise("ALREADY_DECIDED")).alias("refused"))
