"""Evidence for a decision: what is known of the unit that owns the budget, as one nested document a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E
from tallyforge.operators.backtest import confidence
from tallyforge.operators.bitemporal import SUGGESTED_HIGH, SUGGESTED_LOW

#: Days of a recent change by kind of setting, and hours after which a targeting and a status change are no longer major.
RECENT_DAYS = {"BUDGET": 7, "TARGETING": 14, "CREATIVE_ASSIGNMENT": 7}
TARGETING_HOURS, STATUS_HOURS = 336, 72


def window_facts(totals: DataFrame, canon: Canon = CANON) -> DataFrame:
    """(entity_type, entity_id, windows): a map from window length to its metrics, intervals and verdicts."""
    floor = F.element_at(F.create_map(*[x for n, f in zip(canon.windows, canon.floors, strict=True) for x in (F.lit(n), F.lit(f))]), F.col("days"))
    n = F.col("purchases").cast("double")
    low, high = E.poisson_interval(n, canon.z)
    roas, cpa = E.ratio(F.col("purchase_value"), F.col("spend")), E.ratio(F.col("spend"), F.col("purchases"))
    thin = (F.col("purchases") < floor) | (n == 0)
    r = lambda c, name: E.rounded(c, 6).alias(name)
    told = F.when(roas.isNull(), F.lit(None)).when(thin, "NOT_DISTINGUISHABLE").otherwise(E.verdict(roas * low / n, roas * high / n, canon.target_roas))
    one = F.struct(
        "spend", "impressions", "purchases", r(roas, "roas"), r(roas * low / n, "roas_low"), r(roas * high / n, "roas_high"), told.alias("verdict"), F.when(roas.isNotNull() & (F.col("purchases") < floor), "BELOW_FLOOR").alias("verdict_reason"),
        r(cpa, "cpa"), r(E.ratio(F.col("clicks"), F.col("impressions")), "ctr"), r(E.ratio(F.col("purchases"), F.col("clicks")), "cvr"), r(E.ratio(F.col("carts"), F.col("landings")), "cart_rate"), r(E.ratio(F.col("impressions"), F.col("reach")), "frequency"), r(E.ratio(F.col("gross"), F.col("spend")), "store_roas"),
    )
    return totals.groupBy("entity_type", "entity_id").agg(F.map_from_entries(F.collect_list(F.struct("days", one))).alias("windows"))


def change_facts(events: DataFrame, canon: Canon = CANON) -> DataFrame:
    """(entity_type, entity_id, changes): counts of recent changes, hours since the last of each kind, the last budget's percent, and whether
    any is major. ``events``: changes with detected_on, up to the as-of day."""
    end = F.date_add(F.lit(canon.as_of), 1)
    known = events.where(F.col("detected_on") <= F.lit(canon.as_of))
    is_ = lambda f: F.col("field") == f
    hours = lambda f: (24 * F.datediff(end, F.max(F.when(is_(f), F.col("detected_on"))))).cast("double")
    recent = lambda f: F.count_if(is_(f) & (F.col("detected_on") > F.date_sub(F.lit(canon.as_of), RECENT_DAYS[f])))
    rows = known.groupBy("entity_type", "entity_id").agg(
        recent("BUDGET").alias("budget_changes_7d"), recent("TARGETING").alias("targeting_changes_14d"), recent("CREATIVE_ASSIGNMENT").alias("creative_changes_7d"), hours("BUDGET").alias("hours_since_budget"), hours("TARGETING").alias("hours_since_targeting"), hours("STATUS").alias("hours_since_status"),
        F.max_by(F.when(is_("BUDGET"), F.col("percent")), F.when(is_("BUDGET"), F.col("detected_on"))).alias("last_budget_percent"), F.max(F.when(is_("BUDGET") & F.col("material"), F.col("detected_on"))).alias("reset_day"),
    )
    major = (F.col("budget_changes_7d") > 0) | (F.col("creative_changes_7d") > 0) | F.coalesce(F.col("hours_since_targeting") < TARGETING_HOURS, F.lit(False)) | F.coalesce(F.col("hours_since_status") < STATUS_HOURS, F.lit(False))
    rows = rows.withColumn("major", major)
    names = [c for c in rows.columns if c not in ("entity_type", "entity_id")]
    return rows.select("entity_type", "entity_id", F.struct(*names).alias("changes"))


def learning_facts(purchases: DataFrame, changes: DataFrame, canon: Canon = CANON) -> DataFrame:
    """(entity_type, entity_id, learning): conversions since the later of the last material budget change and the learning window's first
    day. ``purchases``: entity_type, entity_id, day, purchases of the learning window."""
    first = F.date_sub(F.lit(canon.as_of), canon.learning_days - 1)
    rows = purchases.join(changes.select("entity_type", "entity_id", F.col("changes.reset_day").alias("reset_day")), ["entity_type", "entity_id"], "left")
    start = F.greatest(F.coalesce("reset_day", first), first)
    got = rows.groupBy("entity_type", "entity_id").agg(F.coalesce(F.sum(F.when(F.col("day").between(start, F.lit(canon.as_of)), F.col("purchases"))), F.lit(0)).alias("n"), F.max("reset_day").alias("reset_day"))
    left = F.greatest(F.lit(0), canon.learning_conversions - F.col("n"))
    return got.select("entity_type", "entity_id", F.struct((F.col("n") < canon.learning_conversions).alias("active"), left.cast("long").alias("to_exit"), F.col("reset_day")).alias("learning"))


def eligibility(primary: Column, learning: Column, major: Column, delivering: Column, floor: int) -> Column:
    """(eligible, reasons, confidence, percent, low, high): whether a unit may be scaled, and by how much."""
    rules = ((~delivering, "NOT_DELIVERING"), (~F.coalesce(primary["verdict"] == "ABOVE_TARGET", F.lit(False)), "ROAS_NOT_ABOVE_TARGET"), (F.coalesce(learning, F.lit(False)), "IN_LEARNING_PHASE"), (F.coalesce(major, F.lit(False)), "RECENT_MAJOR_CHANGE"))
    reasons = F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))
    fine = F.size(reasons) == 0
    sure = F.when(fine, confidence(primary["purchases"], F.lit(floor))).otherwise(0.0)
    percent = F.floor(SUGGESTED_LOW + sure * (SUGGESTED_HIGH - SUGGESTED_LOW) + 0.5)
    return F.struct(fine.alias("eligible"), reasons.alias("reasons"), sure.alias("confidence"), F.when(fine, percent).alias("percent"), F.when(fine, SUGGESTED_LOW).alias("low"), F.when(fine, SUGGESTED_HIGH).alias("high"))


def documents(owners: DataFrame, windows: DataFrame, changes: DataFrame, learning: DataFrame, season: Column, primary: int = 28, canon: Canon = CANON) -> DataFrame:
    """(request_id, entity_type, entity_id, outcome, document): a document for each request whose unit is known and delivers.

    ``owners``: requests with unit_type, unit_id, escalated and budgets. The outcome is NO_DECISION_UNIT, NOT_DELIVERING or EVIDENCE. Learning is a matter of ad
    sets; a campaign's is null, which does not speak against it. ``season``: what is known of the window's seasons."""
    of = lambda df: df.withColumnsRenamed({"entity_type": "unit_type", "entity_id": "unit_id"})
    unit = ["unit_type", "unit_id"]
    rows = owners.join(of(windows), unit, "left").join(of(changes), unit, "left").join(of(learning), unit, "left")
    main = F.element_at("windows", F.lit(primary))
    moving = F.coalesce((main["spend"] > 0) | (main["impressions"] > 0), F.lit(False))
    taught = F.when(F.col("unit_type") == "ADSET", F.col("learning"))
    major = F.coalesce(F.col("changes.major"), F.lit(False))
    outcome = F.when(F.col("unit_type").isNull(), "NO_DECISION_UNIT").when(~moving, "NOT_DELIVERING").otherwise("EVIDENCE")
    body = F.struct(
        F.struct(F.col("unit_type").alias("type"), F.col("unit_id").alias("id"), "daily", "lifetime").alias("unit"), F.when(F.col("escalated"), F.struct(F.col("entity_type").alias("type"), F.col("entity_id").alias("id"))).alias("escalated_from"),
        eligibility(main, taught["active"], major, moving, dict(zip(canon.windows, canon.floors, strict=True))[primary]).alias("decision"), F.col("windows"), F.struct(moving.alias("delivering"), main["spend"].alias("spend"), main["impressions"].alias("impressions"), main["frequency"].alias("frequency")).alias("stability"),
        F.col("changes"), taught.alias("learning"), season.alias("season"),
    )
    return rows.select("request_id", "entity_type", "entity_id", outcome.alias("outcome"), F.when(outcome == "EVIDENCE", body).alias("document"))


def proposals(owners: DataFrame, windows: DataFrame, changes: DataFrame, learning: DataFrame, primary: int = 28, canon: Canon = CANON) -> DataFrame:
    """(request_id, entity_type, entity_id, kind, owner, unit_owns, spend, impressions, purchases, percent, confidence, major) for guardrails:
    what each request proposes (``owners`` with percent) beside what is known of the unit that owns the budget."""
    of = lambda df: df.withColumnsRenamed({"entity_type": "unit_type", "entity_id": "unit_id"})
    unit = ["unit_type", "unit_id"]
    rows = owners.join(of(windows), unit, "left").join(of(changes), unit, "left").join(of(learning), unit, "left")
    main = F.element_at("windows", F.lit(primary))
    n = lambda c: F.coalesce(main[c], F.lit(0))
    major = F.coalesce(F.col("changes.major"), F.lit(False))
    taught = F.when(F.col("unit_type") == "ADSET", F.col("learning.active"))
    sure = eligibility(main, taught, major, (n("spend") > 0) | (n("impressions") > 0), dict(zip(canon.windows, canon.floors, strict=True))[primary])["confidence"]
    own = F.col("unit_type").isNotNull() & ~F.col("escalated")
    return rows.select("request_id", "entity_type", "entity_id", F.lit("INCREASE_BUDGET").alias("kind"), F.coalesce("unit_type", F.lit("UNKNOWN")).alias("owner"), own.alias("unit_owns"), *[n(c).alias(c) for c in ("spend", "impressions", "purchases")], "percent", sure.alias("confidence"), major.alias("major"))
