"""Change events between the snapshots of one run and the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E
from tallyforge.operators.snapshots import FIELDS, keyed, previous_runs
from tallyforge.runtime import sized, table


def budget_percent(now: tuple[Column, Column], was: tuple[Column, Column]) -> Column:
    """Percent of the daily budgets if both are there, of the lifetime ones if neither side has a daily one; null from a zero base."""
    (day, life), (day_before, life_before) = now, was
    daily, lifetime = day.isNotNull() & day_before.isNotNull(), day.isNull() & day_before.isNull()
    return E.rounded(F.when(daily, E.percent_change(day, day_before)).when(lifetime, E.percent_change(life, life_before)), 2)


def events(snapshots: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row a changed field of each entity that the run before also has; a budget of unknown owner on either side is not compared.

    ``snapshots``: entity_id, run, day, owner, daily, lifetime, status, targeting, bid_strategy, creatives, and if there are several
    kinds entity_type; with a snapshot_key, it must name the row's own entity and run. The run before is the latest that
    finished earlier for the same kind by ``log`` (entity_type, run, status, finished_at); without a log every run that has snapshots counts, in
    order. New and missing entities, and a run compared with itself, give nothing; a budget that moves to or from another level has no percent."""
    key = ["entity_type", "entity_id"] if "entity_type" in snapshots.columns else ["entity_id"]
    rows = keyed(snapshots)
    rows = rows if len(key) == 2 else rows.withColumn("entity_type", F.lit("ADSET"))
    if log is None:
        log = rows.select("entity_type", "run").distinct().select("*", F.lit("SUCCEEDED").alias("status"), F.col("run").alias("finished_at"))
    runs = table(previous_runs(log).where("previous IS NOT NULL"), "runs")
    now = rows.join(sized(runs), ["entity_type", "run"])
    was = rows.select("entity_type", "entity_id", F.col("run").alias("previous"), *[F.col(c).alias(f"was_{c}") for c in FIELDS])
    both = now.join(was, ["entity_type", "entity_id", "previous"])
    text = lambda p: F.concat_ws(" ", F.concat(F.lit("daily:"), F.col(f"{p}daily")), F.concat(F.lit("lifetime:"), F.col(f"{p}lifetime")))
    known = ~F.col("owner").eqNullSafe("UNKNOWN") & ~F.col("was_owner").eqNullSafe("UNKNOWN")
    percent = budget_percent((F.col("daily"), F.col("lifetime")), (F.col("was_daily"), F.col("was_lifetime")))
    row = lambda name, a, b, p=None, when=None: F.struct(F.lit(name).alias("field"), a.alias("before"), b.alias("after"), (F.lit(None).cast("double") if p is None else p).alias("percent"), (F.lit(True) if when is None else when).alias("_compare"))
    rows = F.array(row("BUDGET", text("was_"), text(""), percent, known), *[row(c.upper() if c != "creatives" else "CREATIVE_ASSIGNMENT", F.col(f"was_{c}"), F.col(c)) for c in ("status", "targeting", "bid_strategy", "creatives")])
    out = both.select(*key, "run", F.col("day").alias("detected_on"), F.inline(rows)).where(F.col("_compare") & ~F.col("before").eqNullSafe(F.col("after"))).drop("_compare")
    return out.withColumn("material", (F.col("field") == "BUDGET") & F.coalesce(F.abs("percent") >= CANON.material_change_percent, F.lit(False)))


def enriched(events_: DataFrame, features: DataFrame) -> DataFrame:
    """Events by entity, for entities that have features (entity_id) only."""
    e = events_.join(features.select("entity_id").distinct(), "entity_id", "left_semi")
    last = F.max(F.when((F.col("field") == "BUDGET") & F.col("material"), F.struct("run", "detected_on")))
    return e.groupBy("entity_id").agg(F.count("*").alias("changes"), *[F.count_if(F.col("field") == f).alias(f.lower()) for f in ("BUDGET", "STATUS", "TARGETING", "BID_STRATEGY", "CREATIVE_ASSIGNMENT")], F.max("run").alias("last_run"), last["detected_on"].alias("last_material_budget"))


def learning(daily: DataFrame, levels: Column, canon: Canon = CANON) -> DataFrame:
    """Learning phase of each entity: conversions since the later of its last large budget change (or first day) and the
    learning window's start, and what restarted it. ``daily``: day, spend, purchases, and the columns of ``levels``."""
    from pyspark.sql import Window as W

    key = ["entity_type", "entity_id"]
    d = daily.select("day", "spend", "purchases", F.inline(levels)).groupBy(*key, "day").agg(F.sum("spend").alias("spend"), F.sum("purchases").alias("purchases"))
    before = F.lag("spend").over(W.partitionBy(*key).orderBy("day"))
    d = d.withColumn("_large", F.coalesce(F.abs(E.percent_change(F.col("spend"), before)) >= canon.material_change_percent, F.lit(False)))
    start = F.date_sub(F.lit(canon.as_of), canon.learning_days - 1)
    of = d.groupBy(*key).agg(F.max(F.when(F.col("_large"), F.col("day"))).alias("reset_day"), F.min("day").alias("created"))
    of = of.withColumn("start", F.greatest(F.coalesce("reset_day", "created"), start))
    of = of.withColumn("cause", F.when(F.col("reset_day") >= start, "budget change").when(F.col("reset_day").isNull() & (F.col("created") >= start), "created").otherwise("none"))
    n = d.join(of, key).where(F.col("day").between(F.col("start"), F.lit(canon.as_of))).groupBy(*key).agg(F.sum("purchases").alias("conversions"))
    out = of.join(n, key, "left").withColumn("conversions", F.coalesce("conversions", F.lit(0)))
    return out.select(*key, "reset_day", "start", "cause", "conversions", (F.col("conversions") < canon.learning_conversions).alias("learning"), F.greatest(F.lit(0), canon.learning_conversions - F.col("conversions")).cast("long").alias("to_exit"))
