"""Windowed features with uncertainty at five entity levels, in one pass over the daily facts of the longest window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E
from tallyforge.operators.spine import windows_of
from tallyforge.sources import facts
from tallyforge.sources.facts import levels

MEASURES = ("impressions", "clicks", "carts", "purchases", "spend", "purchase_value")


def window_totals(daily: DataFrame, ads: DataFrame, canon: Canon = CANON) -> DataFrame:
    """(entity_type, entity_id, days, floor, measures): every entity of ``ads`` (ad_id) and window, zeros where nothing happened.

    Only days of the longest window are read, and a fact is repeated only for the windows it is in. Facts are summed by ad
    and window first, so the explosion to levels works on ads, not on days.
    """
    last, first = F.lit(canon.as_of), F.date_sub(F.lit(canon.as_of), max(canon.windows) - 1)
    inside = daily.where(F.col("day").between(first, last)).withColumn("days", F.explode(windows_of("day", canon)))
    by_ad = inside.groupBy("ad_id", "days").agg(*[F.sum(m).alias(m) for m in MEASURES])
    found = by_ad.select(F.inline(levels()), "days", *MEASURES).groupBy("entity_type", "entity_id", "days").agg(*[F.sum(m).alias(m) for m in MEASURES])
    spans = F.array(*[F.struct(F.lit(n).alias("days"), F.lit(f).alias("floor")) for n, f in zip(canon.windows, canon.floors, strict=True)])
    spine = ads.select("ad_id").distinct().select(F.inline(levels())).distinct().select("*", F.inline(spans))
    return spine.join(found, ["entity_type", "entity_id", "days"], "left").select("entity_type", "entity_id", "days", "floor", *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES])


def recent(spark: SparkSession, sf_dir: str, canon: Canon = CANON) -> DataFrame:
    """``window_totals`` of the driver's events; the bounds of the longest window reach the scan."""
    since = F.date_sub(F.lit(canon.as_of), max(canon.windows) - 1)
    return window_totals(facts.daily(spark, sf_dir, since, F.lit(canon.as_of)), facts.ads(spark, sf_dir), canon)


def metrics(totals: DataFrame) -> DataFrame:
    r = lambda a, b, k=1.0: E.rounded(E.ratio(F.col(a) * k, F.col(b)), 6)
    return totals.select(
        "entity_type", "entity_id", "days", *MEASURES, r("spend", "impressions", 1000.0).alias("cpm"), r("clicks", "impressions").alias("ctr"),
        r("spend", "clicks").alias("cpc"), r("purchases", "clicks").alias("cvr"), r("purchase_value", "spend").alias("roas"), r("spend", "purchases").alias("cpa"),
    )


def statistics(totals: DataFrame, canon: Canon = CANON) -> DataFrame:
    """ROAS with interval, value shrunk to the account's, verdict and reason; suppressed rows keep the interval."""
    n = F.col("purchases").cast("double")
    low, high = E.poisson_interval(n, canon.z)
    roas = E.ratio(F.col("purchase_value"), F.col("spend"))
    account = totals.where("entity_type = 'ACCOUNT'").select("days", roas.alias("mean"))
    rows = totals.join(F.broadcast(account), "days", "left")  # one row a window
    rows = rows.withColumn("roas", roas).withColumn("interval_low", F.col("roas") * low / n).withColumn("interval_high", F.col("roas") * high / n)
    below = F.col("purchases") < F.col("floor")
    told = F.when(F.col("roas").isNull(), F.lit(None)).when(below | (n == 0), "NOT_DISTINGUISHABLE").otherwise(E.verdict(F.col("interval_low"), F.col("interval_high"), canon.target_roas))
    r6 = lambda c: E.rounded(F.col(c), 6).alias(c)
    return rows.withColumn("roas_shrunk", E.shrunk(F.col("roas"), F.col("mean"), n, F.col("floor").cast("double"))).select(
        "entity_type", "entity_id", F.concat(F.col("days").cast("string"), F.lit("d")).alias("window_label"), F.col("spend").alias("spend_minor"), "purchases",
        F.col("purchase_value").alias("purchase_value_minor"), r6("roas"), r6("interval_low"), r6("interval_high"), r6("roas_shrunk"), told.alias("verdict"),
        F.when(F.col("roas").isNotNull() & below, "BELOW_FLOOR").alias("verdict_reason"),
    )
