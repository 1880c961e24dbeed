"""What became of accepted recommendations, judged against the baseline they were made from."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E


def season_set(seasons: list[tuple[str, date, date]], start: Column, end: Column) -> Column:
    """Sorted labels of the seasons (inclusive) that overlap a range of days."""
    hits = F.array(*[F.when((F.lit(a) <= end) & (F.lit(b) >= start), F.lit(name)) for name, a, b in seasons])
    return F.array_sort(F.array_distinct(F.array_compact(hits)))


def skip_reason() -> Column:
    """Why a recommendation is not scored; the first that holds."""
    none = F.col("min_spend").isNull() & F.col("min_purchases").isNull()
    return (
        F.when(~F.col("status").eqNullSafe("COMPLETE"), "NOT_COMPLETE").when(F.col("accepted_day").isNull(), "NOT_ACCEPTED").when(none, "NO_THRESHOLD")
        .when(F.col("unit_id").isNull(), "NO_DECISION_UNIT").when(F.col("kind").isNull() | (F.col("kind") == "INSUFFICIENT_DATA"), "NOTHING_TO_SCORE")
        .when(F.col("baseline").isNull(), "NO_BASELINE")
    )


def evaluate(recs: DataFrame, daily: DataFrame, seasons: list[tuple[str, date, date]], canon: Canon = CANON) -> DataFrame:
    """One row a recommendation: state, classification and the numbers behind it.

    ``recs``: rec_id, unit_id, status, kind, accepted_day, min_spend, min_purchases, baseline, packet_day, window_days;
    ``daily``: unit_id, day, spend, purchases, purchase_value. The sums run from the day after acceptance to the
    first day on which every threshold given is met; a unit without later days counts as zeros.
    """
    r = recs.withColumn("skipped", skip_reason()).withColumn("first", F.date_add("accepted_day", 1))
    live = r.where(F.col("skipped").isNull() & (F.col("first") <= F.lit(canon.as_of))).select("rec_id", "unit_id", "first", "min_spend", "min_purchases")
    zero = lambda c: F.lit(0).cast("long").alias(c)
    # Facts are summed by unit and day before recommendations multiply them.
    by_day = daily.where(F.col("day") <= F.lit(canon.as_of)).groupBy("unit_id", "day").agg(*[F.sum(c).alias(c) for c in ("spend", "purchases", "purchase_value")])
    later = live.join(by_day, "unit_id").where(F.col("day") >= F.col("first")).select("rec_id", "min_spend", "min_purchases", "day", "spend", "purchases", "purchase_value")
    rows = later.unionByName(live.select("rec_id", "min_spend", "min_purchases", F.col("first").alias("day"), zero("spend"), zero("purchases"), zero("purchase_value")))
    w = W.partitionBy("rec_id").orderBy("day")  # the default range frame takes all rows of a day together
    c = rows.select("rec_id", "min_spend", "min_purchases", "day", *[F.sum(m).over(w).alias(m) for m in ("spend", "purchases", "purchase_value")])
    met = F.coalesce(F.col("spend") >= F.col("min_spend"), F.lit(True)) & F.coalesce(F.col("purchases") >= F.col("min_purchases"), F.lit(True))
    sums = F.struct("day", "spend", "purchases", "purchase_value")
    at = c.groupBy("rec_id").agg(F.min(F.when(met, sums)).alias("x")).select("rec_id", "x.*")
    out = r.join(at, "rec_id", "left")
    n = F.col("purchases").cast("double")
    low, high = E.poisson_interval(n, canon.z)
    roas = E.ratio(F.col("purchase_value"), F.col("spend"))
    raw = F.when(n > 0, F.when(roas * low / n > F.col("baseline"), "SUCCESS").when(roas * high / n < F.col("baseline"), "FAILURE")).otherwise(F.lit(None))
    raw = F.when(F.col("state") == "EVALUATED", F.coalesce(raw, F.lit("NEUTRAL")))
    base_end = F.date_sub("packet_day", 1)
    confounded = season_set(seasons, F.col("first"), F.col("day")) != season_set(seasons, F.date_sub(base_end, F.col("window_days") - 1), base_end)
    state = F.when(F.col("skipped").isNotNull(), "SKIPPED").when(F.col("day").isNull(), "NOT_YET_ELIGIBLE").when(F.col("spend") == 0, "SKIPPED").otherwise("EVALUATED")
    why = F.coalesce(F.col("skipped"), F.when(F.col("spend") == 0, "NO_SPEND"))
    out = out.withColumn("state", state).withColumn("raw_class", raw)
    return out.select(
        "rec_id", "state", why.alias("reason"), F.col("day").alias("met_on"), "spend", "purchases", E.rounded(roas, 6).alias("roas_after"), "raw_class",
        F.when(F.col("raw_class").isNotNull(), F.when(confounded, "SEASONALLY_CONFOUNDED").otherwise(F.col("raw_class"))).alias("class"),
    )
