"""Back-test of two strategies at many days at once: what was known, what each chose, what followed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E


def confidence(n, floor):
    """0.5 at the floor, up to 0.9 at twice the floor."""
    excess = F.least(F.lit(1.0), (n - floor) / floor.cast("double"))
    return F.greatest(F.lit(0.5), F.least(F.lit(0.9), 0.5 + 0.4 * excess))


def backtest(daily: DataFrame, entity, as_of: list[date], days: int, horizon: int, floor: int, canon: Canon = CANON) -> DataFrame:
    """One row an as-of day and strategy. Days without a candidate have no row.

    ``daily`` holds (day, spend, purchases, purchase_value); ``entity`` is a column of it. Both windows of all
    as-of days are summed in one pass: a row is copied to the days it counts for, at most one for each as-of day.
    """
    points = F.array(*[F.lit(d) for d in as_of])
    age = lambda d: F.datediff(d, F.col("day"))
    near = F.filter(points, lambda d: (age(d) < days) & (age(d) >= -horizon))
    rows = daily.select(entity.cast("long").alias("entity_id"), "day", "spend", "purchases", "purchase_value", F.explode(near).alias("as_of"))
    known = F.col("day") <= F.col("as_of")
    s = lambda c, side: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).cast("long")
    t = rows.groupBy("as_of", "entity_id").agg(
        s("spend", known).alias("spend"), s("purchases", known).alias("purchases"), s("purchase_value", known).alias("value"),
        s("spend", ~known).alias("spend_after"), s("purchases", ~known).alias("purchases_after"), s("purchase_value", ~known).alias("value_after"),
    )
    t = t.where("spend > 0").withColumn("confidence", F.when(F.col("purchases") >= floor, confidence(F.col("purchases"), F.lit(floor)))).withColumn("roas", E.ratio(F.col("value"), F.col("spend")))
    columns = ["entity_id", "confidence", "spend_after", "purchases_after", "value_after"]
    best = lambda measure: F.max_by(F.struct(*columns), F.struct(measure, -F.col("entity_id")))
    picks = t.groupBy("as_of").agg(F.max_by(F.when(F.col("confidence").isNotNull(), F.struct(*columns)), F.when(F.col("confidence").isNotNull(), F.struct("confidence", -F.col("entity_id")))).alias("SYSTEM"), best("roas").alias("NAIVE"))
    chosen = picks.select("as_of", F.explode(F.array(F.struct(F.lit("SYSTEM").alias("strategy"), F.col("SYSTEM").alias("p")), F.struct(F.lit("NAIVE").alias("strategy"), F.col("NAIVE").alias("p")))).alias("x"))
    chosen = chosen.select("as_of", "x.strategy", "x.p.*").where("entity_id IS NOT NULL")
    n = F.col("purchases_after").cast("double")
    low, high = E.poisson_interval(n, canon.z)
    after = E.ratio(F.col("value_after"), F.col("spend_after"))
    told = F.when(after.isNull(), F.lit(None)).when(n < floor, "NOT_DISTINGUISHABLE").otherwise(E.verdict(after * low / n, after * high / n, canon.target_roas))
    conf = F.when(F.col("strategy") == "SYSTEM", F.col("confidence"))
    actual = F.when(told.isNotNull(), (told == "ABOVE_TARGET").cast("double"))
    return chosen.select("as_of", "strategy", "entity_id", E.rounded(conf, 6).alias("confidence"), "purchases_after", E.rounded(after, 6).alias("roas_after"), told.alias("verdict"), E.rounded((conf - actual) ** 2, 6).alias("brier"))
