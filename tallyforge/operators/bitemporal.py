"""What was known when: versions of facts with the time they were valid, read at many points in one plan, and a back-test on them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E
from tallyforge.runtime import sized

#: Percent by which the plain strategy changes, and the range of suggested changes.
NAIVE_PERCENT = 20.0
SUGGESTED_LOW, SUGGESTED_HIGH = 5.0, 15.0


def versions(facts: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """``facts`` (run, key, values) with known_from and known_to: from when its run finished until a later one brought the key again.

    Only runs that succeeded teach anything. Of runs that finished together the larger counts; the last version has no known_to."""
    done = runs.where("status = 'SUCCEEDED' AND finished_at IS NOT NULL").select("run", F.col("finished_at").alias("known_from"))
    rows = facts.join(sized(done), "run")
    following = F.lead("known_from").over(W.partitionBy(*key).orderBy("known_from", "run"))
    found = rows.withColumn("known_to", following)
    return found.where(F.col("known_to").isNull() | (F.col("known_to") > F.col("known_from"))).drop("run")


def known_at(facts: DataFrame, requests: DataFrame, span: int) -> DataFrame:
    """``facts`` (day, known_from, known_to, ...) joined with every request (lo, hi, at, ...) for whose days and time they are valid.

    An interval join in buckets of ``span`` days: a fact is in one bucket, a request, of at most ``span`` days, in two or one."""
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / span)
    asked = requests.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    inside = F.col("day").between(F.col("lo"), F.col("hi")) & (F.col("known_from") <= F.col("at")) & (F.col("known_to").isNull() | (F.col("known_to") > F.col("at")))
    return facts.withColumn("_bucket", bucket(F.col("day"))).join(sized(asked), "_bucket").where(inside).drop("_bucket", "known_from", "known_to")


def end_of(day: Column) -> Column:
    """The last instant that still belongs to a day, in the session's zone."""
    return (F.date_add(day, 1)).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")


def verdict_of(n: Column, roas: Column, floor: int, canon: Canon) -> Column:
    low, high = E.poisson_interval(n.cast("double"), canon.z)
    return F.when(roas.isNull(), F.lit(None)).when((n < floor) | (n == 0), "NOT_DISTINGUISHABLE").otherwise(E.verdict(roas * low / n, roas * high / n, canon.target_roas))


def backtest(facts: DataFrame, store: DataFrame, gaps: DataFrame, as_of: list[date], primary: int = 28, recent: int = 7, horizon: int = 28, floor: int = 30, canon: Canon = CANON) -> DataFrame:
    """One row an as-of day and strategy, every day in one plan.

    ``facts``: entity_id, day, spend, impressions, purchases, purchase_value, known_from, known_to; ``store``: day, net, known_from, known_to; ``gaps``: start, end (days without
    store data). The system takes the unit with most confidence among those whose return over the ``primary`` window is above target, and is refused
    a change beyond the limit; the plain strategy takes the best return over the ``recent`` window. Both read what was
    known at the end of the day. What followed is judged on the ``horizon`` as known at its end. The account's store revenue to spend, and
    how many days of its window lack store data, stand beside."""
    spark, longest = facts.sparkSession, max(primary, horizon)
    points = [(t, t - timedelta(primary - 1), t, False, t) for t in as_of] + [(t, t + timedelta(1), t + timedelta(horizon), True, t + timedelta(horizon)) for t in as_of]
    requests = spark.createDataFrame(points, "as_of date, lo date, hi date, later boolean, seen date").withColumn("at", end_of(F.col("seen"))).drop("seen")
    # Facts are summed by unit, day and validity before they meet the points.
    values = ["spend", "impressions", "purchases", "purchase_value"]
    thin = facts.groupBy("entity_id", "day", "known_from", "known_to").agg(*[F.sum(v).alias(v) for v in values])
    met = known_at(thin, requests, longest)
    new = F.col("day") > F.date_sub("as_of", recent)
    s = lambda v, when: F.coalesce(F.sum(F.when(when, F.col(v))), F.lit(0)).cast("long")
    t = met.groupBy("as_of", "entity_id").agg(*[s(v, ~F.col("later")).alias(v) for v in values], *[s(v, ~F.col("later") & new).alias(f"{v}_recent") for v in values], *[s(v, F.col("later")).alias(f"{v}_after") for v in values])
    roas = lambda side: E.ratio(F.col(f"purchase_value{side}"), F.col(f"spend{side}"))
    told = verdict_of(F.col("purchases"), roas(""), floor, canon)
    excess = F.least(F.lit(1.0), (F.col("purchases") - floor) / F.lit(float(floor)))
    sure = F.greatest(F.lit(0.5), F.least(F.lit(0.9), 0.5 + 0.4 * excess))
    t = t.withColumn("confidence", F.when(((F.col("spend") > 0) | (F.col("impressions") > 0)) & (told == "ABOVE_TARGET"), sure)).withColumn("_roas", F.when((F.col("spend_recent") > 0) | (F.col("impressions_recent") > 0), roas("_recent")))
    held = F.struct("entity_id", "confidence", "spend_after", "purchases_after", "purchase_value_after")
    best = lambda by: F.max_by(F.when(F.col(by).isNotNull(), held), F.when(F.col(by).isNotNull(), F.struct(F.col(by), -F.col("entity_id"))))
    picks = t.groupBy("as_of").agg(best("confidence").alias("_system"), best("_roas").alias("_naive"), F.sum("spend").alias("account_spend"))
    all_days = spark.createDataFrame([(d,) for d in as_of], "as_of date")
    both = all_days.join(picks, "as_of", "left").select("as_of", "account_spend", F.inline(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(c).alias("p")) for k, c in (("SYSTEM", "_system"), ("NAIVE_HIGHEST_RECENT_ROAS", "_naive"))])))
    system, some = F.col("strategy") == "SYSTEM", F.col("p").isNotNull()
    percent = F.when(system, F.floor(SUGGESTED_LOW + F.col("p.confidence") * (SUGGESTED_HIGH - SUGGESTED_LOW) + 0.5).cast("double")).otherwise(NAIVE_PERCENT)
    refused = system & some & (F.abs(percent) > canon.max_change_percent)
    go = some & ~refused
    after = E.ratio(F.col("p.purchase_value_after"), F.col("p.spend_after"))
    judged = both.select(
        "as_of", "strategy", F.col("p.entity_id").alias("unit_id"), F.when(go, "INCREASE_BUDGET").otherwise("INSUFFICIENT_DATA").alias("action"), F.when(go, percent).alias("change_percent"), F.when(go & system, F.col("p.confidence")).alias("confidence"),
        F.coalesce(refused, F.lit(False)).alias("refused"), F.col("p.purchases_after").alias("purchases_after"), after.alias("_after"), verdict_of(F.col("p.purchases_after"), after, floor, canon).alias("verdict"), "account_spend",
    )
    money = known_at(store.groupBy("day", "known_from", "known_to").agg(F.sum("net").alias("net")), requests.where("NOT later"), longest).groupBy("as_of").agg(F.sum("net").alias("net"))
    spine = requests.where("NOT later").select("as_of", F.explode(F.sequence("lo", "hi")).alias("day"))
    gone = gaps.select(F.explode(F.sequence("start", "end")).alias("day")).distinct()
    lost = spine.join(gone, "day", "left_semi").groupBy("as_of").agg(F.count("*").alias("gap_days"))
    actual = (F.col("verdict") == "ABOVE_TARGET").cast("double")
    out = judged.join(money, "as_of", "left").join(lost, "as_of", "left")
    return out.select(
        "as_of", "strategy", "unit_id", "action", "change_percent", E.rounded(F.col("confidence"), 6).alias("confidence"), "refused", "purchases_after", E.rounded(F.col("_after"), 6).alias("roas_after"), "verdict",
        E.rounded((F.col("confidence") - actual) ** 2, 6).alias("brier"), E.rounded(E.ratio(F.coalesce("net", F.lit(0)), F.col("account_spend")), 6).alias("store_to_spend"), F.coalesce("gap_days", F.lit(0)).alias("gap_days"),
    )
