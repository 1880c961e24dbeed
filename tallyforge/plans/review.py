"""Queries of outcomes, calibration over time, creative identity and upkeep, each preceded by its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.operators.outcomes import evaluate
from tallyforge.plans.sql import DAILY, R6
from tallyforge.runtime import documents as read
from tallyforge.sources import facts

D = F.lit
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEASONS = [("NEW_YEAR", date(2023, 12, 28), date(2024, 1, 2)), ("SALE", date(2024, 1, 12), date(2024, 1, 15))]


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


@query(f"""WITH {DAILY}, u AS (SELECT (ad_id // 5)::BIGINT AS u, day, sum(spend) AS spend, sum(purchases) AS p, sum(purchase_value) AS v FROM daily GROUP BY 1, 2),
r AS (SELECT DISTINCT u, CASE WHEN u % 11 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status, CASE WHEN u % 13 = 0 THEN 'INSUFFICIENT_DATA' ELSE 'INCREASE_BUDGET' END AS kind, CASE WHEN u % 7 <> 0 THEN DATE '2024-01-05' + (u % 5)::INT END AS acc,
 CASE WHEN u % 5 <> 0 THEN 50000 END AS ms, CASE WHEN u % 6 = 0 THEN NULL WHEN u % 4 = 1 THEN 5000 ELSE 12 END AS mp, 0.2::DOUBLE + (u % 4) * 0.4::DOUBLE AS base FROM u),
k AS (SELECT *, CASE WHEN status <> 'COMPLETE' THEN 'NOT_COMPLETE' WHEN acc IS NULL THEN 'NOT_ACCEPTED' WHEN ms IS NULL AND mp IS NULL THEN 'NO_THRESHOLD' WHEN kind = 'INSUFFICIENT_DATA' THEN 'NOTHING_TO_SCORE' END AS skip FROM r),
c AS (SELECT k.*, day, sum(spend) OVER w AS s, sum(p) OVER w AS n, sum(v) OVER w AS val FROM k JOIN u USING (u) WHERE skip IS NULL AND day > acc AND day <= DATE '2024-01-30' WINDOW w AS (PARTITION BY u ORDER BY day)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY day) AS i FROM c WHERE (ms IS NULL OR s >= ms) AND (mp IS NULL OR n >= mp)) WHERE i = 1),
x AS (SELECT k.*, f.day, f.s, f.n, f.val::DOUBLE / nullif(f.s, 0) AS roas, greatest(pow(greatest(0, sqrt(f.n + 0.375::DOUBLE) - 1.645::DOUBLE / 2), 2), 0.01::DOUBLE) / nullif(f.n, 0) AS lo, pow(sqrt(f.n + 0.375::DOUBLE) + 1.645::DOUBLE / 2, 2) / nullif(f.n, 0) AS hi FROM k LEFT JOIN f USING (u)),
y AS (SELECT *, CASE WHEN skip IS NOT NULL OR s = 0 THEN 'SKIPPED' WHEN day IS NULL THEN 'NOT_YET_ELIGIBLE' ELSE 'EVALUATED' END AS state FROM x),
z AS (SELECT *, CASE WHEN state = 'EVALUATED' THEN CASE WHEN roas * lo > base THEN 'SUCCESS' WHEN roas * hi < base THEN 'FAILURE' ELSE 'NEUTRAL' END END AS raw_class FROM y)
SELECT u AS rec_id, state, coalesce(skip, CASE WHEN s = 0 THEN 'NO_SPEND' END) AS reason, day AS met_on, s::BIGINT AS spend, n::BIGINT AS purchases, {R6('roas')} AS roas_after, raw_class,
 CASE WHEN raw_class IS NOT NULL THEN CASE WHEN (day >= DATE '2024-01-12' AND acc + 1 <= DATE '2024-01-15') OR (acc - 1 >= DATE '2023-12-28' AND acc - 7 <= DATE '2024-01-02') THEN 'SEASONALLY_CONFOUNDED' ELSE raw_class END END AS class FROM z""")
def outcome_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A recommendation for every ad set, in every state: skipped, not yet eligible, or scored."""
    d = facts.daily(spark, sf).select(F.floor(F.col("ad_id") / 5).cast("long").alias("unit_id"), "day", "spend", "purchases", "purchase_value")
    u = F.col("unit_id")
    accepted = F.when(u % 7 != 0, F.date_add(D(date(2024, 1, 5)), (u % 5).cast("int")))
    recs = d.select("unit_id").distinct().select(
        u.alias("rec_id"), "unit_id", F.when(u % 11 == 0, "FAILED").otherwise("COMPLETE").alias("status"), F.when(u % 13 == 0, "INSUFFICIENT_DATA").otherwise("INCREASE_BUDGET").alias("kind"), accepted.alias("accepted_day"),
        F.when(u % 5 != 0, 50000).alias("min_spend"), F.when(u % 6 == 0, F.lit(None)).when(u % 4 == 1, 5000).otherwise(12).alias("min_purchases"), (0.2 + (u % 4) * 0.4).alias("baseline"), accepted.alias("packet_day"), D(7).alias("window_days"),
    )
    return evaluate(recs, d, SEASONS)


@query(f"""SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (event_type = 'error') AS rejected, {R6("count(*) FILTER (event_type = 'error')::DOUBLE / count(*)")} AS rate FROM events GROUP BY 1""")
def rejection_months(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format(E.reporting_day(F.col("ts"), "Asia/Kolkata"), "yyyy-MM").alias("month")
    n = read(spark, sf, "events").groupBy(month).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("rejected"))
    return n.select("*", E.rounded(E.ratio(F.col("rejected"), F.col("total")), 6).alias("rate"))


@query(f"""WITH p AS (SELECT 'LIVE' AS part, CASE WHEN doc_id % 9 <> 0 THEN (doc_id * 37 % 100) / 100.0::DOUBLE END AS c, quality::DOUBLE AS a FROM labels UNION ALL SELECT 'BACKTEST', (doc_id * 53 % 100) / 100.0::DOUBLE, toxic::DOUBLE FROM labels)
SELECT coalesce(part, 'ALL') AS part, count(*) AS points, count(*) FILTER (c IS NULL) AS without_confidence, count(*) FILTER (c IS NOT NULL) AS scored, {R6('avg(pow(c - a, 2))')} AS brier FROM p GROUP BY GROUPING SETS ((part), ())""")
def calibration_report(spark: SparkSession, sf: str) -> DataFrame:
    """Brier means of live and back-tested points and of both pooled, with the points left out."""
    x = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t"))
    live = x.select(D("LIVE").alias("part"), F.when(F.col("doc_id") % 9 != 0, (F.col("doc_id") * 37 % 100) / 100.0).alias("c"), F.col("q").alias("a"))
    both = live.unionByName(x.select(D("BACKTEST").alias("part"), ((F.col("doc_id") * 53 % 100) / 100.0).alias("c"), F.col("t").alias("a")))
    g = both.rollup("part").agg(F.count("*").alias("points"), F.count_if(F.col("c").isNull()).alias("without_confidence"), F.count("c").alias("scored"), F.avg((F.col("c") - F.col("a")) ** 2).alias("b"))
    return g.select(F.coalesce("part", D("ALL")).alias("part"), "points", "without_confidence", "scored", E.rounded(F.col("b"), 6).alias("brier"))


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'composite_' || p_partkey ELSE coalesce(p_brand, p_type) END AS asset, p_size FROM part WHERE coalesce(p_brand, p_type) IS NOT NULL OR p_size % 10 = 0)
SELECT asset, count(*) AS creatives, arg_max(p_partkey, p_size * 1000000000::BIGINT - p_partkey) AS representative, max(p_size)::INT AS synced FROM c GROUP BY 1""")
def creative_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Creatives by asset, the latest synced (then least id) standing for each; composites stay alone."""
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    asset = F.when(F.col("p_size") % 10 == 0, F.concat(D("composite_"), "p_partkey")).otherwise(F.coalesce("p_brand", "p_type"))
    c = p.select("p_partkey", "p_size", asset.alias("asset")).where("asset IS NOT NULL")
    return c.groupBy("asset").agg(F.count("*").alias("creatives"), F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("representative"), F.max("p_size").alias("synced"))


@query("""WITH v AS (SELECT user_id, event_id, ts::DATE AS day, rank() OVER (PARTITION BY user_id ORDER BY ts::DATE) AS version FROM events), m AS (SELECT user_id, max(version) AS current, max(version) + 1 AS next_version FROM v GROUP BY 1)
SELECT user_id, event_id, version < current AS stale, next_version FROM v JOIN m USING (user_id)""")
def stale_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets made for an older version of their account are stale; the account's next version."""
    e = read(spark, sf, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    v = e.withColumn("version", F.rank().over(W.partitionBy("user_id").orderBy("day")).cast("long"))
    current = F.max("version").over(W.partitionBy("user_id"))
    return v.select("user_id", "event_id", (F.col("version") < current).alias("stale"), (current + 1).alias("next_version"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NAME_MATCH' WHEN o_orderkey % 4 < 3 THEN 'AD_ID' END AS resolution, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey END AS entity FROM orders
WHERE (CASE WHEN o_orderkey % 4 = 0 THEN 'NAME_MATCH' WHEN o_orderkey % 4 < 3 THEN 'AD_ID' END, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey END) IS DISTINCT FROM (CASE WHEN o_orderkey % 4 < 3 THEN 'AD_ID' END, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey END)""")
def changed_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    """Only orders whose newly resolved columns differ (nulls alike) from the stored ones are written again."""
    k = F.col("o_orderkey") % 4
    o = read(spark, sf, "orders").select("o_orderkey", F.when(k < 3, F.col("o_custkey")).alias("entity"), k.alias("k"))
    stored = o.select("o_orderkey", F.when(F.col("k") < 3, "AD_ID").alias("old_resolution"), F.col("entity").alias("old_entity"))
    fresh = o.select("o_orderkey", "entity", F.when(F.col("k") == 0, "NAME_MATCH").when(F.col("k") < 3, "AD_ID").alias("resolution"))
    same = F.col("resolution").eqNullSafe(F.col("old_resolution")) & F.col("entity").eqNullSafe(F.col("old_entity"))
    return fresh.join(stored, "o_orderkey").where(~same).select("o_orderkey", "resolution", "entity")
