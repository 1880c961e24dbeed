"""Queries over runs and time: snapshots of three kinds, changes by the run log, windows at any day, a back-test from versions, each preceded by its SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators import bitemporal, changes, cumulative, seasons, snapshots
from tallyforge.plans.sql import DAILY, MINOR, R6
from tallyforge.runtime import documents as read
from tallyforge.runtime import new_path, table
from tallyforge.sources import archive, facts
from tallyforge.streaming import latest

D = F.lit
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


# A year of orders is a run. A customer is an ad, five are an ad set, 25 a campaign; what they ordered gives their settings.
_LAST = "(o_orderdate, o_orderkey)"
_UNITS = f"""o AS (SELECT *, year(o_orderdate)::BIGINT AS run, {MINOR('o_totalprice')} AS money FROM orders),
g AS (SELECT 'AD' AS entity_type, o_custkey AS entity_id, run, NULL::BIGINT AS parent, arg_max(o_orderstatus, {_LAST}) AS status, arg_max(o_orderpriority, {_LAST}) AS prio, max(money) AS money, count(*) % 3 AS n, list(DISTINCT (o_orderkey % 4)::VARCHAR) AS cr FROM o GROUP BY 2, 3
 UNION ALL SELECT 'ADSET', o_custkey // 5, run, min(o_custkey // 25), arg_max(o_orderstatus, {_LAST}), arg_max(o_orderpriority, {_LAST}), max(money), count(*) % 3, list(DISTINCT (o_orderkey % 4)::VARCHAR) FROM o GROUP BY 2, 3
 UNION ALL SELECT 'CAMPAIGN', o_custkey // 25, run, NULL, arg_max(o_orderstatus, {_LAST}), arg_max(o_orderpriority, {_LAST}), max(money), count(*) % 3, list(DISTINCT (o_orderkey % 4)::VARCHAR) FROM o GROUP BY 2, 3),
b AS (SELECT *, CASE WHEN entity_type = 'CAMPAIGN' THEN (entity_id + run) % 3 = 0 WHEN entity_type = 'ADSET' THEN (entity_id + run) % 4 > 0 ELSE false END AS has, entity_id % 2 = 0 AS by_day FROM g),
kids AS (SELECT parent AS entity_id, run, count(*) FILTER (has) AS owning FROM b WHERE entity_type = 'ADSET' GROUP BY 1, 2),
up AS (SELECT entity_id AS parent, run, has AS above FROM b WHERE entity_type = 'CAMPAIGN'),
w AS (SELECT b.*, CASE WHEN entity_type = 'CAMPAIGN' THEN CASE WHEN has THEN 'CAMPAIGN' WHEN coalesce(owning, 0) = 0 THEN 'UNKNOWN' END WHEN entity_type = 'ADSET' THEN CASE WHEN coalesce(above, false) AND NOT has THEN NULL WHEN NOT coalesce(above, false) AND has THEN 'ADSET' ELSE 'UNKNOWN' END END AS owner
 FROM b LEFT JOIN kids ON entity_type = 'CAMPAIGN' AND kids.entity_id = b.entity_id AND kids.run = b.run LEFT JOIN up ON up.parent = b.parent AND up.run = b.run),
snap AS (SELECT entity_type, entity_id, run, make_date(run::INT, 6, 30) AS day, owner, CASE WHEN owner IN ('CAMPAIGN', 'ADSET') AND by_day THEN money END AS daily, CASE WHEN owner IN ('CAMPAIGN', 'ADSET') AND NOT by_day THEN money END AS lifetime, status,
 CASE WHEN entity_type = 'ADSET' THEN '{{"age":{{"max":' || (30 + n) || ',"min":18}},"geo":{{"cities":[' || n || ',7],"country":"' || prio || '"}}}}' END AS targeting, CASE WHEN entity_type <> 'AD' THEN prio END AS bid_strategy, CASE WHEN entity_type = 'AD' THEN array_to_string(list_sort(cr), ',') END AS creatives FROM w)"""


def _archive(spark: SparkSession, sf: str) -> str:
    """Documents of every run as they would arrive: nested objects with their keys in an order that changes from run to run."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    levels = F.array(*[F.struct(D(k).alias("type"), F.floor(F.col("o_custkey") / n).cast("long").alias("id")) for k, n in (("AD", 1), ("ADSET", 5), ("CAMPAIGN", 25))])
    rows = o.select("*", F.year("o_orderdate").cast("long").alias("run"), F.inline(levels))
    last = F.struct("o_orderdate", "o_orderkey")
    g = rows.groupBy("type", "id", "run").agg(
        F.min(F.floor(F.col("o_custkey") / 25)).alias("campaign"), F.max_by("o_orderstatus", last).alias("status"), F.max_by("o_orderpriority", last).alias("prio"), F.max(E.minor(F.col("o_totalprice"))).alias("money"), (F.count("*") % 3).alias("n"), F.collect_set(F.when(F.col("type") == "AD", (F.col("o_orderkey") % 4).cast("string"))).alias("creatives")
    )
    cities, country = F.array(F.col("n").cast("int"), D(7)).alias("cities"), F.col("prio").alias("country")
    low, high = D(18).alias("min"), (D(30) + F.col("n")).alias("max")
    a = F.to_json(F.struct(F.struct(country, cities).alias("geo"), F.struct(low, high).alias("age")))
    b = F.to_json(F.struct(F.struct(high, low).alias("age"), F.struct(cities, country).alias("geo")))
    adset, campaign = F.col("type") == "ADSET", F.col("type") == "CAMPAIGN"
    has = F.when(campaign, (F.col("id") + F.col("run")) % 3 == 0).when(adset, (F.col("id") + F.col("run")) % 4 > 0).otherwise(False)
    day = F.col("id") % 2 == 0
    body = F.struct(
        F.col("id").cast("string").alias("id"), "type", F.when(adset, F.col("campaign").cast("string")).alias("campaign_id"), F.when(has & day, F.col("money")).alias("daily_budget"), F.when(has & ~day, F.col("money")).alias("lifetime_budget"),
        "status", F.col("prio").alias("bid_strategy"), F.when(F.col("type") == "AD", F.sort_array("creatives", asc=False)).alias("creatives"), F.parse_json(F.when(F.col("run") % 2 == 0, a).otherwise(b)).alias("targeting"),
    )
    # A VARIANT sorts its keys, so the targeting is put in as text.
    text = F.to_json(body.dropFields("targeting"))
    text = F.concat(F.substring(text, D(1), F.length(text) - 1), F.when(adset, F.concat(D(',"targeting":'), F.when(F.col("run") % 2 == 0, a).otherwise(b))).otherwise(D("")), D("}"))
    path = new_path(spark, "archive")
    archive.write(g.select(D("units").alias("source"), F.make_date(F.col("run").cast("int"), D(6), D(30)).alias("day"), "run", text.alias("body")), path)
    return path


def _snapshots(spark: SparkSession, sf: str, kinds: tuple[str, ...] = ("AD", "ADSET", "CAMPAIGN")) -> DataFrame:
    # Parsed once: snapshots are built from several selections of the documents.
    e = archive.entities(archive.read(spark, _archive(spark, sf), "units")).where(F.col("entity_type").isin(*kinds))
    return snapshots.built(table(e.select("entity_type", "entity_id", "run", "day", "daily", "lifetime", "status", "targeting", "bid_strategy", "creatives", "parent"), "units"))


@query(f"WITH {_UNITS} SELECT * FROM snap")
def unit_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of campaigns, ad sets and ads at every run, with the level that owns each budget."""
    return _snapshots(spark, sf)


#: Runs end a day after their year's half; that of 1994 failed for all, that of 1996 never ended for ads.
_LOG = """lg AS (SELECT DISTINCT entity_type, run FROM snap), ok AS (SELECT entity_type, run, lag(run) OVER (PARTITION BY entity_type ORDER BY run) AS previous FROM lg WHERE run <> 1994 AND NOT (run = 1996 AND entity_type = 'AD'))"""
_DIFF = f"""{_UNITS}, {_LOG}, p AS (SELECT a, b FROM snap a JOIN ok ON ok.entity_type = a.entity_type AND ok.run = a.run JOIN snap b ON b.entity_type = a.entity_type AND b.entity_id = a.entity_id AND b.run = ok.previous),
x AS (SELECT a.entity_type AS entity_type, a.entity_id AS entity_id, a.run AS run, a.day AS detected_on, a, b, unnest([{{'f': 'BUDGET', 'x': concat_ws(' ', 'daily:' || b.daily, 'lifetime:' || b.lifetime), 'y': concat_ws(' ', 'daily:' || a.daily, 'lifetime:' || a.lifetime)}}, {{'f': 'STATUS', 'x': b.status, 'y': a.status}},
 {{'f': 'TARGETING', 'x': b.targeting, 'y': a.targeting}}, {{'f': 'BID_STRATEGY', 'x': b.bid_strategy, 'y': a.bid_strategy}}, {{'f': 'CREATIVE_ASSIGNMENT', 'x': b.creatives, 'y': a.creatives}}]) AS e FROM p),
q AS (SELECT entity_type, entity_id, run, detected_on, e.f AS field, e.x AS before, e.y AS after, CASE WHEN e.f = 'BUDGET' THEN floor(CASE WHEN a.daily IS NOT NULL AND b.daily IS NOT NULL THEN (a.daily - b.daily) * 100.0::DOUBLE / nullif(b.daily, 0) WHEN a.daily IS NULL AND b.daily IS NULL THEN (a.lifetime - b.lifetime) * 100.0::DOUBLE / nullif(b.lifetime, 0) END * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS percent FROM x
 WHERE e.x IS DISTINCT FROM e.y AND (e.f <> 'BUDGET' OR (a.owner IS DISTINCT FROM 'UNKNOWN' AND b.owner IS DISTINCT FROM 'UNKNOWN')))"""


def run_log(snaps: DataFrame) -> DataFrame:
    log = snaps.select("entity_type", "run", "day").distinct()
    status = F.when(F.col("run") == 1994, "FAILED").when((F.col("run") == 1996) & (F.col("entity_type") == "AD"), "RUNNING").otherwise("SUCCEEDED")
    return log.select("entity_type", "run", status.alias("status"), F.when(status != "RUNNING", F.date_add("day", 1).cast("timestamp")).alias("finished_at"))


@query(f"WITH {_DIFF} SELECT *, field = 'BUDGET' AND coalesce(abs(percent) >= 20, false) AS material FROM q")
def run_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of each finished run against the latest one that finished before it, by the log of runs: failed and unfinished runs are passed over."""
    snaps = _snapshots(spark, sf)
    return changes.events(snaps, run_log(snaps))


_SUMS = ", ".join(f"coalesce(sum({m}) FILTER (day > as_of - days AND day <= as_of), 0)::BIGINT AS {m}" for m in ("impressions", "clicks", "purchases", "spend", "purchase_value"))
_AS_OF = [date(2023, 12, 3) + timedelta(n) for n in range(60)]


@query(f"""WITH {DAILY}, e AS (SELECT * FROM (SELECT DISTINCT c_custkey // 25 AS i FROM customer), (VALUES ('CAMPAIGN')) v(t) UNION ALL SELECT 0, 'ACCOUNT'),
f AS (SELECT 'CAMPAIGN' AS t, ad_id // 25 AS i, * FROM daily UNION ALL SELECT 'ACCOUNT', 0, * FROM daily), a AS (SELECT (DATE '2023-12-03' + n::INT)::DATE AS as_of FROM range(60) r(n)), d AS (SELECT * FROM (VALUES (7), (14), (28), (56)) v(days)),
s AS (SELECT e.t AS entity_type, e.i::BIGINT AS entity_id, as_of, days, {_SUMS} FROM e CROSS JOIN a CROSS JOIN d LEFT JOIN f ON f.t = e.t AND f.i = e.i GROUP BY 1, 2, 3, 4)
SELECT *, {R6('purchase_value::DOUBLE / nullif(spend, 0)')} AS roas, {R6('spend::DOUBLE / nullif(purchases, 0)')} AS cpa FROM s""")
def windows_any_day(spark: SparkSession, sf: str) -> DataFrame:
    """The four windows of every campaign and the account at sixty as-of days, from running sums in one plan."""
    since, until = D(_AS_OF[0] - timedelta(max(CANON.windows) - 1)), D(_AS_OF[-1])
    up = lambda ad: F.array(F.struct(D("CAMPAIGN").alias("entity_type"), F.floor(ad / 25).cast("long").alias("entity_id")), F.struct(D("ACCOUNT").alias("entity_type"), D(0).cast("long").alias("entity_id")))
    measures = ("impressions", "clicks", "purchases", "spend", "purchase_value")
    daily = facts.daily(spark, sf, since, until).select("day", *measures, F.inline(up(F.col("ad_id"))))
    spine = read(spark, sf, "customer").select(F.inline(up(F.col("c_custkey")))).distinct()
    found = cumulative.windows_at(daily, spine, ["entity_type", "entity_id"], measures, _AS_OF, CANON.windows)
    r = lambda a, b: E.rounded(E.ratio(F.col(a), F.col(b)), 6)
    return found.select("*", r("purchase_value", "spend").alias("roas"), r("spend", "purchases").alias("cpa"))


_BACK = [date(2024, 1, 5) + timedelta(n) for n in range(12)]
_LIMITS = replace(CANON, target_roas=0.25)


@query(f"""WITH {DAILY}, pages AS (SELECT ad_id // 5 AS entity_id, ad_id, day, 1 AS k, spend, impressions, purchases, purchase_value // 2 AS purchase_value FROM daily UNION ALL SELECT ad_id // 5, ad_id, day, 2, spend, impressions, purchases, purchase_value FROM daily),
run AS (SELECT *, day + CASE WHEN k = 1 THEN 1 ELSE 4 + dayofyear(day)::INT % 3 END AS done FROM pages WHERE NOT (k = 2 AND dayofyear(day) % 11 = 0)),
v AS (SELECT *, lead(done) OVER (PARTITION BY ad_id, day ORDER BY done, k) AS till FROM run), a AS (SELECT (DATE '2024-01-05' + n::INT)::DATE AS as_of FROM range(12) r(n)),
one AS (SELECT as_of, entity_id, sum(spend)::BIGINT AS spend, sum(impressions)::BIGINT AS impressions, sum(purchases)::BIGINT AS p, sum(purchase_value)::BIGINT AS v, coalesce(sum(spend) FILTER (day > as_of - 7), 0)::BIGINT AS rs, coalesce(sum(impressions) FILTER (day > as_of - 7), 0)::BIGINT AS ri, coalesce(sum(purchase_value) FILTER (day > as_of - 7), 0)::BIGINT AS rv
 FROM v, a WHERE day > as_of - 14 AND day <= as_of AND done <= as_of AND (till IS NULL OR till > as_of) GROUP BY 1, 2),
two AS (SELECT as_of, entity_id, sum(spend)::BIGINT AS sa, sum(purchases)::BIGINT AS pa, sum(purchase_value)::BIGINT AS va FROM v, a WHERE day > as_of AND day <= as_of + 14 AND done <= as_of + 14 AND (till IS NULL OR till > as_of + 14) GROUP BY 1, 2),
t AS (SELECT *, v::DOUBLE / nullif(spend, 0) AS roas, pow(greatest(0, sqrt(p + 0.375::DOUBLE) - 1.645::DOUBLE / 2), 2) AS lo, CASE WHEN rs > 0 OR ri > 0 THEN rv::DOUBLE / nullif(rs, 0) END AS recent FROM one FULL JOIN two USING (as_of, entity_id)),
c AS (SELECT *, CASE WHEN (spend > 0 OR impressions > 0) AND p >= 20 AND roas * greatest(lo, 0.01) / p > 0.25 THEN greatest(0.5::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, (p - 20) / 20.0::DOUBLE))) END AS conf FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY conf DESC NULLS LAST, entity_id) AS n1, row_number() OVER (PARTITION BY as_of ORDER BY recent DESC NULLS LAST, entity_id) AS n2 FROM c),
x AS (SELECT as_of, 'SYSTEM' AS strategy, entity_id AS unit_id, conf, floor(5 + conf * 10 + 0.5)::DOUBLE AS percent, coalesce(sa, 0) AS sa, coalesce(pa, 0) AS pa, coalesce(va, 0) AS va FROM k WHERE n1 = 1 AND conf IS NOT NULL
 UNION ALL SELECT as_of, 'NAIVE_HIGHEST_RECENT_ROAS', entity_id, NULL, 20.0::DOUBLE, coalesce(sa, 0), coalesce(pa, 0), coalesce(va, 0) FROM k WHERE n2 = 1 AND recent IS NOT NULL),
y AS (SELECT a.as_of, s.strategy, x.* EXCLUDE (as_of, strategy), va::DOUBLE / nullif(sa, 0) AS after, greatest(pow(greatest(0, sqrt(pa + 0.375::DOUBLE) - 1.645::DOUBLE / 2), 2), 0.01) AS l, pow(sqrt(pa + 0.375::DOUBLE) + 1.645::DOUBLE / 2, 2) AS h FROM a CROSS JOIN (VALUES ('SYSTEM'), ('NAIVE_HIGHEST_RECENT_ROAS')) s(strategy) LEFT JOIN x ON x.as_of = a.as_of AND x.strategy = s.strategy),
z AS (SELECT *, CASE WHEN after IS NULL THEN NULL WHEN pa < 20 OR pa = 0 THEN 'NOT_DISTINGUISHABLE' WHEN after * l / pa > 0.25 THEN 'ABOVE_TARGET' WHEN after * h / pa < 0.25 THEN 'BELOW_TARGET' ELSE 'NOT_DISTINGUISHABLE' END AS verdict FROM y),
m AS (SELECT as_of, (sum({MINOR('o_totalprice')}))::BIGINT AS net FROM (SELECT *, (DATE '2024-01-01' + (o_orderkey % 30)::INT)::DATE AS day, (DATE '2024-01-01' + (o_orderkey % 30)::INT + (o_custkey % 4)::INT)::DATE AS done FROM orders), a WHERE day > as_of - 14 AND day <= as_of AND done <= as_of GROUP BY 1),
s AS (SELECT as_of, sum(spend) AS spend FROM one GROUP BY 1)
SELECT z.as_of, z.strategy, unit_id, CASE WHEN unit_id IS NULL THEN 'INSUFFICIENT_DATA' ELSE 'INCREASE_BUDGET' END AS action, percent AS change_percent, {R6('conf')} AS confidence, false AS refused, pa AS purchases_after, {R6('after')} AS roas_after, verdict,
 {R6("pow(conf - CASE WHEN verdict IS NULL THEN NULL WHEN verdict = 'ABOVE_TARGET' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 2)")} AS brier, {R6('coalesce(net, 0)::DOUBLE / nullif(spend::DOUBLE, 0)')} AS store_to_spend, (SELECT count(*) FROM range(14) r(n) WHERE z.as_of - n::INT BETWEEN DATE '2024-01-03' AND DATE '2024-01-05')::BIGINT AS gap_days
FROM z LEFT JOIN m USING (as_of) LEFT JOIN s USING (as_of)""")
def archive_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Two strategies at twelve days, from archived reports whose restatements arrive days later: what a later run brought is never seen, and all days are one plan.

    A day's first run knows half the value and ends the next day; a second one ends four to six days after, but for every eleventh day, on which it fails."""
    d = facts.daily(spark, sf).select("ad_id", "day", "spend", "impressions", "purchases", "purchase_value")
    body = lambda value: F.to_json(F.struct("ad_id", F.col("day").cast("string").alias("day"), "spend", "impressions", "purchases", value.cast("long").alias("purchase_value")))
    page = lambda k, value: d.select(D("reports").alias("source"), "day", (F.dayofyear("day") * 10 + k).cast("long").alias("run"), body(value).alias("body"))
    path = new_path(spark, "archive")
    archive.write(page(1, F.floor(F.col("purchase_value") / 2)).unionByName(page(2, F.col("purchase_value"))), path)
    rows = archive.read(spark, path, "reports").select("run", F.from_json("body", "ad_id long, day date, spend long, impressions long, purchases long, purchase_value long").alias("r")).select("run", "r.*")
    again = F.col("run") % 10 == 2
    log = rows.select("run", "day").distinct().select("run", F.when(again & (F.dayofyear("day") % 11 == 0), "FAILED").otherwise("SUCCEEDED").alias("status"), F.date_add("day", F.when(again, 4 + F.dayofyear("day") % 3).otherwise(1)).cast("timestamp").alias("finished_at"))
    known = bitemporal.versions(rows, log, ["ad_id", "day"]).withColumn("entity_id", F.floor(F.col("ad_id") / 5))
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    day = F.date_add(D("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int"))
    store = o.select(day.alias("day"), E.minor(F.col("o_totalprice")).alias("net"), F.date_add(day, (F.col("o_custkey") % 4).cast("int")).cast("timestamp").alias("known_from"), D(None).cast("timestamp").alias("known_to"))
    gaps = spark.createDataFrame([(date(2024, 1, 3), date(2024, 1, 5))], "start date, end date")
    return bitemporal.backtest(known, store, gaps, _BACK, primary=14, recent=7, horizon=14, floor=20, canon=_LIMITS)


_CAL = [(n, date(y, *a), date(y, *b)) for y in range(1992, 1999) for n, a, b in (("harvest", (11, 1), (11, 7)), ("spring", (3, 10), (3, 12)), ("fair", (11, 5), (11, 9)))] + [("jubilee", date(1995, 6, 1), date(1995, 6, 3))]
_CALS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _CAL)
_TOUCHED = lambda a, b: f"coalesce((SELECT list_sort(list(DISTINCT label)) FROM c WHERE first <= {b} AND last >= {a}), [])"


@query(f"""WITH c AS (SELECT * FROM (VALUES {_CALS}) t(label, first, last)), o AS (SELECT o_orderdate::DATE AS day, sum({MINOR('o_totalprice')})::BIGINT AS revenue FROM orders GROUP BY 1), b AS (SELECT min(day) AS a, max(day) AS z FROM o),
v AS (SELECT day, coalesce(revenue, 0) AS revenue FROM (SELECT (a + i::INT)::DATE AS day FROM b, range(0, 20000) r(i) WHERE a + i::INT <= z) LEFT JOIN o USING (day)),
x AS (SELECT label, first, count(v.day) AS season_days, avg(revenue) AS sm FROM c LEFT JOIN v ON day BETWEEN first AND last GROUP BY 1, 2),
k AS (SELECT label, first, revenue, row_number() OVER (PARTITION BY label, first ORDER BY day DESC) AS r FROM c JOIN v ON day BETWEEN first - 90 AND first - 1 WHERE NOT EXISTS (SELECT 1 FROM c q WHERE v.day BETWEEN q.first AND q.last)),
m AS (SELECT label, first, count(*) AS base_days, avg(revenue) AS bm FROM k WHERE r <= 30 GROUP BY 1, 2), e AS (SELECT label, first, sm / bm AS ratio FROM x JOIN m USING (label, first) WHERE season_days >= 1 AND base_days >= 7 AND bm <> 0),
w AS (SELECT DISTINCT date_trunc('month', day)::DATE AS start FROM o), l AS (SELECT start, last_day(start) AS fin, {_TOUCHED('start', 'last_day(start)')} AS labels, {_TOUCHED('(start - 28)', '(start - 1)')} AS base FROM w),
d AS (SELECT start, count(*) AS usable, sum(ratio) AS s FROM (SELECT start, unnest(labels) AS label FROM l) JOIN e USING (label) GROUP BY 1), r AS (SELECT date_trunc('month', day)::DATE AS start, sum(revenue)::BIGINT AS revenue FROM o GROUP BY 1)
SELECT start, array_to_string(labels, ',') AS labels, array_to_string(base, ',') AS base_labels, labels <> base AS spans_boundary, revenue, coalesce(usable, 0)::BIGINT AS usable, {R6('CASE WHEN len(labels) = 0 THEN 1.0::DOUBLE WHEN usable >= 2 THEN s / usable END')} AS demand FROM l LEFT JOIN d USING (start) JOIN r USING (start)""")
def order_seasons(spark: SparkSession, sf: str) -> DataFrame:
    """Every month that has orders: its labels and those of the four weeks before, whether they are of different regimes, and the demand that its labels brought before."""
    o = facts.orders(spark, sf).groupBy("day").agg(F.sum("gross").alias("revenue"))
    days = o.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    cal = spark.createDataFrame(_CAL, "label string, first date, last date")
    found = seasons.demand(days.join(o, "day", "left").select("day", F.coalesce("revenue", D(0)).alias("revenue"), D(True).alias("clean")), cal)
    months = o.groupBy(F.trunc("day", "month").alias("start")).agg(F.sum("revenue").alias("revenue")).select("*", F.last_day("start").alias("end"), F.date_sub("start", 28).alias("base_start"), F.date_sub("start", 1).alias("base_end"))
    w = seasons.demand_of(seasons.context(months, cal), found)
    return w.select("start", F.array_join("labels", ",").alias("labels"), F.array_join("base_labels", ",").alias("base_labels"), "spans_boundary", "revenue", "usable", E.rounded(F.col("demand"), 6).alias("demand"))


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r > 1""")
def stream_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream rejected, row by row, with the version that was kept when it came."""
    folder = latest.run(spark, f"{sf}/events.parquet*", "user_id", "event_id", "ts", columns=("user_id", "event_id", "ts"))
    return latest.rejected_of_stream(spark, folder).select("user_id", "event_id", "ts")
