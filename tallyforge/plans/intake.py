"""Queries of intake, ownership, changes, packets and back-tests, each followed by its SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators import features
from tallyforge.operators.backtest import backtest
from tallyforge.plans.sql import DAILY, MINOR, ORACLE_SQL as CORE, R6, TOTALS
from tallyforge.runtime import documents as read
from tallyforge.runtime import new_path
from tallyforge.sources import facts, intake

D = F.lit
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def money(c: str):
    return F.col(c).cast("decimal(18,2)").cast("string")


_LINES = f"""li AS (SELECT l_orderkey, count(*) AS lines, sum(trunc(l_quantity)::BIGINT)::BIGINT AS units, sum({MINOR('l_extendedprice')})::BIGINT AS total FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_LINES}, b AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, sum({MINOR('l_extendedprice')})::BIGINT AS back FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS order_id, '#' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' +0000' AS created_at, o_custkey AS customer_id, coalesce(lines, 0)::BIGINT AS lines, coalesce(units, 0)::BIGINT AS units,
 coalesce(total, 0)::BIGINT AS line_total, coalesce(n, 0)::BIGINT AS refunds, coalesce(back, 0)::BIGINT AS refund_total FROM orders LEFT JOIN li ON li.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""")
def csv_orders(spark: SparkSession, sf: str) -> DataFrame:
    """An export of every order written as CSV (with junk rows), read back and grouped."""
    none = D(None).cast("string")
    key = F.col("l_orderkey").cast("string")
    o = read(spark, sf, "orders").select(D(0).cast("long"), F.col("o_orderkey").cast("string"), F.concat(D("#"), F.col("o_orderkey")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss +0000"), F.col("o_custkey").cast("string"), none, none, none, none, none)
    li = read(spark, sf, "lineitem")
    keyed = li.join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    line = lambda *values: F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    item = line((F.col("l_linenumber") + 1).cast("long"), key, none, none, none, D("Line Item"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"), money("l_extendedprice"), none)
    back = line((F.col("l_linenumber") + 1000).cast("long"), key, none, none, none, D("Refund Line"), F.col("l_partkey").cast("string"), none, F.concat(D("-"), money("l_extendedprice")), F.concat_ws("-", D("R"), key, F.col("l_linenumber")))
    lines = keyed.select(F.inline(F.array_compact(F.array(item, F.when(F.col("l_returnflag") == "R", back)))))
    junk = spark.range(2).select("id", F.when(F.col("id") == 0, "######## end").otherwise("  "), D("junk"), none, none, none, none, none, none, none)
    names = [c.strip().split("`")[1] for c in intake.CSV_COLUMNS.split(",")]
    path = new_path(spark, "orders-csv")
    o.union(lines).union(junk).toDF(*names).write.option("header", True).csv(path)
    rows, _ = intake.order_csv(spark, path)
    return intake.csv_orders(rows)


@query(f"""WITH {_LINES}, b AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN {MINOR('l_extendedprice')} ELSE {MINOR('l_extendedprice')} + 150 END)::BIGINT AS back FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey AS order_id, l_orderkey % 997 AS customer_id, lines, units, total AS line_total, coalesce(back, 0)::BIGINT AS refund_total FROM li LEFT JOIN b USING (l_orderkey)""")
def json_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Store documents (one an order) parsed; refunds without a successful transaction fall back to their lines."""
    price = money("l_extendedprice")
    status = F.when(F.col("l_linenumber") % 2 == 0, "success").otherwise("failure")
    item = F.struct(F.concat(D("gid://store/Product/"), F.col("l_partkey")).alias("product"), F.col("l_quantity").cast("long").alias("quantity"), price.alias("total"))
    back = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.array(F.struct(D("refund").alias("kind"), status.alias("status"), F.concat(D("-"), price).alias("amount"))).alias("transactions"), F.array(F.struct(price.alias("subtotal"), D("1.50").alias("tax"))).alias("lines"))
    docs = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("lineItems"), F.collect_list(F.when(F.col("l_returnflag") == "R", back)).alias("refunds"))
    body = F.to_json(F.struct(F.concat(D("gid://store/Order/"), F.col("l_orderkey")).alias("id"), F.struct(F.concat(D("gid://store/Customer/"), F.col("l_orderkey") % 997).alias("id")).alias("customer"), "lineItems", "refunds"))
    return intake.store_orders(docs.select(body.alias("body"))).drop("created_at")


@query(f"WITH {DAILY} SELECT ad_id, day, impressions, clicks, spend, purchases, purchase_value, '7d_click,1d_view' AS attribution FROM daily")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Report documents of all daily facts and one malformed document an ad; only well-formed rows come back."""
    value = lambda c: F.array(F.struct(D("link_click").alias("action_type"), D("9").alias("value")), F.struct(D("purchase").alias("action_type"), c.alias("value")))
    text = lambda c: E.format_money(F.col(c), D("INR"))
    row = F.struct(F.col("ad_id").cast("string").alias("ad_id"), F.col("day").cast("string").alias("date_start"), text("spend").alias("spend"), F.concat(F.col("impressions").cast("string"), D(".0")).alias("impressions"), F.col("clicks").cast("string").alias("clicks"), D("7d_click_1d_view").alias("attribution_setting"), value(F.col("purchases").cast("string")).alias("actions"), value(text("purchase_value")).alias("action_values"))
    d = facts.daily(spark, sf).select("ad_id", F.to_json(row).alias("body"))
    bad = d.select("ad_id").distinct().select("ad_id", D('{"ad_id": "", "date_start": "x"}').alias("body"))
    return intake.report_rows(d.unionByName(bad))


@query("SELECT event_id, 'ads' AS source, ts::DATE AS day, 'daily_' || event_type AS resource, 'run' || event_id % 50 AS run, user_id AS seq FROM events")
def archive_paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(D("raw/ads/"), F.date_format("ts", "yyyy/MM/dd"), D("/daily_"), "event_type", D("_run"), F.col("event_id") % 50, D("_"), "user_id", D(".json"))
    return read(spark, sf, "events").select("event_id", *intake.archive_parts(path))


@query("""SELECT o_orderkey, (o_orderdate - INTERVAL 330 MINUTE)::TIMESTAMP AS instant, o_orderdate::DATE AS day, (o_orderdate::DATE - INTERVAL 330 MINUTE)::TIMESTAMP AS starts, (o_orderdate::DATE + 1 - INTERVAL 330 MINUTE)::TIMESTAMP AS ends, (o_orderdate::DATE + 1)::DATE AS from_native FROM orders""")
def order_instants(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps with an offset, strictly parsed; bounds of their reporting day; a Honolulu day's reporting day."""
    text = read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss +0530").alias("t"))
    at = E.parse_instant(F.col("t"))
    r = text.select("o_orderkey", at.alias("i")).withColumn("day", E.reporting_day(F.col("i"), CANON.timezone))
    start, end = E.day_bounds(F.col("day"), CANON.timezone)
    plain = lambda c: c.cast("timestamp_ntz")
    return r.select("o_orderkey", plain(F.col("i")).alias("instant"), "day", plain(start).alias("starts"), plain(end).alias("ends"), E.native_day(F.col("day"), "Pacific/Honolulu", CANON.timezone).alias("from_native"))


@query("""WITH o AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT min(day) AS a, max(day) AS z FROM o),
s AS (SELECT (a + i::INT)::DATE AS day FROM b, range(0, 20000) r(i) WHERE a + i::INT <= z) SELECT day, coalesce(n, 0)::BIGINT AS orders, CASE WHEN day >= DATE '1996-02-01' AND day < DATE '1996-02-15' THEN 'MIGRATION' END AS gap FROM s LEFT JOIN o USING (day)""")
def coverage_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Every day from the first order to the last, zero-filled, with the known half-open gap."""
    n = facts.orders(spark, sf).groupBy("day").agg(F.count("*").alias("orders"))
    spine = n.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day"))
    gap = F.when((F.col("day") >= D(date(1996, 2, 1))) & (F.col("day") < D(date(1996, 2, 15))), "MIGRATION")
    return spine.join(n, "day", "left").select("day", F.coalesce("orders", D(0)).alias("orders"), gap.alias("gap"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT date_trunc('month', day)::DATE AS month, count(*) AS days, count(*) FILTER (dayofweek(day) IN (0, 6)) AS weekend_days, count(*) FILTER (dayofweek(day) NOT IN (0, 6)) AS weekdays,
 (min(day) - 28)::DATE AS previous_start, (min(day) - 1)::DATE AS previous_end FROM d GROUP BY 1""")
def window_calendar(spark: SparkSession, sf: str) -> DataFrame:
    d = facts.orders(spark, sf).select("day").distinct()
    weekend = F.dayofweek("day").isin(1, 7)
    return d.groupBy(F.trunc("day", "month").alias("month")).agg(F.count("*").alias("days"), F.count_if(weekend).alias("weekend_days"), F.count_if(~weekend).alias("weekdays"), F.date_sub(F.min("day"), 28).alias("previous_start"), F.date_sub(F.min("day"), 1).alias("previous_end"))


@query(r"""WITH n AS (SELECT lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) AS name, count(*) AS n, min(p_partkey) AS entity FROM part GROUP BY 1),
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN o_custkey::VARCHAR WHEN o_orderkey % 10 < 8 THEN lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) WHEN o_orderkey % 10 = 8 THEN '99999999999' END AS tag FROM orders LEFT JOIN part ON p_partkey = o_custkey)
SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'AD_ID' WHEN n.n = 1 THEN 'NAME_MATCH' ELSE 'UNRESOLVED' END AS resolution, CASE WHEN c_custkey IS NOT NULL THEN c_custkey WHEN n.n = 1 THEN n.entity END AS entity, coalesce(CASE WHEN c_custkey IS NULL THEN n.n END, 0)::BIGINT AS candidates
FROM t LEFT JOIN customer ON regexp_full_match(tag, '\d+') AND c_custkey = TRY_CAST(tag AS BIGINT) LEFT JOIN n ON n.name = tag""")
def order_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The ladder: a numeric tag that names a known id, else a name that exactly one entity has, else unresolved."""
    parts = read(spark, sf, "part").select("p_partkey", "p_name")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(parts, F.col("p_partkey") == F.col("o_custkey"), "left")
    last = F.col("o_orderkey") % 10
    tagged = o.select("o_orderkey", F.when(last < 6, F.col("o_custkey").cast("string")).when(last < 8, F.concat(D(" "), F.upper("p_name"))).when(last == 8, "99999999999").alias("tag"))
    index = parts.groupBy(E.normal_name(F.col("p_name")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("named"))
    ids = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    r = tagged.withColumn("id", F.when(F.col("tag").rlike(r"^\d+$"), F.col("tag").try_cast("long"))).withColumn("name", E.normal_name(F.col("tag")))
    r = r.join(ids.withColumn("known", D(True)), "id", "left").join(index, "name", "left")
    known, one = F.coalesce("known", D(False)), F.col("n") == 1
    return r.select("o_orderkey", F.when(known, "AD_ID").when(one, "NAME_MATCH").otherwise("UNRESOLVED").alias("resolution"), F.when(known, F.col("id")).when(one, F.col("named")).alias("entity"), F.coalesce(F.when(~known, F.col("n")), D(0)).alias("candidates"))


@query("""WITH a AS (SELECT c_custkey, c_nationkey, coalesce(c_acctbal > 5000, false) AS own FROM customer), k AS (SELECT n_nationkey, n_nationkey % 3 = 0 AS own, count(c_custkey) AS kids, count(*) FILTER (a.own) AS owning, min(c_custkey) FILTER (a.own) AS only_one FROM nation LEFT JOIN a ON c_nationkey = n_nationkey GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN own THEN 'CAMPAIGN' WHEN kids = 0 THEN 'UNKNOWN' WHEN owning > 0 THEN 'ADSETS' ELSE 'UNKNOWN' END AS campaign_budget FROM k)
SELECT c_custkey AS adset_id, campaign_budget, CASE WHEN a.own AND NOT c.own THEN 'ADSET' WHEN c.own AND NOT a.own THEN 'CAMPAIGN' ELSE 'UNKNOWN' END AS adset_budget,
 CASE WHEN a.own AND NOT c.own THEN 'ADSET' WHEN c.own AND NOT a.own THEN 'CAMPAIGN' ELSE 'NO_DECISION_UNIT' END AS unit, CASE WHEN a.own AND NOT c.own THEN c_custkey WHEN c.own AND NOT a.own THEN c_nationkey::BIGINT END AS unit_id, CASE WHEN campaign_budget = 'ADSETS' AND owning = 1 THEN only_one END AS campaign_defers_to
FROM a JOIN c ON c_nationkey = n_nationkey""")
def budget_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Who owns the budget of each ad set (customers) and campaign (nations), and which unit a decision is about."""
    sets = read(spark, sf, "customer").select(F.col("c_custkey").alias("adset_id"), F.col("c_nationkey").alias("campaign"), F.coalesce(F.col("c_acctbal") > 5000, D(False)).alias("own"))
    kids = sets.groupBy("campaign").agg(F.count("*").alias("kids"), F.count_if("own").alias("owning"), F.min(F.when(F.col("own"), F.col("adset_id"))).alias("only_one"))
    top = read(spark, sf, "nation").select(F.col("n_nationkey").alias("campaign"), (F.col("n_nationkey") % 3 == 0).alias("top_own")).join(kids, "campaign", "left")
    budget = F.when(F.col("top_own"), "CAMPAIGN").when(F.coalesce("kids", D(0)) == 0, "UNKNOWN").when(F.col("owning") > 0, "ADSETS").otherwise("UNKNOWN")
    j = sets.join(top.withColumn("campaign_budget", budget), "campaign")
    mine, theirs = F.col("own") & ~F.col("top_own"), F.col("top_own") & ~F.col("own")
    pick = lambda other: F.when(mine, "ADSET").when(theirs, "CAMPAIGN").otherwise(other)
    return j.select("adset_id", "campaign_budget", pick("UNKNOWN").alias("adset_budget"), pick("NO_DECISION_UNIT").alias("unit"), F.when(mine, F.col("adset_id")).when(theirs, F.col("campaign").cast("long")).alias("unit_id"), F.when((F.col("campaign_budget") == "ADSETS") & (F.col("owning") == 1), F.col("only_one")).alias("campaign_defers_to"))


_RECENT = "count(*) FILTER (event_type = '{0}' AND ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL {1} DAY)"


@query(f"""WITH c AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts) FILTER (event_type = 'click'))) AS b, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts) FILTER (event_type = 'view'))) AS v, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts) FILTER (event_type = 'error'))) AS s,
 {_RECENT.format('click', 7)} AS budget_changes_7d, {_RECENT.format('view', 14)} AS targeting_changes_14d, {_RECENT.format('signup', 7)} AS creative_changes_7d FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1),
h AS (SELECT *, floor(b / 3600000000.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS hours_since_budget, floor(v / 3600000000.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS hours_since_targeting, floor(s / 3600000000.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS hours_since_status FROM c)
SELECT user_id, hours_since_budget, hours_since_targeting, hours_since_status, budget_changes_7d, targeting_changes_14d, creative_changes_7d, budget_changes_7d > 0 OR creative_changes_7d > 0 OR coalesce(hours_since_targeting < 336, false) OR coalesce(hours_since_status < 72, false) AS major FROM h""")
def change_features(spark: SparkSession, sf: str) -> DataFrame:
    """Hours since the last change of each kind, counts of late ones, and whether a major change is recent."""
    # Event types stand for kinds of change.
    e = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    now = F.expr("timestamp_ntz'2024-01-30 12:00:00'")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    since = lambda k: E.rounded((micros(now) - micros(F.max(F.when(F.col("event_type") == k, F.col("ts"))))) / 3600000000.0, 2)
    recent = lambda k, n: F.count_if((F.col("event_type") == k) & (F.col("ts") >= now - F.expr(f"interval {n} days")))
    c = e.where(F.col("ts") <= now).groupBy("user_id").agg(since("click").alias("hours_since_budget"), since("view").alias("hours_since_targeting"), since("error").alias("hours_since_status"), recent("click", 7).alias("budget_changes_7d"), recent("view", 14).alias("targeting_changes_14d"), recent("signup", 7).alias("creative_changes_7d"))
    less = lambda c, n: F.coalesce(F.col(c) < n, D(False))
    return c.withColumn("major", (F.col("budget_changes_7d") > 0) | (F.col("creative_changes_7d") > 0) | less("hours_since_targeting", 336) | less("hours_since_status", 72))


@query(f"""WITH d AS ({CORE['decisions']}), x AS (SELECT entity_id, unnest(string_split(reasons, ' | ')) AS code FROM d WHERE reasons <> '') SELECT code, count(*) AS n, max(entity_id) AS latest FROM x GROUP BY 1""")
def violation_summary(spark: SparkSession, sf: str) -> DataFrame:
    from tallyforge.plans.queries import decisions

    d = decisions(spark, sf).where("reasons <> ''")
    return d.select("entity_id", F.explode(F.split("reasons", r" \| ")).alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.max("entity_id").alias("latest"))


_TEXT = "'Ad set ' || entity_id || E'\\n\\n' || 'Last ' || days || ' days: ' || purchases || ' purchases, spend ' || spend || '.' || E'\\n\\n' || CASE WHEN purchases < floor_n THEN 'Too few purchases for a verdict (' || purchases || ' of ' || floor_n || ').' ELSE 'Enough purchases for a verdict.' END"


@query(f"WITH {TOTALS} SELECT 'ADSET_' || entity_id || '_' || days AS packet_id, {_TEXT} AS text FROM totals WHERE entity_type = 'ADSET'")
def packet_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The decision packet of every ad set and window as text, sections parted by a blank line."""
    t = features.recent(spark, sf).where("entity_type = 'ADSET'")
    few = F.concat(D("Too few purchases for a verdict ("), "purchases", D(" of "), "floor", D(")."))
    numbers = F.concat(D("Last "), "days", D(" days: "), "purchases", D(" purchases, spend "), "spend", D("."))
    text = F.concat_ws("\n\n", F.concat(D("Ad set "), "entity_id"), numbers, F.when(F.col("purchases") < F.col("floor"), few).otherwise("Enough purchases for a verdict."))
    return t.select(F.concat_ws("_", D("ADSET"), "entity_id", "days").alias("packet_id"), text.alias("text"))


@query("""SELECT user_id, max(ts)::DATE AS watermark, least(max(ts)::DATE + 1, DATE '2024-01-30' - 13)::DATE AS fetch_from, DATE '2024-01-30' - 59 AS deep_from,
 CASE WHEN max(ts)::DATE < DATE '2024-01-30' - 6 THEN 'no_new_data' ELSE 'healthy' END AS health FROM events GROUP BY 1""")
def fetch_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The next range to fetch from each account's watermark, with the rolling re-fetch of late rows."""
    m = read(spark, sf, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("watermark"))
    back = lambda n: D(CANON.as_of - timedelta(n - 1))
    return m.select("user_id", "watermark", F.least(F.date_add("watermark", 1), back(CANON.rolling_days)).alias("fetch_from"), back(CANON.order_window_days).alias("deep_from"), F.when(F.col("watermark") < back(7), "no_new_data").otherwise("healthy").alias("health"))


BACKTEST_DAYS = [date(2024, 1, d) for d in (8, 12, 16)]


@query(f"""WITH {DAILY}, a AS (SELECT * FROM (VALUES (DATE '2024-01-08'), (DATE '2024-01-12'), (DATE '2024-01-16')) t(as_of)),
t AS (SELECT as_of, (ad_id // 5)::BIGINT AS entity_id, coalesce(sum(spend) FILTER (day <= as_of), 0)::BIGINT AS spend, coalesce(sum(purchases) FILTER (day <= as_of), 0)::BIGINT AS p, coalesce(sum(purchase_value) FILTER (day <= as_of), 0)::BIGINT AS v,
 coalesce(sum(spend) FILTER (day > as_of), 0)::BIGINT AS spend_after, coalesce(sum(purchases) FILTER (day > as_of), 0)::BIGINT AS pa, coalesce(sum(purchase_value) FILTER (day > as_of), 0)::BIGINT AS va
 FROM daily, a WHERE day > as_of - 7 AND day <= as_of + 14 GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN p >= 12 THEN greatest(0.5::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, (p - 12) / 12::DOUBLE))) END AS c, v::DOUBLE / spend AS roas FROM t WHERE spend > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY c DESC NULLS LAST, entity_id) AS rs, row_number() OVER (PARTITION BY as_of ORDER BY roas DESC, entity_id) AS rn FROM u),
x AS (SELECT 'SYSTEM' AS strategy, c AS conf, * FROM k WHERE rs = 1 AND c IS NOT NULL UNION ALL SELECT 'NAIVE', NULL, * FROM k WHERE rn = 1),
y AS (SELECT *, va::DOUBLE / nullif(spend_after::DOUBLE, 0) AS after, pow(greatest(0, sqrt(pa + 0.375::DOUBLE) - 1.645::DOUBLE / 2), 2) AS lo, pow(sqrt(pa + 0.375::DOUBLE) + 1.645::DOUBLE / 2, 2) AS hi FROM x),
z AS (SELECT *, CASE WHEN after IS NULL THEN NULL WHEN pa < 12 THEN 'NOT_DISTINGUISHABLE' WHEN after * lo / pa > 0.5 THEN 'ABOVE_TARGET' WHEN after * hi / pa < 0.5 THEN 'BELOW_TARGET' ELSE 'NOT_DISTINGUISHABLE' END AS verdict FROM y)
SELECT as_of, strategy, entity_id, {R6('conf')} AS confidence, pa AS purchases_after, {R6('after')} AS roas_after, verdict, {R6("pow(conf - CASE WHEN verdict IS NULL THEN NULL WHEN verdict = 'ABOVE_TARGET' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 2)")} AS brier FROM z""")
def backtest_run(spark: SparkSession, sf: str) -> DataFrame:
    return backtest(facts.daily(spark, sf), F.floor(F.col("ad_id") / 5), BACKTEST_DAYS, days=7, horizon=14, floor=12)
