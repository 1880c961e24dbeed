"""Queries of features on the entity spine, each preceded by its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators import spine
from tallyforge.plans.sql import MINOR, R6
from tallyforge.runtime import table
from tallyforge.sources import dims

D = F.lit
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


ADS = "ads AS (SELECT c_custkey AS ad_id, c_custkey // 5 AS adset_id, c_custkey // 25 AS campaign_id, c_nationkey::BIGINT AS family_id, c_name AS name FROM customer), camps AS (SELECT campaign_id, CASE WHEN campaign_id % 7 = 6 THEN 'spare' ELSE arg_min(name, ad_id) END AS name FROM ads GROUP BY 1)"
_LEVELS = "[{'t': 'AD', 'i': ad_id}, {'t': 'ADSET', 'i': adset_id}, {'t': 'CAMPAIGN', 'i': campaign_id}, {'t': 'CREATIVE_FAMILY', 'i': family_id}, {'t': 'ACCOUNT', 'i': 0}]"
SPINE = f"spine AS (SELECT DISTINCT e.t AS entity_type, e.i AS entity_id FROM (SELECT unnest({_LEVELS}) AS e FROM ads))"
_COUNT = lambda k, more="": f"count(*) FILTER (event_type = '{k}'{more})"
DELIVERY = f"""del AS (SELECT user_id AS ad_id, ts::DATE AS day, {_COUNT('view')} AS impressions, CASE WHEN {_COUNT('view')} > 0 THEN count(DISTINCT hour(ts)) FILTER (event_type = 'view') END AS reach, {_COUNT('click')} AS clicks,
 {_COUNT('click', ' AND value > 20')} AS landings, {_COUNT('signup')} AS carts, {_COUNT('signup', ' AND value > 20')} AS checkouts, {_COUNT('purchase')} AS purchases, coalesce(sum({MINOR('value')}) FILTER (event_type IN ('view', 'click')), 0) AS spend,
 coalesce(sum({MINOR('value')}) FILTER (event_type = 'purchase'), 0) AS purchase_value, CASE WHEN user_id % 10 = 3 AND day(ts::DATE) > 20 THEN '1d_click' ELSE '7d_click' END AS attribution FROM events GROUP BY user_id, ts::DATE, CASE WHEN user_id % 10 = 3 AND day(ts::DATE) > 20 THEN '1d_click' ELSE '7d_click' END)"""
STORE = f"""firsts AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS f FROM orders GROUP BY 1),
so AS (SELECT o_orderkey AS order_id, (DATE '2023-12-05' + (o_orderkey % 57)::INT)::DATE AS day, {MINOR('o_totalprice')} AS gross, CASE WHEN o_orderkey % 10 <> 9 THEN o_orderkey = f END AS new_customer,
 CASE WHEN o_orderkey % 10 < 5 THEN o_custkey::VARCHAR WHEN o_orderkey % 10 < 8 THEN lower(camps.name) WHEN o_orderkey % 10 = 8 THEN '99999999999' END AS tag FROM orders JOIN firsts USING (o_custkey) LEFT JOIN camps ON camps.campaign_id = o_custkey // 25),
sr AS (SELECT l_orderkey AS order_id, (DATE '2023-12-05' + (l_orderkey % 57)::INT + 3 * l_linenumber::INT)::DATE AS day, {MINOR('l_extendedprice')} AS refund FROM lineitem WHERE l_returnflag = 'R'),
uniq AS (SELECT lower(name) AS name, min(campaign_id) AS campaign_id FROM camps GROUP BY 1 HAVING count(*) = 1),
res AS (SELECT order_id, 'AD_ID' AS resolution, ad_id, campaign_id FROM so JOIN ads ON ads.ad_id::VARCHAR = tag UNION ALL SELECT order_id, 'NAME_MATCH', NULL, campaign_id FROM so JOIN uniq ON uniq.name = tag),
mt AS (SELECT order_id, e.t AS entity_type, e.i AS entity_id FROM (SELECT order_id, unnest({_LEVELS}) AS e FROM res JOIN ads USING (ad_id) WHERE resolution = 'AD_ID' ) UNION ALL SELECT order_id, 'CAMPAIGN', campaign_id FROM res WHERE resolution = 'NAME_MATCH' UNION ALL SELECT order_id, 'ACCOUNT', 0 FROM res WHERE resolution = 'NAME_MATCH')""".replace("JOIN ads USING (ad_id) WHERE", "JOIN (SELECT ad_id, adset_id, family_id FROM ads) USING (ad_id) WHERE")
_IN = "date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND days - 1"
WINS = "wins AS (SELECT * FROM (VALUES (7), (14), (28), (56)) t(days))"
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*spine.COUNTS,))
TOTALS = f"""{ADS}, {SPINE}, {WINS}, {DELIVERY}, {STORE},
dt AS (SELECT e.t AS entity_type, e.i AS entity_id, days, {_SUMS}, coalesce(sum(reach), 0)::BIGINT AS reach, CASE WHEN min(attribution) = max(attribution) THEN min(attribution) END AS attribution FROM (SELECT del.*, days, unnest({_LEVELS}) AS e FROM del JOIN ads USING (ad_id), wins WHERE {_IN}) GROUP BY 1, 2, 3),
sa AS (SELECT entity_type, entity_id, days, count(*) AS orders, count(*) FILTER (new_customer) AS new_orders, sum(gross)::BIGINT AS gross FROM so JOIN mt USING (order_id), wins WHERE {_IN} GROUP BY 1, 2, 3),
sb AS (SELECT entity_type, entity_id, days, sum(refund)::BIGINT AS refunds FROM sr JOIN mt USING (order_id), wins WHERE {_IN} GROUP BY 1, 2, 3),
tot AS (SELECT entity_type, entity_id, days, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in (*spine.COUNTS, 'reach', *spine.STORE))}, attribution FROM spine, wins LEFT JOIN dt USING (entity_type, entity_id, days) LEFT JOIN sa USING (entity_type, entity_id, days) LEFT JOIN sb USING (entity_type, entity_id, days))"""
TOTALS = TOTALS.replace("FROM spine, wins LEFT", "FROM (SELECT * FROM spine, wins) LEFT")
_Q = lambda a, b, k="1.0": R6(f"{a} * {k}::DOUBLE / nullif({b}, 0)")
_S = lambda x, name: f"CASE WHEN NOT blind THEN {x} END AS {name}"


def totals(spark: SparkSession, sf: str, kinds: tuple[str, ...] = dims.LEVELS, windows: tuple[int, ...] = CANON.windows) -> DataFrame:
    """Delivery and store totals of the entities of ``kinds`` and of ``windows``; nothing else is read or summed."""
    canon = replace(CANON, windows=windows)
    ads, since = dims.ads(spark, sf), F.date_sub(D(CANON.as_of), max(windows) - 1)
    # Written, since sales, refunds and both ways to match an order read them.
    orders = table(dims.store_orders(spark, sf), "orders")
    matched = spine.matches(spine.resolved(orders, ads, dims.campaigns(spark, sf)), ads, kinds)
    store = spine.store_totals(orders, dims.store_refunds(spark, sf), matched, canon)
    return spine.totals_on_spine(dims.entities(spark, sf, kinds), spine.delivery_totals(dims.delivery(spark, sf, since, D(CANON.as_of)), ads, canon, kinds), store, canon)


@query(f"""WITH {TOTALS}, m AS (SELECT tot.*, gross - refunds AS net, entity_type = 'AD' AND (url IS NULL OR trim(url) = '' OR NOT (regexp_matches(url, '[?&]ref=') OR regexp_matches(url, '\\{{\\{{(ad|campaign)\\.(id|name)\\}}\\}}'))) AS blind FROM tot LEFT JOIN pages ON entity_type = 'AD' AND page_id = entity_id)
SELECT entity_type, entity_id, days::INT AS days, {', '.join(spine.COUNTS)}, reach, attribution, {_Q('impressions', 'reach')} AS frequency, {_Q('spend', 'impressions', '1000.0')} AS cpm, {_Q('clicks', 'impressions')} AS ctr, {_Q('spend', 'clicks')} AS cpc, {_Q('purchases', 'clicks')} AS cvr,
 {_Q('carts', 'landings')} AS cart_rate, {_Q('checkouts', 'carts')} AS checkout_rate, {_Q('purchases', 'checkouts')} AS purchase_rate, {_Q('purchase_value', 'spend')} AS roas, {_Q('spend', 'purchases')} AS cpa,
 {', '.join(_S(x, f'store_{x}') for x in spine.STORE)}, {_S('net', 'store_net')}, {_S(_Q('gross', 'spend'), 'store_roas')}, {_S(_Q('gross', 'orders'), 'store_aov')}, {_S(_Q('new_orders', 'orders'), 'store_new_share')}, {_S(_Q('spend', 'new_orders'), 'store_new_cpa')}, {_S(_Q('refunds', 'gross'), 'store_refund_rate')}, {_S('net - spend', 'store_margin')} FROM m""")
def feature_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The metric set of every entity and window: delivery, funnel and matched store numbers."""
    return spine.metric_set(totals(spark, sf), dims.ad_urls(spark, sf))


@query(f"WITH {ADS}, {STORE} SELECT entity_type, entity_id, count(*) AS orders, count(DISTINCT order_id) AS distinct_orders, sum(gross)::BIGINT AS gross, min(day) AS first_day FROM mt JOIN so USING (order_id) GROUP BY 1, 2")
def entity_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each entity, each once, whether found by an ad's id or a campaign's name."""
    ads, orders = dims.ads(spark, sf), dims.store_orders(spark, sf)
    m = spine.matches(spine.resolved(orders, ads, dims.campaigns(spark, sf)), ads).join(orders, "order_id")
    return m.groupBy("entity_type", "entity_id").agg(F.count("*").alias("orders"), F.count_distinct("order_id").alias("distinct_orders"), F.sum("gross").alias("gross"), F.min("day").alias("first_day"))


@query(f"""WITH {ADS}, {STORE}, p AS (SELECT order_id, day AS order_day, resolution, campaign_id FROM so LEFT JOIN res USING (order_id) WHERE day >= DATE '2023-12-20')
SELECT order_id, order_day, sr.day AS refund_day, refund, coalesce(resolution, 'UNRESOLVED') AS resolution, campaign_id, order_day < DATE '2024-01-03' AS parent_outside_window FROM sr JOIN p USING (order_id) WHERE sr.day BETWEEN DATE '2024-01-03' AND DATE '2024-01-30'""")
def refund_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Refunds of 28 days with what their order resolved to; the order may be older than the window, but not than the fetched range."""
    ads, orders = dims.ads(spark, sf), dims.store_orders(spark, sf)
    first, last = F.date_sub(D(CANON.as_of), 27), D(CANON.as_of)
    found = spine.resolved(orders, ads, dims.campaigns(spark, sf))
    parents = orders.where(F.col("day") >= F.date_sub(first, 14)).select("order_id", F.col("day").alias("order_day")).join(found, "order_id", "left")
    r = dims.store_refunds(spark, sf).where(F.col("day").between(first, last)).join(parents, "order_id")
    return r.select("order_id", "order_day", F.col("day").alias("refund_day"), "refund", F.coalesce("resolution", D("UNRESOLVED")).alias("resolution"), "campaign_id", (F.col("order_day") < first).alias("parent_outside_window"))


_TREND = ", ".join(f"coalesce(sum({c}) FILTER (age < 7), 0)::DOUBLE AS {c}_now, coalesce(sum({c}) FILTER (age >= 7), 0)::DOUBLE AS {c}_before" for c in spine.COUNTS)
_PAIR = lambda k, a, b: f"{{'k': '{k}', 'c': {a}, 'p': {b}}}"
_OF = ", ".join([*(_PAIR(k, f"{k}_now", f"{k}_before") for k in ("spend", "impressions", "clicks", "purchases", "purchase_value")), *(_PAIR(k, f"{a}_now / nullif({b}_now, 0)", f"{a}_before / nullif({b}_before, 0)") for k, a, b in (("roas", "purchase_value", "spend"), ("cpa", "spend", "purchases"), ("ctr", "clicks", "impressions")))])


@query(f"""WITH {ADS}, {DELIVERY}, s AS (SELECT e.t AS entity_type, e.i AS entity_id, {_TREND} FROM (SELECT del.*, date_diff('day', day, DATE '2024-01-30') AS age, unnest({_LEVELS}) AS e FROM del JOIN ads USING (ad_id)) WHERE age BETWEEN 0 AND 13 GROUP BY 1, 2),
x AS (SELECT entity_type, entity_id, m.k AS metric, m.c AS c, m.p AS p, (m.c - m.p) * 100.0::DOUBLE / nullif(abs(m.p), 0) AS ch FROM (SELECT entity_type, entity_id, unnest([{_OF}]) AS m FROM s))
SELECT entity_type, entity_id, metric, {R6('c')} AS current, {R6('p')} AS previous, {R6('ch')} AS percent, CASE WHEN ch > 10 THEN 'UP' WHEN ch < -10 THEN 'DOWN' WHEN ch IS NOT NULL THEN 'STABLE' END AS trend FROM x""")
def entity_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Eight metrics of every entity, this week against the last."""
    return spine.trends(dims.delivery(spark, sf, F.date_sub(D(CANON.as_of), 13), D(CANON.as_of)), dims.ads(spark, sf))


_N, _LOW, _HIGH = "n", "greatest(pow(greatest(0, sqrt(n + 0.375::DOUBLE) - 1.645::DOUBLE / 2), 2), 0.01::DOUBLE)", "pow(sqrt(n + 0.375::DOUBLE) + 1.645::DOUBLE / 2, 2)"


@query(f"""WITH {TOTALS}, v AS (SELECT *, CASE WHEN entity_type <> 'ACCOUNT' AND entity_id % 5 = 4 THEN 1 ELSE 2 END AS version FROM tot WHERE days = 28),
a AS (SELECT purchase_value::DOUBLE / nullif(spend, 0) AS mean, version AS target FROM v WHERE entity_type = 'ACCOUNT'),
x AS (SELECT v.*, mean, target, nullif(purchases, 0)::DOUBLE AS n, purchase_value::DOUBLE / nullif(spend, 0) AS roas, spend::DOUBLE / nullif(purchases, 0) AS cpa FROM v, a)
SELECT entity_type, entity_id, CASE WHEN version = target THEN 'WRITTEN' ELSE 'SKIPPED_STALE' END AS outcome, coalesce(CASE WHEN roas IS NOT NULL THEN purchases END, purchases, 0)::BIGINT AS ads_n, coalesce(CASE WHEN spend > 0 THEN orders END, 0)::BIGINT AS store_n,
 {R6(f"CASE WHEN version = target THEN roas * {_LOW} / n END")} AS roas_low, {R6(f"CASE WHEN version = target THEN roas * {_HIGH} / n END")} AS roas_high, {R6(f"CASE WHEN version = target THEN cpa * n / {_HIGH} END")} AS cpa_low, {R6(f"CASE WHEN version = target THEN cpa * n / {_LOW} END")} AS cpa_high,
 {R6("CASE WHEN version = target THEN roas / nullif(mean, 0) END")} AS roas_to_account FROM x""")
def statistics_patch(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of metrics that rise and that fall with the count, sample sizes, and a second pass that needs the account's
    row first and writes only documents of the account's version."""
    version = F.when((F.col("entity_type") != "ACCOUNT") & (F.col("entity_id") % 5 == 4), 1).otherwise(2)
    docs = totals(spark, sf, windows=(28,)).withColumn("version", version)
    roas, cpa = E.ratio(F.col("purchase_value"), F.col("spend")), E.ratio(F.col("spend"), F.col("purchases"))
    account = docs.where("entity_type = 'ACCOUNT'").select(roas.alias("mean"), F.col("version").alias("target"))
    rows = docs.join(F.broadcast(account))  # one row
    fresh, n = F.col("version") == F.col("target"), F.when(F.col("purchases") > 0, F.col("purchases").cast("double"))
    sides = {"roas": spine.scaled_interval(roas, n, CANON.z, True), "cpa": spine.scaled_interval(cpa, n, CANON.z, False)}
    return rows.select(
        "entity_type", "entity_id", F.when(fresh, "WRITTEN").otherwise("SKIPPED_STALE").alias("outcome"), F.coalesce(F.when(roas.isNotNull(), F.col("purchases")), F.col("purchases"), D(0)).alias("ads_n"), F.coalesce(F.when(F.col("spend") > 0, F.col("orders")), D(0)).alias("store_n"),
        *[E.rounded(F.when(fresh, x), 6).alias(f"{k}_{side}") for k, both in sides.items() for side, x in zip(("low", "high"), both, strict=True)], E.rounded(F.when(fresh, E.ratio(roas, F.col("mean"))), 6).alias("roas_to_account"),
    )


@query(f"""WITH {ADS}, {STORE}, {DELIVERY}, m AS (SELECT campaign_id, sum(purchases)::BIGINT AS purchases FROM del JOIN ads USING (ad_id) GROUP BY 1), t AS (SELECT campaign_id, count(*) FILTER (resolution = 'AD_ID') AS by_id, count(*) FILTER (resolution = 'NAME_MATCH') AS by_name FROM res GROUP BY 1)
SELECT campaign_id, coalesce(by_id, 0)::BIGINT AS by_id, coalesce(by_name, 0)::BIGINT AS by_name, coalesce(purchases, 0)::BIGINT AS purchases, {_Q('by_id', 'purchases')} AS id_coverage, {_Q('(by_id + by_name)', 'purchases')} AS coverage FROM camps LEFT JOIN t USING (campaign_id) LEFT JOIN m USING (campaign_id)""")
def attribution_health(spark: SparkSession, sf: str) -> DataFrame:
    """Orders found by id and by name against the purchases that delivery claims, a campaign."""
    ads, camps = dims.ads(spark, sf), dims.campaigns(spark, sf)
    t = spine.resolved(dims.store_orders(spark, sf), ads, camps).groupBy("campaign_id").agg(F.count_if(F.col("resolution") == "AD_ID").alias("by_id"), F.count_if(F.col("resolution") == "NAME_MATCH").alias("by_name"))
    m = dims.delivery(spark, sf).join(ads, "ad_id").groupBy("campaign_id").agg(F.sum("purchases").alias("purchases"))
    rows = camps.join(t, "campaign_id", "left").join(m, "campaign_id", "left")
    z = lambda c: F.coalesce(c, D(0)).alias(c)
    return rows.select("campaign_id", z("by_id"), z("by_name"), z("purchases"), E.rounded(E.ratio(F.col("by_id"), F.col("purchases")), 6).alias("id_coverage"), E.rounded(E.ratio(F.col("by_id") + F.col("by_name"), F.col("purchases")), 6).alias("coverage"))


@query("""WITH a AS (SELECT c_custkey AS ad_id, url FROM customer LEFT JOIN pages ON page_id = c_custkey), k AS (SELECT ad_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'NO_URL' WHEN regexp_matches(url, '\\{\\{(ad|campaign)\\.id\\}\\}') THEN 'ID_MACRO' WHEN regexp_matches(url, '\\{\\{(ad|campaign)\\.name\\}\\}') THEN 'NAME_MACRO' WHEN regexp_matches(url, '[?&]ref=') THEN 'STATIC_TEXT' ELSE 'MISSING' END AS kind FROM a)
SELECT kind, count(*) AS ads, array_to_string(list_sort(list(ad_id::VARCHAR) FILTER (r <= 50)), ',') AS sample FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ad_id) AS r FROM k) GROUP BY 1""".replace("\\\\", "\\"))
def url_audit(spark: SparkSession, sf: str) -> DataFrame:
    """How many ads have an address of each kind, and the first fifty of each (the report's own limit)."""
    from pyspark.sql import Window as W

    k = dims.ads(spark, sf).join(dims.ad_urls(spark, sf), "ad_id", "left").select("ad_id", spine.url_kind(F.col("url")).alias("kind"))
    n = k.groupBy("kind").agg(F.count("*").alias("ads"))
    first = k.withColumn("_r", F.row_number().over(W.partitionBy("kind").orderBy("ad_id"))).where("_r <= 50").groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list(F.col("ad_id").cast("string"))), ",").alias("sample"))
    return n.join(first, "kind")
