"""Queries of orders and reports with all columns, evidence and lookups, each preceded by its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators import spine
from tallyforge.plans import entities
from tallyforge.plans.entities import ADS, DELIVERY, STORE, TOTALS
from tallyforge.plans.requests import answered
from tallyforge.plans.sql import DAILY, MINOR, R6
from tallyforge.runtime import documents as read
from tallyforge.runtime import new_path
from tallyforge.sources import dims, facts, orders

D = F.lit
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


@query(f"""WITH b AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS lines, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS refunds, coalesce(sum({MINOR('l_extendedprice')}) FILTER (l_returnflag = 'R'), 0)::BIGINT AS refunded FROM lineitem GROUP BY 1),
o AS (SELECT *, {MINOR('o_totalprice')} AS t FROM orders WHERE o_orderkey % 50 <> 7)
SELECT o_orderkey AS order_id, 'two' || chr(10) || 'lines #' || o_orderkey AS name, (o_orderdate - INTERVAL 330 MINUTE)::TIMESTAMP AS created_at, t AS total, t - 100 AS subtotal, 100::BIGINT AS discount, CASE WHEN o_orderkey % 3 > 0 THEN 4900 END::BIGINT AS shipping, 'INR' AS currency,
 lower(o_orderpriority) AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'AE' WHEN o_orderkey % 4 = 1 THEN 'IN' END AS country, o_custkey AS customer_id, coalesce(lines, 0)::BIGINT AS lines, coalesce(refunds, 0)::BIGINT AS refunds, coalesce(refunded, 0)::BIGINT AS refunded FROM o LEFT JOIN b ON l_orderkey = o_orderkey""")
def export_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A full export written as CSV and read back: prices, countries, line breaks in names, orders without a price rejected."""
    money = lambda c: E.format_money(E.minor(F.col(c)), D("INR"))
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    k, t = F.col("o_orderkey"), E.minor(F.col("o_totalprice"))
    text = lambda c: E.format_money(c, D("INR"))
    values = {
        "ID": k.cast("string"), "Name": F.concat(D("two\nlines #"), k), "Created At": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss +0530"), "Currency": F.when(k % 2 == 0, "INR"), "Price: Total": F.when(k % 50 != 7, money("o_totalprice")),
        "Price: Subtotal": text(t - 100), "Price: Total Discount": D("1.00"), "Price: Total Shipping": F.when(k % 3 > 0, "49.00"), "Payment: Status": F.upper("o_orderpriority"), "Shipping: Country Code": F.when(k % 4 == 0, "AE"), "Billing: Country Code": F.when(k % 4 <= 1, "IN"), "Customer: ID": F.col("o_custkey").cast("string"),
    }
    none = D(None).cast("string")
    head = o.select(D(0).cast("long").alias("Row"), *[values.get(c, none).alias(c) for c in orders.EXPORT])
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    back = F.col("l_returnflag") == "R"
    values = {
        "ID": F.col("l_orderkey").cast("string"), "Name": D("later"), "Line: Type": F.when(back, "Refund Line").otherwise("Line Item"), "Line: Product ID": F.col("l_partkey").cast("string"), "Line: Quantity": F.col("l_quantity").cast("long").cast("string"),
        "Line: Total": F.concat(F.when(back, "-").otherwise(""), money("l_extendedprice")), "Refund: ID": F.when(back, F.concat_ws("-", D("R"), "l_linenumber")),
    }
    tail = li.select((F.col("l_linenumber") + 1).cast("long").alias("Row"), *[values.get(c, none).alias(c) for c in orders.EXPORT])
    path = new_path(spark, "export")
    head.unionByName(tail).write.option("header", True).option("escape", '"').csv(path)
    own, lines, refunds, _ = orders.export_orders(orders.export(spark, path))
    n = lines.groupBy("order_id").agg(F.count("*").alias("lines"))
    r = refunds.groupBy("order_id").agg(F.count("*").alias("refunds"), F.sum("amount").alias("refunded"))
    z = lambda c: F.coalesce(c, D(0)).cast("long").alias(c)
    out = own.join(n, "order_id", "left").join(r, "order_id", "left")
    return out.select("order_id", "name", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "total", "subtotal", "discount", "shipping", "currency", "status", "country", "customer_id", z("lines"), z("refunds"), z("refunded"))


@query(f"""WITH b AS (SELECT l_orderkey, sum(trunc(l_quantity)::BIGINT)::BIGINT AS units, count(*) FILTER (l_returnflag = 'R') AS refunds, coalesce(sum({MINOR('l_extendedprice')} * CASE WHEN l_orderkey % 3 = 2 THEN 10 ELSE 1 END) FILTER (l_returnflag = 'R'), 0)::BIGINT AS refunded FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CASE o_orderkey % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' ELSE 'KWD' END AS currency, {MINOR('o_totalprice')} * CASE WHEN o_orderkey % 3 = 2 THEN 10 ELSE 1 END AS total, CASE WHEN o_orderkey % 4 = 0 THEN 'AE' WHEN o_orderkey % 4 = 1 THEN 'IN' END AS country,
 coalesce(units, 0)::BIGINT AS units, coalesce(refunds, 0)::BIGINT AS refunds, coalesce(refunded, 0)::BIGINT AS refunded FROM orders LEFT JOIN b ON l_orderkey = o_orderkey""")
def document_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Store documents of every order: currency and country from where they are found first."""
    price = lambda c: E.format_money(E.minor(F.col(c)), D("INR"))
    item = F.struct(F.concat(D("gid://store/Product/"), F.col("l_partkey")).alias("product"), F.col("l_quantity").cast("long").alias("quantity"), price("l_extendedprice").alias("total"))
    back = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.concat(D("-"), price("l_extendedprice")).alias("amount"))
    li = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("lineItems"), F.collect_list(F.when(F.col("l_returnflag") == "R", back)).alias("refunds"))
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").join(li, k == F.col("l_orderkey"), "left")
    body = F.struct(
        F.concat(D("gid://store/Order/"), k).alias("id"), F.when(k % 3 == 1, "USD").alias("currencyCode"), F.when(k % 3 == 1, "EUR").when(k % 3 == 2, "KWD").alias("presentmentCurrency"), price("o_totalprice").alias("totalPrice"), F.struct(F.concat(D("gid://store/Customer/"), F.col("o_custkey")).alias("id")).alias("customer"),
        F.struct(F.when(k % 4 == 0, "AE").alias("countryCode")).alias("shippingAddress"), F.struct(F.when(k % 4 <= 1, "IN").alias("countryCode")).alias("billingAddress"), "lineItems", "refunds",
    )
    docs = o.select(F.to_json(body).alias("body")).unionByName(spark.range(1).select(D("not json").alias("body")))
    return orders.document_orders(docs)


@query(f"""WITH {DAILY} SELECT ad_id, ad_id // 5 AS adset_id, ad_id // 25 AS campaign_id, day AS native_day, (day + 1)::DATE AS day, spend, impressions, CASE WHEN impressions > 0 THEN impressions END AS reach, 1.5::DOUBLE AS frequency, clicks, 9::BIGINT AS landings, carts, 0::BIGINT AS checkouts, purchases, purchase_value FROM daily""")
def insight_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Report documents of all delivery and some without an id or day, parsed and moved to the reporting day."""
    d, ad = facts.daily(spark, sf), F.col("ad_id")
    text = lambda c: F.col(c).cast("string")
    pair = lambda k, v: F.struct(D(k).alias("action_type"), v.alias("value"))
    row = F.struct(
        ad.cast("string").alias("ad_id"), F.floor(ad / 5).cast("string").alias("adset_id"), F.floor(ad / 25).cast("string").alias("campaign_id"), text("day").alias("date_start"), E.format_money(F.col("spend"), D("INR")).alias("spend"), F.concat(text("impressions"), D(".9")).alias("impressions"),
        F.when(F.col("impressions") > 0, text("impressions")).alias("reach"), D("1.5x").alias("frequency"), text("clicks").alias("clicks"), F.array(pair("landing_page_view", D("9")), pair("add_to_cart", text("carts")), pair("initiate_checkout", D("-4")), pair("purchase", text("purchases")), pair("purchase", D("77"))).alias("actions"),
        F.array(pair("purchase", E.format_money(F.col("purchase_value"), D("INR")))).alias("action_values"),
    )
    bad = spark.range(2).select(F.when(F.col("id") == 0, '{"ad_id":"1","adset_id":"","campaign_id":"1","date_start":"2024-01-01"}').otherwise('{"ad_id":"1","adset_id":"1","campaign_id":"1","date_start":"soon"}').alias("body"))
    rows, _ = orders.insights(d.select(F.to_json(row).alias("body")).unionByName(bad), "Pacific/Honolulu", CANON.timezone, CANON.currency)
    return rows


@query("""WITH w AS (SELECT o_custkey AS account, min(o_orderdate::DATE) AS a, least(min(o_orderdate::DATE) + 100, max(o_orderdate::DATE))::DATE AS b FROM orders GROUP BY 1), d AS (SELECT account, a, b, unnest(range(a, (b + 1)::DATE, INTERVAL 1 DAY))::DATE AS day FROM w)
SELECT account, a AS first, b AS last, count(*)::INT AS days, count(*) FILTER (dayofweek(day) IN (0, 6))::INT AS weekend_days, floor(count(*) FILTER (dayofweek(day) IN (0, 6))::DOUBLE / count(*) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS weekend_share, array_to_string(list_sort(list(DISTINCT strftime(day, '%Y-%m'))), ',') AS months FROM d GROUP BY 1, 2, 3""")
def window_days(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar features of each account's first hundred days."""
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("_last"))
    return orders.window_calendar(o.select("account", "first", F.least(F.date_add("first", 100), F.col("_last")).alias("last")), "first", "last")


@query(f"""WITH {ADS}, {STORE}, b AS (SELECT min(day) AS a FROM so), s AS (SELECT (a + i::INT)::DATE AS day FROM b, range(0, 400) r(i) WHERE a + i::INT <= DATE '2024-01-30'),
o AS (SELECT day, count(*) AS orders, sum(gross)::BIGINT AS gross FROM so GROUP BY 1), r AS (SELECT day, count(*) AS refunds, sum(refund)::BIGINT AS refunded FROM sr GROUP BY 1),
c AS (SELECT day, coalesce(orders, 0)::BIGINT AS orders, coalesce(refunds, 0)::BIGINT AS refunds, coalesce(gross, 0)::BIGINT AS gross, coalesce(refunded, 0)::BIGINT AS refunded, day >= DATE '2024-01-05' AND day < DATE '2024-01-08' AS gap FROM s LEFT JOIN o USING (day) LEFT JOIN r USING (day))
SELECT days::INT AS days, sum(orders)::BIGINT AS orders, sum(refunds)::BIGINT AS refunds, sum(gross)::BIGINT AS gross, sum(refunded)::BIGINT AS refunded, sum(gross - refunded)::BIGINT AS net, (max(days) - count(*) + count(*) FILTER (gap))::BIGINT AS gap_days, max(days) - count(*) + count(*) FILTER (gap) > 0 AS has_gap
FROM c, (VALUES (7), (14), (28), (56)) t(days) WHERE date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND days - 1 GROUP BY 1""")
def store_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Store totals of each window from a covered calendar of orders and refunds by day, with the days that are missing or flagged."""
    o = dims.store_orders(spark, sf).groupBy("day").agg(F.count("*").alias("orders"), F.sum("gross").alias("gross"))
    r = dims.store_refunds(spark, sf).groupBy("day").agg(F.count("*").alias("refunds"), F.sum("refund").alias("refunded"))
    days = o.agg(F.explode(F.sequence(F.min("day"), D(CANON.as_of), F.expr("interval 1 day"))).alias("day"))
    gap = (F.col("day") >= D(date(2024, 1, 5))) & (F.col("day") < D(date(2024, 1, 8)))
    c = days.join(o, "day", "left").join(r, "day", "left").select("day", *[F.coalesce(x, D(0)).alias(x) for x in ("orders", "refunds", "gross", "refunded")], gap.alias("gap"))
    w = c.withColumn("days", F.explode(spine.windows_of("day"))).groupBy("days").agg(*[F.sum(x).cast("long").alias(x) for x in ("orders", "refunds", "gross", "refunded")], F.count("*").alias("_seen"), F.count_if("gap").alias("_flagged"))
    lost = F.col("days") - F.col("_seen") + F.col("_flagged")
    return w.select("days", "orders", "refunds", "gross", "refunded", (F.col("gross") - F.col("refunded")).alias("net"), lost.alias("gap_days"), (lost > 0).alias("has_gap"))


_DIV = lambda a, b: f"{a}::DOUBLE / nullif({b}, 0)"


@query(f"""WITH {TOTALS}, p AS (SELECT * FROM tot WHERE days = 28 AND entity_type IN ('ADSET', 'CAMPAIGN')), q AS (SELECT * FROM tot WHERE days = 7),
l AS (SELECT e.t AS entity_type, e.i AS entity_id, max(day) AS last_day, count(DISTINCT day) AS active_days FROM (SELECT day, unnest([{{'t': 'ADSET', 'i': adset_id}}, {{'t': 'CAMPAIGN', 'i': campaign_id}}]) AS e FROM del JOIN ads USING (ad_id)) GROUP BY 1, 2)
SELECT p.entity_type, p.entity_id, CASE WHEN p.spend <= 0 AND p.impressions <= 0 THEN 'NOT_DELIVERING' ELSE 'EVIDENCE' END AS state, p.spend AS spend_28d, q.spend AS spend_7d, {R6(_DIV('p.purchase_value', 'p.spend'))} AS roas_28d, {R6(_DIV('q.purchase_value', 'q.spend'))} AS roas_7d, {R6(_DIV('p.clicks', 'p.impressions'))} AS click_rate,
 {R6(_DIV('p.carts', 'p.landings'))} AS cart_rate, {R6(_DIV('p.purchases', 'p.checkouts'))} AS purchase_rate, p.purchases < 30 AS below_floor, p.purchases < 50 AS learning, {R6(_DIV('p.impressions', 'p.reach'))} AS frequency, coalesce({_DIV('p.impressions', 'p.reach')} > 1.5, false) AS tired, last_day, coalesce(active_days, 0)::BIGINT AS active_days,
 'spend ' || p.spend || ', purchases ' || p.purchases || CASE WHEN p.purchases < 30 THEN ' (below the floor of 30)' ELSE '' END AS told FROM p JOIN q USING (entity_type, entity_id) LEFT JOIN l USING (entity_type, entity_id)""")
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of every ad set and campaign before a decision: both windows, funnel, learning, fatigue, last activity and a line of text."""
    t, key = entities.totals(spark, sf, ("ADSET", "CAMPAIGN"), (7, 28)), ["entity_type", "entity_id"]
    p, q = t.where("days = 28"), t.where("days = 7").select(*key, F.col("spend").alias("spend_7d"), F.col("purchase_value").alias("_value"))
    act = dims.delivery(spark, sf).select("ad_id", "day").join(dims.ads(spark, sf), "ad_id").select("day", F.inline(dims.levels())).groupBy(*key).agg(F.max("day").alias("last_day"), F.count_distinct("day").alias("active_days"))
    r = lambda a, b: E.rounded(E.ratio(F.col(a), F.col(b)), 6)
    floor, n = CANON.floors[2], F.col("purchases")
    text = F.concat(D("spend "), F.col("spend"), D(", purchases "), n, F.when(n < floor, f" (below the floor of {floor})").otherwise(""))
    state = F.when((F.col("spend") <= 0) & (F.col("impressions") <= 0), "NOT_DELIVERING").otherwise("EVIDENCE")
    return p.join(q, key).join(act, key, "left").select(
        *key, state.alias("state"), F.col("spend").alias("spend_28d"), "spend_7d", r("purchase_value", "spend").alias("roas_28d"), r("_value", "spend_7d").alias("roas_7d"), r("clicks", "impressions").alias("click_rate"), r("carts", "landings").alias("cart_rate"), r("purchases", "checkouts").alias("purchase_rate"),
        (n < floor).alias("below_floor"), (n < CANON.learning_conversions).alias("learning"), r("impressions", "reach").alias("frequency"), F.coalesce(E.ratio(F.col("impressions"), F.col("reach")) > 1.5, D(False)).alias("tired"), "last_day", F.coalesce("active_days", D(0)).alias("active_days"), text.alias("told"),
    )


def performance(spark: SparkSession, sf: str, entity_type: str, entity_id: int, days: int) -> DataFrame:
    """Delivery and store numbers of one entity and window: a table of one request."""
    asked = spark.createDataFrame([(0, entity_type, entity_id, days)], "request_id long, entity_type string, entity_id long, days int")
    return answered(spark, sf, asked)


def delivery_state(spark: SparkSession, sf: str, entity_type: str, entity_id: int, days: int = 28) -> DataFrame:
    """Whether one entity delivers in a window."""
    return performance(spark, sf, entity_type, entity_id, days).select("entity_type", "entity_id", "days", "delivering", "spend", "impressions", "reach", "frequency")


def creative_details(spark: SparkSession, sf: str, family_id: int) -> DataFrame:
    """The ads of one creative family, with their delivery: ad to family by its dimension."""
    ads = dims.ads(spark, sf).where(F.col("family_id") == family_id)
    d = dims.delivery(spark, sf).groupBy("ad_id").agg(F.sum("spend").alias("spend"), F.sum("purchases").alias("purchases"))
    return ads.join(d, "ad_id", "left").select("family_id", "ad_id", "name", F.coalesce("spend", D(0)).alias("spend"), F.coalesce("purchases", D(0)).alias("purchases"))


@query(f"WITH {ADS}, {DELIVERY}, d AS (SELECT ad_id, sum(spend)::BIGINT AS spend, sum(purchases)::BIGINT AS purchases FROM del GROUP BY 1) SELECT family_id, ad_id, name, coalesce(spend, 0)::BIGINT AS spend, coalesce(purchases, 0)::BIGINT AS purchases FROM ads LEFT JOIN d USING (ad_id) WHERE family_id = 7")
def lookup_creative(spark: SparkSession, sf: str) -> DataFrame:
    return creative_details(spark, sf, 7)


@query(f"WITH {TOTALS} SELECT entity_type, entity_id, days::INT AS days, spend, purchases, orders AS store_orders, gross AS store_gross FROM tot WHERE entity_type = 'CAMPAIGN' AND entity_id = 2 AND days = 28")
def lookup_performance(spark: SparkSession, sf: str) -> DataFrame:
    return performance(spark, sf, "CAMPAIGN", 2, 28).select("entity_type", "entity_id", "days", "spend", "purchases", F.col("orders").alias("store_orders"), F.col("gross").alias("store_gross"))


@query(f"WITH {ADS}, {DELIVERY} SELECT 'ADSET' AS entity_type, adset_id AS entity_id, day, sum(purchases)::BIGINT AS purchases FROM del JOIN ads USING (ad_id) GROUP BY 2, 3 UNION ALL SELECT 'AD', ad_id, day, sum(purchases)::BIGINT FROM del JOIN ads USING (ad_id) GROUP BY 2, 3")
def purchases_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases of ads and ad sets a day."""
    d = dims.delivery(spark, sf).select("ad_id", "day", "purchases").join(dims.ads(spark, sf), "ad_id")
    return d.select("day", "purchases", F.inline(F.slice(dims.levels(), 1, 2))).groupBy("entity_type", "entity_id", "day").agg(F.sum("purchases").alias("purchases"))
