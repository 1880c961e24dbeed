"""SQL of the analytics queries, for comparison in another engine."""

from __future__ import annotations

MINOR = "floor({} * 100 + 0.5)::BIGINT".format
R6 = "floor(({}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE".format

DAILY = f"""daily AS (SELECT user_id AS ad_id, ts::DATE AS day, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'signup') AS carts, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS malformed,
  coalesce(sum({MINOR('value')}) FILTER (event_type IN ('view', 'click')), 0)::BIGINT AS spend,
  coalesce(sum({MINOR('value')}) FILTER (event_type = 'purchase'), 0)::BIGINT AS purchase_value FROM events GROUP BY 1, 2)"""
_SUM = ", ".join(f"coalesce(sum({m}) FILTER (date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND days - 1), 0)::BIGINT AS {m}" for m in ("impressions", "clicks", "carts", "purchases", "spend", "purchase_value"))
TOTALS = f"""{DAILY}, wins AS (SELECT * FROM (VALUES (7, 12), (14, 20), (28, 30), (56, 45)) t(days, floor_n)),
lev AS (SELECT *, 'AD' AS entity_type, ad_id AS entity_id FROM daily UNION ALL SELECT *, 'ADSET', ad_id // 5 FROM daily UNION ALL SELECT *, 'CAMPAIGN', ad_id // 25 FROM daily
  UNION ALL SELECT *, 'CREATIVE_FAMILY', ad_id % 7 FROM daily UNION ALL SELECT *, 'ACCOUNT', 0 FROM daily),
totals AS (SELECT entity_type, entity_id::BIGINT AS entity_id, days, floor_n, {_SUM} FROM lev, wins GROUP BY 1, 2, 3, 4)"""
_ORDERS = f"o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, {MINOR('o_totalprice')} AS gross FROM orders)"


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


ORACLE_SQL = {
    "entity_statistics": f"""WITH {TOTALS}, s AS (SELECT *, {_div('purchase_value', 'spend')} AS roas, purchases::DOUBLE AS n, sqrt(purchases::DOUBLE + 0.375) AS q FROM totals),
i AS (SELECT *, CASE WHEN n > 0 THEN greatest(pow(greatest(0.0, q - 1.645 / 2), 2), 0.01) END AS lo, CASE WHEN n > 0 THEN pow(q + 1.645 / 2, 2) END AS hi FROM s),
j AS (SELECT i.*, roas * lo / nullif(n, 0) AS low, roas * hi / nullif(n, 0) AS high, m.mean, {_div('n', 'n + floor_n')} AS w FROM i JOIN (SELECT days, roas AS mean FROM s WHERE entity_type = 'ACCOUNT') m USING (days))
SELECT entity_type, entity_id, days || 'd' AS window_label, spend AS spend_minor, purchases, purchase_value AS purchase_value_minor, {R6('roas')} AS roas, {R6('low')} AS interval_low, {R6('high')} AS interval_high,
 {R6('w * roas + (1 - w) * mean')} AS roas_shrunk, CASE WHEN roas IS NULL THEN NULL WHEN purchases < floor_n OR n = 0 THEN 'NOT_DISTINGUISHABLE' WHEN low > 0.5 THEN 'ABOVE_TARGET' WHEN high < 0.5 THEN 'BELOW_TARGET' ELSE 'NOT_DISTINGUISHABLE' END AS verdict,
 CASE WHEN roas IS NOT NULL AND purchases < floor_n THEN 'BELOW_FLOOR' END AS verdict_reason FROM j""",
    "daily_facts": f"WITH {DAILY} SELECT * FROM daily",
    "window_metrics": f"""WITH {TOTALS} SELECT entity_type, entity_id, days::INT AS days, impressions, clicks, carts, purchases, spend, purchase_value, {R6(_div('spend * 1000.0', 'impressions'))} AS cpm, {R6(_div('clicks', 'impressions'))} AS ctr,
 {R6(_div('spend', 'clicks'))} AS cpc, {R6(_div('purchases', 'clicks'))} AS cvr, {R6(_div('purchase_value', 'spend'))} AS roas, {R6(_div('spend', 'purchases'))} AS cpa FROM totals""",
    "weekly_trend": f"""WITH {DAILY}, a AS (SELECT *, date_diff('day', day, DATE '2024-01-30') AS age FROM daily), t AS (SELECT ad_id, coalesce(sum(spend) FILTER (age BETWEEN 0 AND 6), 0)::BIGINT AS spend, coalesce(sum(spend) FILTER (age BETWEEN 7 AND 13), 0)::BIGINT AS spend_before,
 coalesce(sum(purchases) FILTER (age BETWEEN 0 AND 6), 0)::BIGINT AS purchases, coalesce(sum(purchases) FILTER (age BETWEEN 7 AND 13), 0)::BIGINT AS purchases_before FROM a GROUP BY 1),
c AS (SELECT *, {_div('(spend - spend_before) * 100.0', 'abs(spend_before)')} AS ch, {_div('(purchases - purchases_before) * 100.0', 'abs(purchases_before)')} AS pc FROM t)
SELECT ad_id, spend, spend_before, purchases, purchases_before, {R6('ch')} AS spend_change, CASE WHEN ch > 10 THEN 'UP' WHEN ch < -10 THEN 'DOWN' WHEN ch IS NOT NULL THEN 'STABLE' END AS spend_trend,
 CASE WHEN purchases_before = 0 THEN CASE WHEN purchases > 0 THEN 'UP' END WHEN pc > 10 THEN 'UP' WHEN pc < -10 THEN 'DOWN' ELSE 'STABLE' END AS purchase_trend FROM c""",
    "rolling_week": f"""WITH {DAILY}, d AS (SELECT ad_id // 25 AS campaign_id, day, sum(spend)::BIGINT AS spend, sum(purchases)::BIGINT AS purchases FROM daily GROUP BY 1, 2)
SELECT campaign_id, day, (sum(spend) OVER w)::BIGINT AS spend_7d, (sum(purchases) OVER w)::BIGINT AS purchases_7d FROM d WINDOW w AS (PARTITION BY campaign_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
    "window_gaps": f"""WITH {DAILY}, s AS (SELECT days, (DATE '2024-01-30' - i::INT)::DATE AS day FROM (VALUES (7), (14), (28), (56)) t(days), range(0, 56) r(i) WHERE i < days),
g AS (SELECT days, day FROM s WHERE day NOT IN (SELECT day FROM daily) OR day BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' OR day = DATE '2024-01-20')
SELECT d.days::INT AS days, count(g.day) AS gap_days, coalesce(string_agg(g.day::VARCHAR, ',' ORDER BY g.day), '') AS gap_list FROM (VALUES (7), (14), (28), (56)) d(days) LEFT JOIN g ON g.days = d.days GROUP BY 1""",
    "store_months": f"""WITH {_ORDERS}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) = 1 AS new FROM o),
s AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS orders, sum(gross) AS gross, count(*) FILTER (new) AS new_customers FROM n GROUP BY 1),
b AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum({MINOR('l_extendedprice')}) AS refunds FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT month, coalesce(orders, 0)::BIGINT AS orders, coalesce(gross, 0)::BIGINT AS gross, coalesce(refunds, 0)::BIGINT AS refunds, (coalesce(gross, 0) - coalesce(refunds, 0))::BIGINT AS net, coalesce(new_customers, 0)::BIGINT AS new_customers, {R6(_div('gross', 'orders'))} AS aov FROM s FULL JOIN b USING (month)""",
    "product_mix": f"SELECT coalesce(p_type, 'UNKNOWN') AS product_type, sum(trunc(l_quantity)::BIGINT)::BIGINT AS quantity, count(DISTINCT l_orderkey) AS orders, sum({MINOR('l_extendedprice')})::BIGINT AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "url_tags": r"""WITH p AS (SELECT page_id, url, '&' || regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages), v AS (SELECT *, CASE WHEN regexp_matches(q, '&ref=') THEN url_decode(regexp_extract(q, '&ref=([^&]*)', 1)) END AS ref, CASE WHEN regexp_matches(q, '&page=') THEN url_decode(regexp_extract(q, '&page=([^&]*)', 1)) END AS page FROM p)
SELECT page_id, ref, page, CASE WHEN ref IS NULL OR trim(ref) = '' THEN NULL WHEN lower(trim(ref)) IN ('meta', 'roi_meta', 'facebook', 'rm_meta') THEN 'meta' ELSE 'other' END AS source_class,
 CASE WHEN url IS NULL OR trim(url) = '' THEN 'NO_URL' WHEN regexp_matches(url, '\{\{(ad|campaign)\.id\}\}') THEN 'ID_MACRO' WHEN regexp_matches(url, '\{\{(ad|campaign)\.name\}\}') THEN 'NAME_MACRO' WHEN ref IS NOT NULL THEN 'STATIC_TEXT' ELSE 'MISSING' END AS kind FROM v""",
    "name_matches": r"""WITH n AS (SELECT p_partkey, lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) AS name FROM part), i AS (SELECT name, count(*) AS n, min(p_partkey) AS entity FROM n GROUP BY 1)
SELECT p_partkey AS asked, CASE WHEN i.n = 1 THEN entity END AS entity, CASE WHEN i.n = 1 THEN 'NAME_MATCH' ELSE 'UNRESOLVED' END AS resolution FROM n LEFT JOIN i USING (name)""",
    "season_labels": """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS f FROM orders), s AS (SELECT * FROM (VALUES ('DIWALI', DATE '1996-11-08', DATE '1996-11-14'), ('EOSS', DATE '1996-12-26', DATE '1997-01-15'), ('MONSOON', DATE '1997-07-01', DATE '1997-08-31')) t(label, a, b))
SELECT strftime(f, '%Y-%m') AS month, coalesce(string_agg(label, ',' ORDER BY label), '') AS labels, count(label) = 0 AS off_season FROM m LEFT JOIN s ON a <= last_day(f) AND b >= f GROUP BY f""",
    "demand_index": f"""WITH {_ORDERS}, r AS (SELECT day, sum(gross)::BIGINT AS revenue, date_trunc('quarter', day)::DATE AS quarter FROM o GROUP BY day), t AS (SELECT *, date_diff('day', quarter, day) < 7 AS season FROM r),
s AS (SELECT quarter, sum(revenue)::DOUBLE / count(*) AS sm, count(*) AS season_days FROM t WHERE season GROUP BY 1),
b AS (SELECT s.quarter, t.revenue, row_number() OVER (PARTITION BY s.quarter ORDER BY t.day DESC) AS k FROM s JOIN t ON NOT t.season AND t.day < s.quarter AND date_diff('day', t.day, s.quarter) <= 90),
m AS (SELECT quarter, sum(revenue)::DOUBLE / count(*) AS bm, count(*) AS base_days FROM b WHERE k <= 30 GROUP BY 1)
SELECT quarter, season_days, coalesce(base_days, 0)::BIGINT AS base_days, CASE WHEN base_days >= 7 AND bm <> 0 THEN {R6('sm / bm')} END AS demand FROM s LEFT JOIN m USING (quarter)""",
    "guarded_upsert": """WITH t AS (SELECT * FROM (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_id % 2 = 0) WHERE r = 1),
i AS (SELECT * FROM (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 2 = 1) WHERE r = 1)
SELECT coalesce(i2.user_id, t.user_id) AS user_id, CASE WHEN i2.user_id IS NULL THEN t.ts ELSE i2.ts END AS ts, CASE WHEN i2.user_id IS NULL THEN t.event_id ELSE i2.event_id END AS event_id, CASE WHEN i2.user_id IS NULL THEN t.value ELSE i2.value END AS value
FROM t FULL JOIN (SELECT i.* FROM i LEFT JOIN t USING (user_id) WHERE t.ts IS NULL OR i.ts >= t.ts) i2 ON i2.user_id = t.user_id""",
    "rejected_versions": """WITH t AS (SELECT user_id, min(ts) AS c FROM events WHERE event_id % 2 = 0 GROUP BY 1), i AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_id % 2 = 1)
SELECT user_id, count(*) AS rejected FROM i LEFT JOIN t USING (user_id) WHERE r > 1 OR ts < c GROUP BY 1""",
    "budget_changes": """WITH s AS (SELECT c_custkey, run::INT AS run, floor(c_acctbal * (1 + CASE WHEN c_custkey % 4 = run THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END))::BIGINT AS budget, CASE WHEN c_custkey % 7 = 0 AND run = 2 THEN 'PAUSED' ELSE 'ACTIVE' END AS status FROM customer, range(0, 4) r(run)),
l AS (SELECT *, lag(budget) OVER w AS b, lag(status) OVER w AS st FROM s WINDOW w AS (PARTITION BY c_custkey ORDER BY run)),
e AS (SELECT c_custkey, run, 'BUDGET' AS field, b::VARCHAR AS before, budget::VARCHAR AS after, floor((((budget - b) * 100.0)::DOUBLE / nullif(abs(b)::DOUBLE, 0)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS percent FROM l WHERE run > 0 UNION ALL SELECT c_custkey, run, 'STATUS', st, status, NULL FROM l WHERE run > 0)
SELECT *, coalesce(abs(percent) >= 20, false) AS material FROM e WHERE before IS DISTINCT FROM after""",
    "learning_phase": f"""WITH {DAILY}, r AS (SELECT ad_id, greatest(coalesce(max(day) FILTER (spend >= 30000), DATE '2000-01-01'), DATE '2024-01-24') AS start FROM daily GROUP BY 1),
c AS (SELECT ad_id, start, coalesce(sum(purchases) FILTER (day >= start AND day <= DATE '2024-01-30'), 0)::BIGINT AS conversions FROM daily JOIN r USING (ad_id) GROUP BY 1, 2)
SELECT ad_id, start, conversions, conversions < 50 AS learning, greatest(0, 50 - conversions)::BIGINT AS to_exit FROM c""",
    "decisions": f"""WITH {TOTALS}, a AS (SELECT *, CASE entity_id % 3 WHEN 0 THEN 'OWNS' WHEN 1 THEN 'DEFERS' ELSE 'UNKNOWN' END AS owner FROM totals WHERE days = 28 AND entity_type = 'ADSET'),
b AS (SELECT *, concat_ws(' | ', CASE WHEN owner <> 'OWNS' THEN 'NOT_BUDGET_OWNER' END, CASE WHEN spend <= 0 AND impressions <= 0 THEN 'NOT_DELIVERING' END, CASE WHEN purchases < floor_n THEN 'SAMPLE_TOO_SMALL' END) AS reasons FROM a),
c AS (SELECT *, CASE WHEN reasons = '' THEN greatest(0.5::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, (purchases - floor_n) / floor_n::DOUBLE))) ELSE 0.0::DOUBLE END AS conf FROM b),
d AS (SELECT *, CASE WHEN reasons = '' THEN floor(5 + conf * 10 + 0.5)::BIGINT END AS suggested FROM c)
SELECT entity_id, owner, reasons, {R6('conf')} AS confidence, {R6('conf * CASE WHEN carts > 60 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END')} AS adjusted_confidence, suggested, coalesce(suggested > 20, false) AS over_limit FROM d""",
    "calibration": f"""WITH p AS (SELECT (doc_id * 37 % 100) / 100.0::DOUBLE AS c, quality::DOUBLE AS a FROM labels), b AS (SELECT *, least(greatest(floor(c / 0.1::DOUBLE), 0), 9)::INT AS bucket FROM p),
g AS (SELECT bucket, count(*) AS n, avg(c) AS mc, avg(a) AS ma, avg((c - a) * (c - a)) AS q FROM b GROUP BY 1)
SELECT i::INT AS bucket, coalesce(n, 0)::BIGINT AS n, CASE WHEN n >= 10 THEN {R6('mc')} END AS mean_confidence, CASE WHEN n >= 10 THEN {R6('ma')} END AS mean_actual, CASE WHEN n >= 10 THEN {R6('q')} END AS brier FROM range(0, 10) r(i) LEFT JOIN g ON bucket = i""",
    "rejection_rate": f"SELECT (ts + INTERVAL 330 MINUTE)::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS rejected, {R6(_div('''count(*) FILTER (event_type = 'error')''', 'count(*)'))} AS rate FROM events GROUP BY 1",
    "outcome_day": f"""WITH {DAILY}, c AS (SELECT ad_id, day, sum(purchases) OVER w AS p, sum(spend) OVER w AS s FROM daily WHERE day > DATE '2024-01-07' WINDOW w AS (PARTITION BY ad_id ORDER BY day))
SELECT ad_id, min(day) FILTER (p >= 5 AND s >= 50000) AS met_on, max(p)::BIGINT AS purchases, max(s)::BIGINT AS spend FROM c GROUP BY 1""",
    "hash_families": """WITH RECURSIVE h AS (SELECT DISTINCT concat_ws('|', p_brand, p_type) AS asset, ('0x' || substr(md5(p_brand), 1, 10))::BIGINT AS x, ('0x' || substr(md5(p_type), 1, 6))::BIGINT AS y FROM part),
e AS MATERIALIZED (SELECT a.asset AS a, b.asset AS b FROM h a JOIN h b ON a.asset <> b.asset AND bit_count(xor(a.x, b.x)) + bit_count(xor(a.y, b.y)) <= 10), reach AS (SELECT asset AS a, asset AS b FROM h UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
f AS (SELECT a AS asset, min(b) AS family FROM reach GROUP BY 1) SELECT asset, family, count(*) OVER (PARTITION BY family) AS variations FROM f""",
    "money_texts": "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS inr, NULL::BIGINT AS jpy, (round(o_totalprice * 100) * 10)::BIGINT AS kwd, printf('%.2f', o_totalprice) AS text FROM orders",
    "calendar_days": "SELECT DISTINCT ts::DATE AS day, dayofweek(ts)::INT AS dow, dayname(ts) AS day_name, monthname(ts) AS month_name, dayofweek(ts) IN (0, 6) AS weekend FROM events",
    "archive_as_of": f"""WITH r AS (SELECT user_id, ts::DATE AS day, event_id, event_id % 50 AS run, {MINOR('value')} AS amount, (DATE '2024-01-01' + ((event_id % 50) % 40)::INT)::DATE AS finished FROM events WHERE (event_id % 50) % 7 <> 0)
SELECT user_id, day, run, amount FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY finished DESC, event_id DESC) AS k FROM r WHERE finished <= DATE '2024-01-20') WHERE k = 1""",
    "strategy_choice": f"""WITH {TOTALS}, t AS (SELECT *, {_div('purchase_value', 'spend')} AS roas FROM totals WHERE entity_type = 'ADSET' AND spend > 0),
k AS (SELECT days, entity_id, row_number() OVER (PARTITION BY days ORDER BY purchases DESC, entity_id) AS s, row_number() OVER (PARTITION BY days ORDER BY roas DESC, entity_id) AS n FROM t)
SELECT days::INT AS days, max(entity_id) FILTER (s = 1) AS system, max(entity_id) FILTER (n = 1) AS naive FROM k GROUP BY 1""",
    "attribution_coverage": f"""WITH {DAILY}, {_ORDERS}, n AS (SELECT count(*) FILTER (o_orderkey % 10 < 6) AS by_id, count(*) FILTER (o_orderkey % 10 IN (6, 7)) AS by_name, count(*) FILTER (o_orderkey % 10 > 7) AS unresolved, sum(gross) AS gross FROM o), d AS (SELECT sum(purchases)::BIGINT AS purchases, sum(spend) AS spend FROM daily)
SELECT by_id, by_name, unresolved, purchases, {R6(_div('by_id', 'purchases'))} AS id_coverage, {R6(_div('gross', 'spend'))} AS blended_mer FROM n, d""",
    "entity_search": "SELECT * FROM (SELECT 'CUSTOMER' AS kind, c_custkey::BIGINT AS id, c_name AS name FROM customer UNION ALL SELECT 'SUPPLIER', s_suppkey, s_name FROM supplier UNION ALL SELECT 'PART', p_partkey, p_name FROM part) WHERE contains(lower(name), '12')",
    "newest_orders": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25",
    "open_orders_with_refunds": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "orders_without_lines": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "stream_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
}
