"""Queries that answer tables of requests, each preceded by its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators import changes, decide, evidence, lookups, seasons, spine
from tallyforge.plans import timeline
from tallyforge.plans.entities import ADS, STORE, TOTALS, totals
from tallyforge.plans.sql import MINOR, R6
from tallyforge.runtime import documents as read
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


# Every supplier asks about one entity and window; every eleventh about one that is not there.
_REQ = """req AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 3 WHEN 0 THEN 'AD' WHEN 1 THEN 'ADSET' ELSE 'CAMPAIGN' END AS entity_type, CASE WHEN s_suppkey % 11 = 0 THEN 1000000000 ELSE s_nationkey + s_suppkey % 7 END::BIGINT AS entity_id, CASE s_suppkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 2 THEN 28 ELSE 56 END AS days FROM supplier)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    s, k = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "AD").when(k % 3 == 1, "ADSET").otherwise("CAMPAIGN")
    days = F.when(k % 4 == 0, 7).when(k % 4 == 1, 14).when(k % 4 == 2, 28).otherwise(56)
    return s.select(k.alias("request_id"), kind.alias("entity_type"), F.when(k % 11 == 0, 1_000_000_000).otherwise(F.col("s_nationkey") + k % 7).cast("long").alias("entity_id"), days.alias("days"))


def answered(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """``lookups.performance`` over the driver's tables."""
    ads, orders = dims.ads(spark, sf), dims.store_orders(spark, sf)
    since = F.date_sub(D(CANON.as_of), max(CANON.windows) - 1)
    delivery = lambda only: dims.delivery(spark, sf, since, D(CANON.as_of), only)
    matched = lambda some: spine.matches(spine.resolved(some, ads, dims.campaigns(spark, sf)), ads)
    return lookups.performance(table(asked, "requests"), ads, delivery, orders, dims.store_refunds(spark, sf), matched)


_N = lambda c: f"coalesce({c}, 0)::BIGINT AS {c}"
_MEASURES = (*spine.COUNTS, "reach", "orders", "gross", "refunds")


@query(f"""WITH {TOTALS}, {_REQ}, x AS (SELECT request_id, req.entity_type, req.entity_id, req.days, tot.entity_id IS NOT NULL AS found, {', '.join(_N(c) for c in _MEASURES)} FROM req LEFT JOIN tot ON tot.entity_type = req.entity_type AND tot.entity_id = req.entity_id AND tot.days = req.days)
SELECT *, spend > 0 OR impressions > 0 AS delivering, {R6('impressions::DOUBLE / nullif(reach, 0)')} AS frequency, {R6('purchase_value::DOUBLE / nullif(spend, 0)')} AS roas, {R6('spend::DOUBLE / nullif(purchases, 0)')} AS cpa, {R6('gross::DOUBLE / nullif(spend, 0)')} AS store_roas FROM x""")
def request_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery state, performance and store performance of every request's entity and window."""
    return answered(spark, sf, requests(spark, sf))


_FIELDS = ("BUDGET", "STATUS", "TARGETING", "BID_STRATEGY", "CREATIVE_ASSIGNMENT")


@query(f"""WITH {timeline._DIFF}, {_REQ}, e AS (SELECT entity_type, entity_id, {', '.join(f"count(*) FILTER (field = '{f}') AS {f.lower()}_changes, max(detected_on) FILTER (field = '{f}') AS last_{f.lower()}" for f in _FIELDS)}, arg_max({{'p': percent}}, run) FILTER (field = 'BUDGET') AS lb FROM q GROUP BY 1, 2)
SELECT request_id, req.entity_type, req.entity_id, {', '.join(f"coalesce({f.lower()}_changes, 0)::BIGINT AS {f.lower()}_changes, last_{f.lower()}" for f in _FIELDS)}, lb.p AS last_budget_percent FROM req LEFT JOIN e ON e.entity_type = req.entity_type AND e.entity_id = req.entity_id""")
def request_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What changed lately at every request's entity."""
    return lookups.recent_changes(requests(spark, sf), timeline.run_changes(spark, sf))


_RUN = 1997


@query(f"""WITH {timeline._UNITS}, {ADS}, {_REQ}, s AS (SELECT entity_id AS adset_id, owner, daily, lifetime FROM snap WHERE entity_type = 'ADSET' AND run = {_RUN}), c AS (SELECT entity_id AS campaign_id, owner, daily, lifetime FROM snap WHERE entity_type = 'CAMPAIGN' AND run = {_RUN}),
ch AS (SELECT DISTINCT adset_id, campaign_id FROM ads), k AS (SELECT campaign_id, count(*) AS n, min(adset_id) AS kid, min(daily) AS daily, min(lifetime) AS lifetime FROM s JOIN ch USING (adset_id) WHERE owner = 'ADSET' GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT req.*, CASE entity_type WHEN 'ADSET' THEN entity_id WHEN 'AD' THEN ads.adset_id END AS set_id FROM req LEFT JOIN ads ON entity_type = 'AD' AND ads.ad_id = entity_id), t AS (SELECT r.*, CASE WHEN entity_type = 'CAMPAIGN' THEN entity_id ELSE ch.campaign_id END AS camp_id FROM r LEFT JOIN ch ON ch.adset_id = r.set_id),
u AS (SELECT t.*, s.adset_id IS NOT NULL AS has_set, s.owner AS so, s.daily AS sd, s.lifetime AS sl, c.owner AS co, c.daily AS cd, c.lifetime AS cl, kid, k.daily AS kd, k.lifetime AS kl, c.campaign_id IS NOT NULL AS has_camp FROM t LEFT JOIN s ON s.adset_id = set_id LEFT JOIN c ON c.campaign_id = camp_id LEFT JOIN k ON k.campaign_id = camp_id),
v AS (SELECT *, CASE WHEN entity_type = 'CAMPAIGN' THEN CASE WHEN co = 'CAMPAIGN' THEN 'own' WHEN co IS NULL AND kid IS NOT NULL THEN 'kid' END ELSE CASE WHEN so = 'ADSET' THEN 'set' WHEN so IS NULL AND co = 'CAMPAIGN' AND set_id IS NOT NULL THEN 'own' END END AS w FROM u)
SELECT request_id, entity_type, entity_id, CASE w WHEN 'own' THEN 'CAMPAIGN' WHEN 'kid' THEN 'ADSET' WHEN 'set' THEN 'ADSET' END AS unit_type, CASE w WHEN 'own' THEN camp_id WHEN 'kid' THEN kid WHEN 'set' THEN set_id END AS unit_id, CASE w WHEN 'own' THEN cd WHEN 'kid' THEN kd WHEN 'set' THEN sd END AS daily, CASE w WHEN 'own' THEN cl WHEN 'kid' THEN kl WHEN 'set' THEN sl END AS lifetime,
 coalesce(CASE w WHEN 'own' THEN 'CAMPAIGN' WHEN 'kid' THEN 'ADSET' WHEN 'set' THEN 'ADSET' END <> entity_type, false) AS escalated FROM v""")
def request_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """The unit that owns the budget of every request's entity, and its budgets, at one run."""
    snaps = table(timeline._snapshots(spark, sf).where(F.col("run") == _RUN), "snapshots")
    return lookups.budget_owner(requests(spark, sf), snaps, dims.ads(spark, sf))


@query(f"""WITH {timeline._UNITS}, {ADS}, {_REQ}, z AS (SELECT entity_type, entity_id, status, owner FROM snap WHERE run = {_RUN}),
n AS (SELECT campaign_id, count(*) AS ads, count(*) FILTER (a.status = 'O') AS ads_active, count(DISTINCT adset_id) AS adsets, count(DISTINCT adset_id) FILTER (s.status = 'O') AS adsets_active FROM ads LEFT JOIN z a ON a.entity_type = 'AD' AND a.entity_id = ad_id LEFT JOIN z s ON s.entity_type = 'ADSET' AND s.entity_id = adset_id GROUP BY 1)
SELECT request_id, req.entity_id AS campaign_id, c.status, coalesce(c.owner = 'CAMPAIGN', false) AS owns_budget, {', '.join(_N(c) for c in ('adsets', 'adsets_active', 'ads', 'ads_active'))} FROM req LEFT JOIN z c ON c.entity_type = 'CAMPAIGN' AND c.entity_id = req.entity_id LEFT JOIN n ON n.campaign_id = req.entity_id WHERE req.entity_type = 'CAMPAIGN'""")
def request_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of every requested campaign and how many of its ad sets and ads are active."""
    snaps = table(timeline._snapshots(spark, sf).where(F.col("run") == _RUN), "snapshots")
    return lookups.campaign_context(requests(spark, sf), snaps, dims.ads(spark, sf), F.col("status") == "O")


@query(f"""WITH {ADS}, {STORE}, w AS (SELECT * FROM (VALUES (7), (14), (28), (56)) t(days)) SELECT days, p_type AS product_type, count(DISTINCT order_id) AS orders, sum(l_quantity)::BIGINT AS quantity, sum({MINOR('l_extendedprice')})::BIGINT AS revenue
FROM lineitem JOIN so ON order_id = l_orderkey JOIN part ON p_partkey = l_partkey JOIN w ON date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND days - 1 GROUP BY 1, 2""")
def request_product_mix(spark: SparkSession, sf: str) -> DataFrame:
    """What the store sold by product type in each of the windows asked for."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), dims.store_day("o_orderkey").alias("day"))
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey", F.col("l_quantity").alias("quantity"), E.minor(F.col("l_extendedprice")).alias("revenue"))
    lines = li.join(read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product_type")), "l_partkey")
    return lookups.product_mix(requests(spark, sf), o, lines)


_AS_OF = "DATE '2024-01-30'"
_BUDGETS = ORACLE_SQL["request_budgets"]
_OWN = _BUDGETS.removeprefix(f"WITH {timeline._UNITS}, {ADS}, ").replace("SELECT request_id, entity_type, entity_id, CASE w", ", own AS (SELECT request_id, entity_type, entity_id, CASE w", 1) + ")"
_LABELS = sorted({n for n, a, b, _ in seasons.CALENDAR if a <= "2024-01-30" and b >= "2024-01-03"})


def _pick(days: int, sql: str) -> str:
    return f"max({sql}) FILTER (days = {days})"


_WIN_SQL = {
    "roas": R6("purchase_value::DOUBLE / nullif(spend, 0)"),
    "low": R6("purchase_value::DOUBLE / nullif(spend, 0) * greatest(pow(greatest(0, sqrt(purchases + 0.375::DOUBLE) - 1.645::DOUBLE / 2), 2), 0.01) / nullif(purchases, 0)"),
    "high": R6("purchase_value::DOUBLE / nullif(spend, 0) * pow(sqrt(purchases + 0.375::DOUBLE) + 1.645::DOUBLE / 2, 2) / nullif(purchases, 0)"),
    "cpa": R6("spend::DOUBLE / nullif(purchases, 0)"), "ctr": R6("clicks::DOUBLE / nullif(impressions, 0)"), "cart_rate": R6("carts::DOUBLE / nullif(landings, 0)"), "frequency": R6("impressions::DOUBLE / nullif(reach, 0)"), "store_roas": R6("gross::DOUBLE / nullif(spend, 0)"),
}
_SHOWN = (7, 14, 28, 56)
_FLOOR = "CASE days WHEN 7 THEN 12 WHEN 14 THEN 20 WHEN 28 THEN 30 ELSE 45 END"
_VERDICT = f"CASE WHEN spend = 0 THEN NULL WHEN purchases < {_FLOOR} OR purchases = 0 THEN 'NOT_DISTINGUISHABLE' WHEN purchase_value::DOUBLE / spend * greatest(pow(greatest(0, sqrt(purchases + 0.375::DOUBLE) - 1.645::DOUBLE / 2), 2), 0.01) / purchases > 0.5 THEN 'ABOVE_TARGET' WHEN purchase_value::DOUBLE / spend * pow(sqrt(purchases + 0.375::DOUBLE) + 1.645::DOUBLE / 2, 2) / purchases < 0.5 THEN 'BELOW_TARGET' ELSE 'NOT_DISTINGUISHABLE' END"


def _ago(field: str, days: int) -> str:
    return f"count(*) FILTER (field = '{field}' AND det > {_AS_OF} - {days})"


_DOC = f"""WITH {timeline._DIFF}, {TOTALS}, {_OWN},
fw AS (SELECT entity_type, entity_id, {', '.join(f"{_pick(n, sql)} AS {name}_{n}" for n in _SHOWN for name, sql in _WIN_SQL.items())}, {', '.join(f"{_pick(n, _VERDICT)} AS verdict_{n}" for n in _SHOWN)}, {_pick(28, 'spend')} AS spend, {_pick(28, 'impressions')} AS impressions, {_pick(28, 'purchases')} AS purchases FROM tot WHERE entity_type IN ('ADSET', 'CAMPAIGN') GROUP BY 1, 2),
ev AS (SELECT *, ({_AS_OF} - 5 * (1998 - run)::INT)::DATE AS det, field = 'BUDGET' AND coalesce(abs(percent) >= 20, false) AS material FROM q),
cf AS (SELECT entity_type, entity_id, {_ago('BUDGET', 7)} AS budget_changes_7d, {_ago('TARGETING', 14)} AS targeting_changes_14d, {_ago('CREATIVE_ASSIGNMENT', 7)} AS creative_changes_7d, {', '.join(f"(24 * ({_AS_OF} + 1 - max(det) FILTER (field = '{f}')))::DOUBLE AS hours_since_{f.lower()}" for f in ('BUDGET', 'TARGETING', 'STATUS'))},
 arg_max({{'p': percent}}, det) FILTER (field = 'BUDGET') AS lb, max(det) FILTER (material) AS reset_day FROM ev WHERE det <= {_AS_OF} GROUP BY 1, 2),
cm AS (SELECT *, budget_changes_7d > 0 OR creative_changes_7d > 0 OR coalesce(hours_since_targeting < 336, false) OR coalesce(hours_since_status < 72, false) AS major FROM cf),
lf AS (SELECT adset_id, any_value(reset_day) AS reset_day, coalesce(sum(purchases) FILTER (del.day >= greatest(coalesce(reset_day, {_AS_OF} - 6), {_AS_OF} - 6)), 0)::BIGINT AS n FROM del JOIN ads USING (ad_id) LEFT JOIN cm ON cm.entity_type = 'ADSET' AND cm.entity_id = adset_id WHERE del.day BETWEEN {_AS_OF} - 6 AND {_AS_OF} GROUP BY 1),
dd AS (SELECT own.request_id, own.entity_type, own.entity_id, unit_type, unit_id, escalated, fw.* EXCLUDE (entity_type, entity_id), cm.* EXCLUDE (entity_type, entity_id, reset_day), lf.n, lf.adset_id IS NOT NULL AND unit_type = 'ADSET' AS taught, coalesce(major, false) AS maj, coalesce(spend > 0 OR impressions > 0, false) AS moving
 FROM own LEFT JOIN fw ON fw.entity_type = unit_type AND fw.entity_id = unit_id LEFT JOIN cm ON cm.entity_type = unit_type AND cm.entity_id = unit_id LEFT JOIN lf ON unit_type = 'ADSET' AND lf.adset_id = unit_id),
de AS (SELECT *, CASE WHEN unit_type IS NULL THEN 'NO_DECISION_UNIT' WHEN NOT moving THEN 'NOT_DELIVERING' ELSE 'EVIDENCE' END AS outcome, list_filter([CASE WHEN NOT moving THEN 'NOT_DELIVERING' END, CASE WHEN verdict_28 IS DISTINCT FROM 'ABOVE_TARGET' THEN 'ROAS_NOT_ABOVE_TARGET' END, CASE WHEN taught AND n < 50 THEN 'IN_LEARNING_PHASE' END, CASE WHEN maj THEN 'RECENT_MAJOR_CHANGE' END], lambda z: z IS NOT NULL) AS rs FROM dd),
df AS (SELECT *, CASE WHEN len(rs) = 0 THEN greatest(0.5::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, (purchases - 30) / 30.0::DOUBLE))) ELSE 0.0::DOUBLE END AS conf FROM de)
SELECT request_id, entity_type, entity_id, outcome"""
_SHOW = lambda sql, name: f"CASE WHEN outcome = 'EVIDENCE' THEN {sql} END AS {name}"
_COLUMNS = [
    ("unit_type", "unit_type"), ("unit_id", "unit_id"), ("CASE WHEN escalated THEN entity_type END", "escalated_type"), ("len(rs) = 0", "eligible"), ("array_to_string(rs, ',')", "reasons"), (R6("conf"), "confidence"), ("CASE WHEN len(rs) = 0 THEN floor(5 + conf * 10 + 0.5)::BIGINT END", "percent"),
    *[(f"{name}_{n}", f"{name}_{n}") for n in _SHOWN for name in (*_WIN_SQL, "verdict")], ("spend", "spend"), ("impressions", "impressions"), *[(c, c) for c in ("budget_changes_7d", "targeting_changes_14d", "creative_changes_7d", "hours_since_budget", "hours_since_targeting", "hours_since_status")],
    ("lb.p", "last_budget_percent"), ("major", "major"), ("CASE WHEN taught THEN n < 50 END", "in_learning"), ("CASE WHEN taught THEN greatest(0, 50 - n)::BIGINT END", "to_exit"), (f"'{','.join(_LABELS)}'", "season_labels"),
]


def known(spark: SparkSession, sf: str, windows: tuple[int, ...] = CANON.windows) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(owners of the requests' budgets, ``windows``, changes, learning) of ad sets and campaigns: budgets are owned by nothing else."""
    kinds = ("ADSET", "CAMPAIGN")
    snaps = table(timeline._snapshots(spark, sf, kinds), "snapshots")
    ads = dims.ads(spark, sf)
    owners = lookups.budget_owner(requests(spark, sf), snaps.where(F.col("run") == _RUN), ads)
    events = changes.events(snaps, timeline.run_log(snaps)).withColumn("detected_on", F.date_sub(D(CANON.as_of), (5 * (1998 - F.col("run"))).cast("int")))
    facts = evidence.window_facts(totals(spark, sf, kinds, windows))
    changed = table(evidence.change_facts(events), "changes")
    since = F.date_sub(D(CANON.as_of), CANON.learning_days - 1)
    bought = dims.delivery(spark, sf, since, D(CANON.as_of)).select("ad_id", "day", "purchases").join(ads, "ad_id").select(D("ADSET").alias("entity_type"), F.col("adset_id").alias("entity_id"), "day", "purchases")
    return owners, facts, changed, evidence.learning_facts(bought, changed)


@query(f"{_DOC}, {', '.join(_SHOW(a, b) for a, b in _COLUMNS)} FROM df")
def evidence_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence document of every request, unfolded: the unit that owns the budget, four windows, changes, learning, seasons and the decision they allow. Runs stand five days apart, the last on the as-of day."""
    owners, windows, changed, learned = known(spark, sf)
    season = F.struct(F.array(*map(D, _LABELS)).cast("array<string>").alias("labels"))
    d = evidence.documents(owners, windows, changed, learned, season)
    of = lambda path, name: F.col(f"document.{path}").alias(name)
    w = lambda n, field, name: F.element_at("document.windows", D(n))[field].alias(f"{name}_{n}")
    fields = {"roas": "roas", "low": "roas_low", "high": "roas_high", "cpa": "cpa", "ctr": "ctr", "cart_rate": "cart_rate", "frequency": "frequency", "store_roas": "store_roas", "verdict": "verdict"}
    return d.select(
        "request_id", "entity_type", "entity_id", "outcome", of("unit.type", "unit_type"), of("unit.id", "unit_id"), of("escalated_from.type", "escalated_type"), of("decision.eligible", "eligible"), F.array_join("document.decision.reasons", ",").alias("reasons"), E.rounded(F.col("document.decision.confidence"), 6).alias("confidence"), of("decision.percent", "percent"),
        *[w(n, f, name) for n in _SHOWN for name, f in fields.items()], of("stability.spend", "spend"), of("stability.impressions", "impressions"), *[of(f"changes.{c}", c) for c in ("budget_changes_7d", "targeting_changes_14d", "creative_changes_7d", "hours_since_budget", "hours_since_targeting", "hours_since_status", "last_budget_percent", "major")],
        of("learning.active", "in_learning"), of("learning.to_exit", "to_exit"), F.array_join("document.season.labels", ",").alias("season_labels"),
    )


@query(f"""WITH {ADS}, {STORE}, w AS (SELECT * FROM (VALUES (7), (14), (28), (56)) t(days)), j AS (SELECT days, resolution FROM w JOIN so ON date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND days - 1 LEFT JOIN res USING (order_id)),
n AS (SELECT days, count(*) FILTER (resolution = 'AD_ID') AS by_id, count(*) FILTER (resolution = 'NAME_MATCH') AS by_name, count(*) FILTER (resolution IS NULL) AS unresolved FROM j GROUP BY 1) SELECT *, {R6('by_id::DOUBLE / (by_id + by_name + unresolved)')} AS coverage FROM n""")
def request_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """How the store's orders were attributed in each of the windows asked for."""
    o = dims.store_orders(spark, sf)
    return lookups.attribution_health(requests(spark, sf), o, spine.resolved(o, dims.ads(spark, sf), dims.campaigns(spark, sf)))


@query(f"""WITH {ADS}, {_REQ}, n AS (SELECT family_id, count(*) AS variations FROM ads GROUP BY 1) SELECT request_id, entity_id AS ad_id, family_id IS NOT NULL AS applicable, family_id, CASE WHEN family_id % 3 = 0 THEN 'COMPOSITE' WHEN family_id IS NOT NULL THEN 'STANDARD' END AS creative_type, coalesce(family_id % 3 <> 0, false) AS eligible, variations
FROM req LEFT JOIN ads ON ad_id = entity_id LEFT JOIN n USING (family_id) WHERE entity_type = 'AD'""")
def request_fatigue(spark: SparkSession, sf: str) -> DataFrame:
    """The creative family of every requested ad and whether fatigue may be judged."""
    return lookups.creative_fatigue(requests(spark, sf), dims.ads(spark, sf), F.col("family_id") % 3 == 0)


_FINE = "CASE WHEN {0} THEN '{1}' END"
_CODES = ", ".join(_FINE.format(*x) for x in (("unit_type IS NULL", "NO_DECISION_UNIT"), ("unit_type IS NOT NULL AND escalated", "DECISION_UNIT_NOT_BUDGET_OWNER"), ("unit_type IS NOT NULL AND NOT moving", "NOT_DELIVERING"), ("coalesce(purchases, 0) < 30", "MIN_PURCHASES_NOT_MET"), ("coalesce(spend, 0) < 1000000", "MIN_SPEND_NOT_MET"), ("abs(asked) > 20", "MAX_CHANGE_PERCENT_EXCEEDED")))


@query(_DOC.removesuffix("SELECT request_id, entity_type, entity_id, outcome") + f""", dg AS (SELECT df.*, floor(s_acctbal / 400)::DOUBLE AS asked FROM df JOIN supplier ON s_suppkey = request_id), dh AS (SELECT *, list_filter([{_CODES}], lambda z: z IS NOT NULL) AS codes FROM dg)
SELECT request_id, entity_type, entity_id, outcome AS state, asked AS percent, CASE WHEN len(codes) > 0 THEN array_to_string(codes, ' | ') END AS rejection_reason, CASE WHEN len(codes) > 0 THEN 'INSUFFICIENT_DATA' ELSE 'INCREASE_BUDGET' END AS final_kind, {R6("greatest(0, least(1, conf * CASE WHEN maj THEN 0.6::DOUBLE ELSE 1 END))")} AS adjusted FROM dh""")
def request_guardrails(spark: SparkSession, sf: str) -> DataFrame:
    """Every request's proposal to change its entity's budget, checked against who owns the budget, what was delivered and what changed lately."""
    owners, windows, changed, learned = known(spark, sf, (28,))
    ask = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), F.floor(F.col("s_acctbal") / 400).cast("double").alias("percent"))
    p = evidence.proposals(owners.join(ask, "request_id"), windows, changed, learned)
    v = decide.judged(p, decide.violations(p, D(CANON.floors[CANON.windows.index(28)]), D(decide.MIN_SPEND[28])))
    adjusted = decide.adjusted_confidence(F.col("confidence"), F.col("major"), D(False))
    return v.select("request_id", "entity_type", "entity_id", decide.evidence_state(F.col("owner"), F.col("spend"), F.col("impressions")).alias("state"), "percent", "rejection_reason", "final_kind", E.rounded(adjusted, 6).alias("adjusted"))
