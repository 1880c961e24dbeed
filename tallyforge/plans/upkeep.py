"""Queries of decisions, bookkeeping, seasons and small rules, each preceded by its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators import changes, decide, ledger, lookups, seasons
from tallyforge.plans import entities
from tallyforge.plans.entities import ADS, DELIVERY, TOTALS
from tallyforge.plans.sql import MINOR, R6
from tallyforge.runtime import documents as read
from tallyforge.runtime import new_path, sized
from tallyforge.sources import dims, facts

D = F.lit
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


# Proposals of every ad set for 28 days: owner from the campaign's number, percent and kind from the ad set's.
_JUDGED = f"""{TOTALS}, fam AS (SELECT adset_id, bool_or(family_id % 3 = 0) AS composite FROM ads GROUP BY 1), late AS (SELECT adset_id, count(*) > 0 AS recent FROM events JOIN ads ON ad_id = user_id WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY 1),
pr AS (SELECT entity_id, spend, impressions, purchases, CASE entity_id % 4 WHEN 0 THEN 'ADSET' WHEN 1 THEN 'CAMPAIGN' WHEN 2 THEN 'ADSET' ELSE CASE WHEN entity_id % 3 = 0 THEN 'UNKNOWN' ELSE 'ADSET' END END AS owner, CASE WHEN entity_id % 6 = 5 THEN 'INSUFFICIENT_DATA' WHEN entity_id % 2 = 0 THEN 'INCREASE_BUDGET' ELSE 'DECREASE_BUDGET' END AS kind,
 ((entity_id % 9) * 5 - 15)::DOUBLE AS percent, 0.5::DOUBLE + (entity_id % 5) * 0.1::DOUBLE AS confidence, coalesce(recent, false) AS recent, coalesce(composite, false) AND impressions > 20 AS tired FROM tot LEFT JOIN fam ON adset_id = entity_id LEFT JOIN late ON late.adset_id = entity_id WHERE entity_type = 'ADSET' AND days = 28),
vi AS (SELECT *, CASE WHEN owner = 'UNKNOWN' THEN 'NO_DECISION_UNIT' WHEN spend <= 0 AND impressions <= 0 THEN 'NOT_DELIVERING' ELSE 'EVIDENCE' END AS state, CASE WHEN kind = 'INSUFFICIENT_DATA' THEN [] ELSE list_filter([CASE WHEN owner = 'UNKNOWN' THEN 'NO_DECISION_UNIT' END, CASE WHEN owner = 'CAMPAIGN' THEN 'DECISION_UNIT_NOT_BUDGET_OWNER' END,
 CASE WHEN owner <> 'UNKNOWN' AND spend <= 0 AND impressions <= 0 THEN 'NOT_DELIVERING' END, CASE WHEN purchases < 30 THEN 'MIN_PURCHASES_NOT_MET' END, CASE WHEN spend < 1000000 THEN 'MIN_SPEND_NOT_MET' END, CASE WHEN abs(percent) > 20 THEN 'MAX_CHANGE_PERCENT_EXCEEDED' END], lambda x: x IS NOT NULL) END AS codes FROM pr)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    ads = dims.ads(spark, sf)
    t = entities.totals(spark, sf, ("ADSET",), (28,)).select("entity_id", "spend", "impressions", "purchases")
    composite = ads.groupBy(F.col("adset_id").alias("entity_id")).agg(F.bool_or(F.col("family_id") % 3 == 0).alias("composite"))
    late = read(spark, sf, "events").where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-28 00:00:00'").select(F.col("user_id").alias("ad_id"))
    late = late.join(ads, "ad_id").select(F.col("adset_id").alias("entity_id")).distinct().withColumn("recent", D(True))
    i = F.col("entity_id")
    owner = F.when(i % 4 == 1, "CAMPAIGN").when((i % 4 == 3) & (i % 3 == 0), "UNKNOWN").otherwise("ADSET")
    kind = F.when(i % 6 == 5, "INSUFFICIENT_DATA").when(i % 2 == 0, "INCREASE_BUDGET").otherwise("DECREASE_BUDGET")
    p = t.join(composite, "entity_id", "left").join(late, "entity_id", "left").select(
        "*", owner.alias("owner"), (owner == "ADSET").alias("unit_owns"), kind.alias("kind"), ((i % 9) * 5 - 15).cast("double").alias("percent"), (0.5 + (i % 5) * 0.1).alias("confidence"),
    )
    days = 28
    return decide.judged(p, decide.violations(p, D(CANON.floors[CANON.windows.index(days)]), D(decide.MIN_SPEND[days])))


@query(f"""WITH {_JUDGED} SELECT entity_id, state, kind, percent, CASE WHEN len(codes) > 0 THEN array_to_string(codes, ' | ') END AS rejection_reason, CASE WHEN len(codes) > 0 THEN 'INSUFFICIENT_DATA' ELSE kind END AS final_kind,
 {R6("greatest(0, least(1, confidence * CASE WHEN recent THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN tired THEN 0.75::DOUBLE ELSE 1 END))")} AS adjusted FROM vi""")
def guardrails(spark: SparkSession, sf: str) -> DataFrame:
    """Every ad set's proposal checked by all guardrails, with its evidence state and adjusted confidence."""
    v = _judged(spark, sf)
    tired = F.coalesce("composite", D(False)) & (F.col("impressions") > 20)
    adjusted = decide.adjusted_confidence(F.col("confidence"), F.coalesce("recent", D(False)), tired)
    return v.select("entity_id", decide.evidence_state(F.col("owner"), F.col("spend"), F.col("impressions")).alias("state"), "kind", "percent", "rejection_reason", "final_kind", E.rounded(adjusted, 6).alias("adjusted"))


@query(f"""WITH {_JUDGED}, c AS (SELECT entity_id, unnest(codes) AS code FROM vi) SELECT code, CASE code WHEN 'MIN_PURCHASES_NOT_MET' THEN 'floors' WHEN 'MIN_SPEND_NOT_MET' THEN 'min_spend' WHEN 'MAX_CHANGE_PERCENT_EXCEEDED' THEN 'max_change' ELSE 'none' END AS source,
 CASE code WHEN 'MIN_PURCHASES_NOT_MET' THEN 'purchases' WHEN 'MIN_SPEND_NOT_MET' THEN 'spend' WHEN 'NOT_DELIVERING' THEN 'spend' WHEN 'MAX_CHANGE_PERCENT_EXCEEDED' THEN 'percent' ELSE 'unit' END AS field,
 count(*) AS n, max(CASE code WHEN 'MIN_PURCHASES_NOT_MET' THEN 30 WHEN 'MIN_SPEND_NOT_MET' THEN 1000000 WHEN 'MAX_CHANGE_PERCENT_EXCEEDED' THEN 20 END)::DOUBLE AS last_limit FROM c GROUP BY 1, 2, 3""")
def guardrail_log(spark: SparkSession, sf: str) -> DataFrame:
    """Violations by code, source and field, with the limit of the latest one."""
    v = _judged(spark, sf).select("entity_id", F.inline("violations"))
    return v.groupBy("code", F.coalesce("source", D("none")).alias("source"), "field").agg(F.count("*").alias("n"), F.max_by("limit", "entity_id").alias("last_limit"))


@query("""WITH r AS (SELECT o_orderkey AS rec_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'GENERATING' ELSE 'REJECTED' END AS status, CASE WHEN o_orderkey % 8 = 0 THEN 'REJECTED' END AS decision FROM orders),
d AS (SELECT l_orderkey AS rec_id, arg_min(CASE WHEN l_returnflag = 'R' THEN 'REJECTED' ELSE 'ACCEPTED' END, (l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'REJECTED' ELSE 'ACCEPTED' END)) AS new, min(l_shipdate) AS t FROM lineitem GROUP BY 1)
SELECT rec_id, status, CASE WHEN status = 'COMPLETE' AND decision IS NULL AND new IS NOT NULL THEN new ELSE decision END AS decision, CASE WHEN status = 'COMPLETE' AND decision IS NULL AND new IS NOT NULL THEN t END AS decided_at,
 CASE WHEN new IS NOT NULL AND status <> 'COMPLETE' THEN 'NOT_COMPLETE' WHEN new IS NOT NULL AND decision IS NOT NULL THEN 'ALREADY_DECIDED' END AS refused FROM r LEFT JOIN d USING (rec_id)""")
def accepted_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions applied to recommendations (orders and their lines stand for both)."""
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    s = F.col("o_orderstatus")
    recs = o.select(F.col("o_orderkey").alias("rec_id"), F.when(s == "F", "COMPLETE").when(s == "O", "GENERATING").otherwise("REJECTED").alias("status"), F.when(F.col("o_orderkey") % 8 == 0, "REJECTED").alias("decision"))
    return decide.accepted(recs, li.select(F.col("l_orderkey").alias("rec_id"), F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("ACCEPTED").alias("decision"), F.col("l_shipdate").alias("at")))


@query("""WITH a AS (SELECT o_custkey AS account, count(*) FILTER (l_orderkey IS NULL) AS waiting, count(*) AS recs FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O') ON l_orderkey = o_orderkey GROUP BY 1) SELECT * FROM a""")
def unscored_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted recommendations (closed orders) of each account that have no outcome (open line) yet."""
    recs = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("rec_id"))
    left = recs.join(read(spark, sf, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("rec_id")), "rec_id", "left_anti")
    n = recs.groupBy("account").agg(F.count("*").alias("recs"))
    return n.join(left.groupBy("account").agg(F.count("*").alias("waiting")), "account", "left").select("account", F.coalesce("waiting", D(0)).alias("waiting"), "recs")


@query(f"""WITH b AS (SELECT l_orderkey, sum({MINOR('l_extendedprice')})::BIGINT AS refused FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey AS rec_id, c_name AS packet, refused, refused IS NOT NULL AS was_rejected FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN b ON l_orderkey = o_orderkey""")
def recommendation_view(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendation, its packet and its rejection log side by side; either may be missing."""
    recs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("rec_id"), F.col("o_custkey").alias("c_custkey"))
    packets = read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("packet"))
    log = read(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("rec_id")).agg(F.sum(E.minor(F.col("l_extendedprice"))).alias("refused"))
    return recs.join(packets, "c_custkey", "left").join(log, "rec_id", "left").select("rec_id", "packet", "refused", F.col("refused").isNotNull().alias("was_rejected"))


@query("""WITH l AS (SELECT user_id AS task_id, ts AS t, CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CASE WHEN event_type = 'purchase' AND event_id % 3 > 0 THEN event_id % 3 ELSE 0 END AS n FROM events WHERE event_type IN ('purchase', 'error')),
h AS (SELECT task_id, max(t) FILTER (status = 'SUCCEEDED') AS watermark, sum(n)::BIGINT AS rows, arg_max(status, t) AS last FROM l GROUP BY 1), q AS (SELECT user_id AS task_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT task_id, watermark, coalesce(rows, 0)::BIGINT AS rows, CASE WHEN last <> 'SUCCEEDED' THEN 'failing' WHEN rows > 0 THEN 'healthy' ELSE 'no_new_data' END AS status, coalesce(CASE WHEN watermark IS NULL THEN n END, 0)::BIGINT AS pending FROM h LEFT JOIN q USING (task_id)""")
def run_health(spark: SparkSession, sf: str) -> DataFrame:
    """Watermark and state of each task from its run log, and the requests that still have to run."""
    e = read(spark, sf, "events").select("user_id", "ts", "event_type", "event_id")
    ok = F.col("event_type") == "purchase"
    log = e.where("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("task_id"), F.col("ts").alias("at"), F.when(ok, "SUCCEEDED").otherwise("FAILED").alias("status"), F.when(ok, F.col("event_id") % 3).otherwise(0).alias("rows"))
    waiting = ledger.pending(e.where("event_type = 'view'").select(F.col("user_id").alias("task_id")), log).groupBy("task_id").agg(F.count("*").alias("pending"))
    return ledger.health(log).join(waiting, "task_id", "left").withColumn("pending", F.coalesce("pending", D(0)))


@query("""WITH s AS (SELECT c_custkey AS id, c_nationkey::BIGINT % 3 AS version, c_acctbal AS a, c_mktsegment AS b FROM customer), p AS (SELECT s_suppkey AS id, s_nationkey::BIGINT % 3 AS version, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS a FROM supplier UNION ALL SELECT -1, 1, 1.5)
SELECT coalesce(s.id, p.id) AS id, CASE WHEN s.version = p.version THEN coalesce(p.a, s.a) ELSE s.a END AS a, b, CASE WHEN p.id IS NULL THEN NULL WHEN s.id IS NULL THEN 'MISSING' WHEN s.version = p.version THEN 'WRITTEN' ELSE 'SKIPPED_STALE' END AS outcome FROM s FULL JOIN p USING (id)""")
def patched_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Partial documents (suppliers) written into stored ones (customers) of the same id and version only."""
    stored = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey").cast("long") % 3).alias("version"), F.col("c_acctbal").alias("a"), F.col("c_mktsegment").alias("b"))
    p = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey").cast("long") % 3).alias("version"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")).alias("a"))
    p = p.unionByName(spark.range(1).select((F.col("id") - 1).alias("id"), D(1).cast("long").alias("version"), D(1.5).alias("a")))
    merged, log = ledger.guarded_patch(stored, p, "id", "version", ("a",))
    return merged.select("id", "a", "b").join(log, "id", "full")


@query("""WITH b AS (SELECT o_custkey AS account, max(o_orderdate::DATE) AS done, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY 1)
SELECT account, orders, done AS backfilled_through, CASE WHEN done + 1 < DATE '2001-08-01' - 59 THEN (done + 1)::DATE END AS gap_from, CASE WHEN done + 1 < DATE '2001-08-01' - 59 THEN (DATE '2001-08-01' - 59)::DATE END AS gap_until FROM b""")
def known_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Days of each account that neither its backfill nor the sixty days within reach cover."""
    b = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.count_distinct("o_orderkey").alias("orders"), F.max(F.to_date("o_orderdate")).alias("backfilled_through"))
    start, end = ledger.known_gap(F.col("backfilled_through"), D(date(2001, 8, 1)))
    return b.select("*", start.alias("gap_from"), end.alias("gap_until"))


@query("""WITH g AS (SELECT o_custkey AS account, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, l_shipdate::DATE FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT o.account, count(g.account) > 0 AS has_gap, array_to_string(list_sort(coalesce(list(DISTINCT day::VARCHAR) FILTER (day IS NOT NULL), [])), ',') AS days FROM (SELECT DISTINCT o_custkey AS account FROM orders) o LEFT JOIN g USING (account) GROUP BY 1""")
def combined_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Two verdicts on gaps of an account as one: either says so, days of both once."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    part = lambda df: df.groupBy("account").agg(F.lit(True).alias("gap"), F.collect_set(F.col("day").cast("string")).alias("days"))
    a = part(o.where("o_orderstatus = 'P'"))
    b = part(read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("ship")).join(o.select("o_orderkey", "account"), "o_orderkey").select("account", F.col("ship").alias("day")))
    both = a.unionByName(b).groupBy("account").agg(F.bool_or("gap").alias("gap"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"))
    return o.select("account").distinct().join(both, "account", "left").select("account", F.coalesce("gap", D(False)).alias("has_gap"), F.array_join(F.coalesce("days", F.array().cast("array<string>")), ",").alias("days"))


@query("SELECT p_brand AS document, max(p_partkey) AS version, count(*) AS versions FROM part GROUP BY 1")
def active_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The active version of each document after its newest one was published."""
    v = read(spark, sf, "part").select(F.col("p_brand").alias("document"), F.col("p_partkey").alias("version"), (F.col("p_size") > 40).alias("active"))
    n = v.groupBy("document").agg(F.count("*").alias("versions"))
    return ledger.active_version(ledger.published(v, "document", "version", "active"), "document", "version", "active").join(n, "document")


@query("""WITH f AS (SELECT user_id, min(ts) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1), n AS (SELECT user_id, min(ts) AS seen, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)
SELECT user_id, coalesce(f.seen, n.seen) AS first_seen, n.events FROM n LEFT JOIN f USING (user_id)""")
def first_seen_times(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written over older ones keep the time at which their key was first seen."""
    e, cut = read(spark, sf, "events").select("user_id", "ts"), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    seen = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.count("*").alias("events"))
    return ledger.first_seen(seen(e.where(F.col("ts") < cut)), seen(e.where(F.col("ts") >= cut)), "user_id", "first_seen")


_CAL = ", ".join(f"('{n}', DATE '{a}', DATE '{b}', '{c}')" for n, a, b, c in seasons.CALENDAR)
_TOUCH = lambda a, b: f"coalesce((SELECT list_sort(list(DISTINCT label)) FROM cal WHERE first <= {b} AND last >= {a}), [])"
_WORDS = lambda c: f"CASE WHEN len({c}) <= 1 THEN replace(array_to_string({c}, ''), '_', ' ') ELSE replace(array_to_string({c}[1:len({c}) - 1], ', ') || ' and ' || {c}[len({c})], '_', ' ') END"


@query(f"""WITH cal AS (SELECT * FROM (VALUES {_CAL}) t(label, first, last, confidence)), w AS (SELECT (DATE '2024-11-04' + (7 * i)::INT)::DATE AS a, (DATE '2024-11-04' + (7 * i + 27)::INT)::DATE AS b FROM range(0, 120) r(i)),
x AS (SELECT a, b, {_TOUCH('a', 'b')} AS l, {_TOUCH('(a - 28)', '(a - 1)')} AS m FROM w)
SELECT a AS start, b AS "end", array_to_string(l, ',') AS labels, l <> m AS spans_boundary, (CASE WHEN len(l) = 0 THEN 'window is off-season' ELSE 'window covers ' || {_WORDS('l')} END) || '; ' || (CASE WHEN len(m) = 0 THEN 'baseline is off-season' ELSE 'baseline covers ' || {_WORDS('m')} END) || (CASE WHEN l <> m THEN '; different seasonal regimes' ELSE '' END) || '.' AS summary FROM x""")
def season_context(spark: SparkSession, sf: str) -> DataFrame:
    """What the season calendar says of each 28 days and the 28 before them, a window a week."""
    start = F.date_add(D(date(2024, 11, 4)), (F.col("id") * 7).cast("int"))
    w = spark.range(120).select(start.alias("start")).select("start", F.date_add("start", 27).alias("end"), F.date_sub("start", 28).alias("base_start"), F.date_sub("start", 1).alias("base_end"))
    return seasons.context(w, seasons.calendar(spark)).select("start", "end", F.array_join("labels", ",").alias("labels"), "spans_boundary", "summary")


@query(f"""WITH {DELIVERY} SELECT day, ad_id, spend::BIGINT AS spend FROM del WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'""")
def day_range(spark: SparkSession, sf: str) -> DataFrame:
    """Facts between two days, in order; the bounds reach the scan."""
    return dims.delivery(spark, sf, D(date(2024, 1, 10)), D(date(2024, 1, 16))).select("day", "ad_id", "spend").orderBy("day", "ad_id")


@query(r"""WITH t AS (SELECT p_partkey, p_name || ', ' || p_type || ',, ' AS tags, CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 7 = 1 THEN NULL ELSE p_name END AS said, CASE WHEN p_size % 3 = 0 THEN 'nan'::DOUBLE WHEN p_size % 3 = 1 THEN 'inf'::DOUBLE ELSE p_retailprice END AS x FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda s: trim(s)), lambda s: s <> ''), '|') AS tags, CASE WHEN said <> '' THEN '<untrusted>' || replace(replace(said, '<', '&lt;'), '>', '&gt;') || '</untrusted>' END AS wrapped, CASE WHEN isfinite(x) THEN x END AS finite FROM t""")
def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Tags split, untrusted text wrapped, numbers that are not finite made null."""
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    said = F.when(F.col("p_size") % 7 == 0, "").when(F.col("p_size") % 7 != 1, F.col("p_name"))
    x = F.when(F.col("p_size") % 3 == 0, D(float("nan"))).when(F.col("p_size") % 3 == 1, D(float("inf"))).otherwise(F.col("p_retailprice"))
    return p.select("p_partkey", F.array_join(E.tags(F.concat("p_name", D(", "), "p_type", D(",, "))), "|").alias("tags"), E.untrusted(said).alias("wrapped"), E.finite(x).alias("finite"))


@query(f"""SELECT o_orderkey, (o_orderdate + INTERVAL 330 MINUTE)::DATE AS reporting_day, {MINOR('o_totalprice')} AS total, CASE WHEN o_orderkey % 6 > 0 THEN {MINOR('o_totalprice')} // 10 END AS shipping, {MINOR('o_totalprice')} + coalesce(CASE WHEN o_orderkey % 6 > 0 THEN {MINOR('o_totalprice')} // 10 END, 0) AS charged, 'INR' AS currency FROM orders""")
def normalized_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their reporting day and amounts in the account's currency; a foreign one would stop the query."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", E.minor(F.col("o_totalprice")).alias("total"))
    o = o.withColumn("shipping", F.when(F.col("o_orderkey") % 6 > 0, F.floor(F.col("total") / 10))).withColumn("currency", D("INR"))
    money = lambda c: E.same_currency(F.col(c), F.col("currency"), CANON.currency).alias(c)
    rows = o.select("o_orderkey", E.reporting_day(F.col("o_orderdate"), CANON.timezone).alias("reporting_day"), money("total"), money("shipping"), "currency")
    return rows.withColumn("charged", F.col("total") + F.coalesce("shipping", D(0)))


@query(f"""SELECT o_custkey AS account, count(*) AS orders, max((o_orderdate + INTERVAL 330 MINUTE)::DATE) AS created_through, max(o_orderdate) AS watermark, count(DISTINCT o_orderdate::DATE) AS days, sum({MINOR('o_totalprice')})::BIGINT AS total, sum(-{MINOR('o_totalprice')})::BIGINT AS reversed, max(o_orderkey) AS newest FROM orders GROUP BY 1""")
def backfill_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a backfill says of each account: how far it goes, its watermark, days and money (summed in one currency only)."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("account"), "o_orderdate", E.minor(F.col("o_totalprice")).alias("gross"), D("INR").alias("currency"))
    return o.groupBy("account").agg(
        F.count("*").alias("orders"), F.max(E.reporting_day(F.col("o_orderdate"), CANON.timezone)).alias("created_through"), F.max("o_orderdate").alias("watermark"), F.count_distinct(F.to_date("o_orderdate")).alias("days"),
        E.money_sum(F.col("gross"), F.col("currency")).alias("total"), E.money_sum(-F.col("gross"), F.col("currency")).alias("reversed"), F.max("o_orderkey").alias("newest"),
    )


@query("""WITH ask AS (SELECT n_nationkey AS q, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR ELSE substr(n_name, 1, 3) END AS term FROM nation), e AS (SELECT 'CUSTOMER' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'SUPPLIER', s_suppkey, s_name FROM supplier UNION ALL SELECT 'PART', p_partkey, p_name FROM part),
x AS (SELECT q, kind, id, name, term = id::VARCHAR AS exact FROM ask JOIN e ON term = id::VARCHAR OR contains(lower(name), lower(term))), b AS (SELECT q, bool_or(exact) AS any_exact FROM x GROUP BY 1)
SELECT q, kind, id, name, count(*) OVER (PARTITION BY q) > 5 AS more_than_five FROM x JOIN b USING (q) WHERE exact OR NOT any_exact""")
def entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that a list of terms names: an exact id in any table wins over parts of names."""
    ask = read(spark, sf, "nation").select(F.col("n_nationkey").alias("q"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.substring("n_name", 1, 3)).alias("term"))
    part = lambda t, kind, key, name: read(spark, sf, t).select(D(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
    every = part("customer", "CUSTOMER", "c_custkey", "c_name").unionByName(part("supplier", "SUPPLIER", "s_suppkey", "s_name")).unionByName(part("part", "PART", "p_partkey", "p_name"))
    exact = every.join(sized(ask), F.col("id").cast("string") == F.col("term"))
    rest = ask.join(exact.select("q").distinct(), "q", "left_anti")
    found = exact.select("q", "kind", "id", "name").unionByName(lookups.by_name(rest, every))
    n = found.groupBy("q").agg((F.count("*") > 5).alias("more_than_five"))
    return found.join(sized(n), "q")


@query(f"""WITH {ADS}, {DELIVERY}, d AS (SELECT entity_type, entity_id, day, sum(spend) AS spend, sum(purchases) AS p FROM (SELECT 'AD' AS entity_type, ad_id AS entity_id, day, spend, purchases FROM del JOIN ads USING (ad_id) UNION ALL SELECT 'ADSET', adset_id, day, spend, purchases FROM del JOIN ads USING (ad_id)) GROUP BY 1, 2, 3),
l AS (SELECT *, lag(spend) OVER (PARTITION BY entity_type, entity_id ORDER BY day) AS b FROM d), o AS (SELECT entity_type, entity_id, max(day) FILTER (abs((spend - b) * 100.0::DOUBLE / nullif(abs(b), 0)) >= 20) AS reset_day, min(day) AS created FROM l GROUP BY 1, 2),
s AS (SELECT *, greatest(coalesce(reset_day, created), DATE '2024-01-24') AS start, CASE WHEN reset_day >= DATE '2024-01-24' THEN 'budget change' WHEN reset_day IS NULL AND created >= DATE '2024-01-24' THEN 'created' ELSE 'none' END AS cause FROM o),
n AS (SELECT s.entity_type, s.entity_id, coalesce(sum(p) FILTER (day BETWEEN start AND DATE '2024-01-30'), 0)::BIGINT AS conversions FROM s JOIN d USING (entity_type, entity_id) GROUP BY 1, 2)
SELECT entity_type, entity_id, reset_day, start, cause, conversions, conversions < 50 AS learning, greatest(0, 50 - conversions)::BIGINT AS to_exit FROM s JOIN n USING (entity_type, entity_id)""")
def learning_units(spark: SparkSession, sf: str) -> DataFrame:
    """Learning phase of ads and ad sets, restarted by days on which spend moves by a fifth or more."""
    d = dims.delivery(spark, sf).select("ad_id", "day", "spend", "purchases").join(dims.ads(spark, sf), "ad_id")
    return changes.learning(d, F.slice(dims.levels(), 1, 2))


_OCCUR = [(n, date(y, *a), date(y, *b)) for y in range(1995, 2001) for n, a, b in (("harvest", (11, 1), (11, 7)), ("spring", (3, 10), (3, 12)))]
_OCC = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _OCCUR)


@query(f"""WITH c AS (SELECT * FROM (VALUES {_OCC}) t(label, first, last)), o AS (SELECT o_orderdate::DATE AS day, sum({MINOR('o_totalprice')})::BIGINT AS revenue FROM orders GROUP BY 1), b AS (SELECT min(day) AS a, max(day) AS z FROM o),
s AS (SELECT (a + i::INT)::DATE AS day FROM b, range(0, 20000) r(i) WHERE a + i::INT <= z), v AS (SELECT day, coalesce(revenue, 0) AS revenue FROM s LEFT JOIN o USING (day) WHERE NOT (day >= DATE '1996-02-01' AND day < DATE '1996-02-15')),
x AS (SELECT label, first, count(v.day) AS season_days, avg(revenue) AS sm FROM c LEFT JOIN v ON day BETWEEN first AND last GROUP BY 1, 2),
k AS (SELECT label, first, revenue, row_number() OVER (PARTITION BY label, first ORDER BY day DESC) AS r FROM c JOIN v ON day BETWEEN first - 90 AND first - 1 WHERE NOT EXISTS (SELECT 1 FROM c q WHERE v.day BETWEEN q.first AND q.last)),
m AS (SELECT label, first, count(*) AS base_days, avg(revenue) AS bm FROM k WHERE r <= 30 GROUP BY 1, 2), e AS (SELECT label, first, season_days, coalesce(base_days, 0)::BIGINT AS base_days, CASE WHEN season_days >= 1 AND base_days >= 7 AND bm <> 0 THEN sm / bm END AS ratio FROM x LEFT JOIN m USING (label, first)),
i AS (SELECT label, count(ratio) AS usable, CASE WHEN count(ratio) >= 2 THEN avg(ratio) END AS demand FROM e GROUP BY 1) SELECT label, first, season_days, base_days, {R6('ratio')} AS ratio, usable, {R6('demand')} AS demand FROM e JOIN i USING (label)""")
def season_demand(spark: SparkSession, sf: str) -> DataFrame:
    """Demand of each occurrence of two seasons against the clean off-season days before it, and each season's index."""
    o = facts.orders(spark, sf).groupBy("day").agg(F.sum("gross").alias("revenue"))
    days = o.agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    gap = (F.col("day") >= D(date(1996, 2, 1))) & (F.col("day") < D(date(1996, 2, 15)))
    rows = days.join(o, "day", "left").select("day", F.coalesce("revenue", D(0)).alias("revenue"), (~gap).alias("clean"))
    e = seasons.demand(rows, spark.createDataFrame(_OCCUR, "label string, first date, last date"))
    i = seasons.demand_index(e)
    return e.join(i, "label").select("label", "first", "season_days", "base_days", E.rounded(F.col("ratio"), 6).alias("ratio"), "usable", E.rounded(F.col("demand"), 6).alias("demand"))


@query("SELECT n_regionkey, n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN upper(n_name) ELSE n_name END AS name FROM nation WHERE n_regionkey NOT IN (1, 3) OR n_nationkey % 2 = 0")
def overwritten_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings written blindly: the regions of the second write hold only its rows, the others keep theirs."""
    n, path = read(spark, sf, "nation"), new_path(spark, "settings")
    ledger.overwrite(n.select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey"), path, "n_regionkey")
    ledger.overwrite(n.where("n_regionkey IN (1, 3) AND n_nationkey % 2 = 0").select("n_nationkey", F.upper("n_name").alias("name"), "n_regionkey"), path, "n_regionkey")
    return spark.read.parquet(path).select("n_regionkey", "n_nationkey", "name")
