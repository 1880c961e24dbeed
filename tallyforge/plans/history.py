"""Queries of archived documents, snapshots and their changes, each preceded by its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.operators import changes
from tallyforge.plans.entities import TOTALS, totals
from tallyforge.plans.sql import DAILY, MINOR
from tallyforge.runtime import documents as read
from tallyforge.runtime import new_path
from tallyforge.sources import archive, facts

D = F.lit
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


# A customer's orders of a year are what a run finds of the ad set of that id; the year is the run.
_RAW = f"""raw AS (SELECT o_custkey AS entity_id, year(o_orderdate)::BIGINT AS run, (o_custkey + year(o_orderdate)) % 5 AS k, max({MINOR('o_totalprice')}) AS budget, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS prio,
 count(*) % 3 AS n, list_sort(list(DISTINCT (o_orderkey % 4)::VARCHAR)) AS creatives FROM orders GROUP BY 1, 2, 3),
snap AS (SELECT entity_id, run, make_date(run::INT, 6, 30) AS day, CASE WHEN k = 0 THEN 'UNKNOWN' WHEN k = 1 THEN 'CAMPAIGN' ELSE 'ADSET' END AS owner, CASE WHEN k > 1 THEN budget END AS daily, CASE WHEN k = 1 THEN budget END AS lifetime, status,
 '{{"n":"' || n || '","prio":"' || prio || '"}}' AS targeting, prio AS bid_strategy, array_to_string(creatives, ',') AS creatives FROM raw)"""


def _archive(spark: SparkSession, sf: str) -> str:
    """The documents of every run, written to an archive as they would arrive: keys and lists in an order that changes from run to run."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    year, last = F.year("o_orderdate").cast("long"), F.struct("o_orderdate", "o_orderkey")
    raw = o.groupBy(F.col("o_custkey").alias("id"), year.alias("run")).agg(F.max(E.minor(F.col("o_totalprice"))).alias("budget"), F.max_by("o_orderstatus", last).alias("status"), F.max_by("o_orderpriority", last).alias("prio"), (F.count("*") % 3).cast("string").alias("n"), F.collect_set((F.col("o_orderkey") % 4).cast("string")).alias("creatives"))
    k, odd = (F.col("id") + F.col("run")) % 5, F.col("run") % 2 == 1
    targeting = F.when(odd, F.create_map(D("prio"), F.col("prio"), D("n"), F.col("n"))).otherwise(F.create_map(D("n"), F.col("n"), D("prio"), F.col("prio")))
    body = F.struct(
        F.col("id").cast("string").alias("id"), D("ADSET").alias("type"), F.when(k == 0, "UNKNOWN").when(k == 1, "CAMPAIGN").otherwise("ADSET").alias("owner"), F.when(k > 1, F.col("budget")).alias("daily_budget"), F.when(k == 1, F.col("budget")).alias("lifetime_budget"),
        "status", targeting.alias("targeting"), F.col("prio").alias("bid_strategy"), F.sort_array("creatives", asc=False).alias("creatives"),
    )
    path = new_path(spark, "archive")
    archive.write(raw.select(D("entities").alias("source"), F.make_date(F.col("run").cast("int"), D(6), D(30)).alias("day"), "run", F.to_json(body).alias("body")), path)
    return path


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return archive.entities(archive.read(spark, _archive(spark, sf), "entities"))


@query(f"WITH {_RAW} SELECT * FROM snap")
def config_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of every entity at every run, from the archive."""
    return snapshots(spark, sf).select("entity_id", "run", "day", "owner", "daily", "lifetime", "status", "targeting", "bid_strategy", "creatives")


_EVENTS = f"""{_RAW}, p AS (SELECT a.entity_id, a.run, a.day AS detected_on, a, b FROM snap a JOIN snap b ON a.entity_id = b.entity_id AND a.run = b.run + 1),
x AS (SELECT entity_id, run, detected_on, a, b, unnest([{{'f': 'BUDGET', 'x': concat_ws(' ', 'daily:' || b.daily, 'lifetime:' || b.lifetime), 'y': concat_ws(' ', 'daily:' || a.daily, 'lifetime:' || a.lifetime)}}, {{'f': 'STATUS', 'x': b.status, 'y': a.status}}, {{'f': 'TARGETING', 'x': b.targeting, 'y': a.targeting}},
 {{'f': 'BID_STRATEGY', 'x': b.bid_strategy, 'y': a.bid_strategy}}, {{'f': 'CREATIVE_ASSIGNMENT', 'x': b.creatives, 'y': a.creatives}}]) AS e FROM p),
q AS (SELECT entity_id, run, detected_on, e.f AS field, e.x AS before, e.y AS after, CASE WHEN e.f = 'BUDGET' THEN floor(CASE WHEN a.daily IS NOT NULL AND b.daily IS NOT NULL THEN (a.daily - b.daily) * 100.0::DOUBLE / nullif(b.daily, 0) WHEN a.daily IS NULL AND b.daily IS NULL THEN (a.lifetime - b.lifetime) * 100.0::DOUBLE / nullif(b.lifetime, 0) END * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE END AS percent FROM x
 WHERE e.x IS DISTINCT FROM e.y AND (e.f <> 'BUDGET' OR (a.owner <> 'UNKNOWN' AND b.owner <> 'UNKNOWN'))),
ev AS (SELECT *, field = 'BUDGET' AND coalesce(abs(percent) >= 20, false) AS material FROM q)"""


@query(f"WITH {_EVENTS} SELECT * FROM ev")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Budget, status, targeting, bid and creative changes from each run to the next."""
    return changes.events(snapshots(spark, sf).drop("entity_type"))


@query(f"""WITH {_EVENTS} SELECT entity_id, count(*) AS changes, {', '.join(f"count(*) FILTER (field = '{f}') AS {f.lower()}" for f in ('BUDGET', 'STATUS', 'TARGETING', 'BID_STRATEGY', 'CREATIVE_ASSIGNMENT'))}, max(run) AS last_run, arg_max(detected_on, run) FILTER (material) AS last_material_budget
FROM ev WHERE entity_id IN (SELECT user_id FROM events) GROUP BY 1""")
def change_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Changes by entity, for entities with delivery features."""
    return changes.enriched(changes.events(snapshots(spark, sf).drop("entity_type")), read(spark, sf, "events").select(F.col("user_id").alias("entity_id")))


@query("""SELECT p_partkey AS entity_id, CASE WHEN p_size % 3 = 0 THEN 'COMPOSITE' ELSE 'STANDARD' END AS creative_kind, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_brand < p_type THEN p_brand || ',' || p_type ELSE p_type || ',' || p_brand END ELSE p_brand END AS members,
 CASE WHEN p_size % 5 = 1 THEN '' WHEN p_size % 5 > 1 THEN 'feed,' || lower(p_brand) END AS placements FROM part""")
def entity_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Creative documents from the archive: composites by their feed, members once, placements only where all are texts."""
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    one = lambda c: F.concat(D('[{"hash":"'), F.col(c), D('"}]'))
    feed = F.concat(D('{"feed":{"images":'), one("p_brand"), D(',"videos":'), one("p_type"), D(',"bodies":'), one("p_brand"), D("}}"))
    creative = F.when(F.col("p_size") % 3 == 0, feed).otherwise(F.concat(D('{"hash":"'), F.col("p_brand"), D('"}')))
    places = F.when(F.col("p_size") % 5 == 0, D('["feed",7]')).when(F.col("p_size") % 5 == 1, D("[]")).otherwise(F.concat(D('["feed","'), F.lower("p_brand"), D('"]')))
    body = F.concat(D('{"id":"'), F.col("p_partkey").cast("string"), D('","type":"AD","creative":'), creative, D(',"placements":'), places, D("}"))
    path = new_path(spark, "archive")
    archive.write(p.select(D("creatives").alias("source"), D("2024-01-30").cast("date").alias("day"), D(1).cast("long").alias("run"), body.alias("body")), path)
    return archive.entities(archive.read(spark, path, "creatives")).select("entity_id", "creative_kind", "members", "placements")


@query(f"""SELECT o_orderdate::DATE AS day, count(*) AS orders, sum({MINOR('o_totalprice')})::BIGINT AS gross, max(o_orderkey) AS last_order FROM orders WHERE o_orderdate::DATE <= DATE '1997-06-30' GROUP BY 1""")
def store_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Store facts known at a day, rebuilt from an archive in which every order was fetched twice: the latest run of an order counts."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    body = lambda price: F.to_json(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), price.alias("gross")))
    day = F.trunc("o_orderdate", "year")
    runs = [o.select(D("orders").alias("source"), day.alias("day"), D(n).cast("long").alias("run"), body(E.minor(F.col("o_totalprice")) * k).alias("body")) for n, k in ((1, 2), (2, 1))]
    path = new_path(spark, "archive")
    archive.write(runs[0].unionByName(runs[1]), path)
    rows = archive.read(spark, path, "orders", "1997-06-30").withColumn("o", F.from_json("body", "o_orderkey long, day date, gross long"))
    last = rows.groupBy("o.o_orderkey").agg(F.max_by("o", "run").alias("o")).where("o.day <= DATE '1997-06-30'")
    return last.groupBy(F.col("o.day").alias("day")).agg(F.count("*").alias("orders"), F.sum("o.gross").alias("gross"), F.max("o.o_orderkey").alias("last_order"))


@query(f"""WITH {DAILY}, d AS (SELECT ad_id, day, CASE WHEN ad_id % 2 = 0 THEN spend ELSE spend + 1 END AS spend, purchases FROM daily WHERE day <= DATE '2024-01-20') SELECT ad_id, day, spend, purchases FROM d""")
def facts_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery known at a day, rebuilt from archived reports: the latest run of an ad and day counts, malformed rows are skipped, later runs are not read."""
    d = facts.daily(spark, sf).select("ad_id", "day", "spend", "purchases")
    body = lambda more: F.to_json(F.struct("ad_id", F.col("day").cast("string").alias("day"), (F.col("spend") + more).alias("spend"), "purchases"))
    page = lambda rows, run, more: rows.select(D("reports").alias("source"), F.col("day"), D(run).cast("long").alias("run"), body(more).alias("body"))
    bad = spark.range(1).select(D("reports").alias("source"), D("2024-01-02").cast("date").alias("day"), D(3).cast("long").alias("run"), D('{"ad_id": "x"').alias("body"))
    path = new_path(spark, "archive")
    archive.write(page(d, 1, 1).unionByName(page(d.where("ad_id % 2 = 0"), 2, 0)).unionByName(bad), path)
    rows = archive.read(spark, path, "reports", "2024-01-20").withColumn("r", F.from_json("body", "ad_id long, day date, spend long, purchases long"))
    last = rows.where("r.ad_id IS NOT NULL AND r.day IS NOT NULL").groupBy("r.ad_id", "r.day").agg(F.max_by("r", "run").alias("r"))
    return last.select("r.*")


@query(f"""WITH {TOTALS}, p AS (SELECT entity_type, entity_id, spend, impressions, purchases, carts, landings, spend <= 0 AND impressions <= 0 AS idle FROM tot WHERE days = 28 AND entity_type IN ('ADSET', 'CAMPAIGN'))
SELECT entity_type || '_' || entity_id AS packet_key, CASE WHEN idle THEN 'NOT_DELIVERING' ELSE 'EVIDENCE' END AS outcome, to_json({{'entity_id': entity_id, 'spend': spend, 'purchases': purchases, 'carts': carts}}) AS body,
 'Unit ' || entity_type || ' ' || entity_id || chr(10) || chr(10) || CASE WHEN idle THEN 'It delivers nothing.' ELSE 'Spend: ' || spend || chr(10) || 'Purchases: ' || purchases || chr(10) || chr(10) || 'Funnel: ' || landings || ' landings, ' || carts || ' carts' END AS text FROM p""")
def packet_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence packets: a key, a JSON body and a text whose sections a blank line parts; idle units get a short one."""
    p = totals(spark, sf, ("ADSET", "CAMPAIGN"), (28,))
    idle = (F.col("spend") <= 0) & (F.col("impressions") <= 0)
    head = F.concat(D("Unit "), "entity_type", D(" "), "entity_id")
    numbers = F.concat(D("Spend: "), "spend", D("\nPurchases: "), "purchases")
    funnel = F.concat(D("Funnel: "), "landings", D(" landings, "), "carts", D(" carts"))
    text = F.concat_ws("\n\n", head, F.when(idle, "It delivers nothing.").otherwise(numbers), F.when(~idle, funnel))
    return p.select(F.concat_ws("_", "entity_type", "entity_id").alias("packet_key"), F.when(idle, "NOT_DELIVERING").otherwise("EVIDENCE").alias("outcome"), F.to_json(F.struct("entity_id", "spend", "purchases", "carts")).alias("body"), text.alias("text"))
