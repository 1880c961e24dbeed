"""The analytics queries, each with its SQL in ``tallyforge.plans.sql`` under the same name."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators import features, hashes
from tallyforge.operators.components import connected_components
from tallyforge.operators.upsert import version_guard
from tallyforge.runtime import documents as read
from tallyforge.sources import facts
from tallyforge.streaming.latest import latest_of_stream

D = F.lit
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str):
    return E.rounded(c, 6).alias(name)


@query
def entity_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return features.statistics(features.recent(spark, sf))


@query
def daily_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.daily(spark, sf)


@query
def window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return features.metrics(features.recent(spark, sf))


@query
def weekly_trend(spark: SparkSession, sf: str) -> DataFrame:
    age = F.datediff(D(CANON.as_of), F.col("day"))
    pick = lambda c, a, b: F.coalesce(F.sum(F.when(age.between(a, b), F.col(c))), D(0)).cast("long")
    d = facts.ads(spark, sf).join(facts.daily(spark, sf, F.date_sub(D(CANON.as_of), 13), D(CANON.as_of)), "ad_id", "left").groupBy("ad_id").agg(pick("spend", 0, 6).alias("spend"), pick("spend", 7, 13).alias("spend_before"), pick("purchases", 0, 6).alias("purchases"), pick("purchases", 7, 13).alias("purchases_before"))
    change = E.percent_change(F.col("spend"), F.col("spend_before"))
    return d.select("*", r6(change, "spend_change"), E.trend(change).alias("spend_trend"), E.volume_trend(F.col("purchases"), F.col("purchases_before")).alias("purchase_trend"))


@query
def rolling_week(spark: SparkSession, sf: str) -> DataFrame:
    d = facts.daily(spark, sf).groupBy(F.floor(F.col("ad_id") / 25).alias("campaign_id"), "day").agg(F.sum("spend").alias("spend"), F.sum("purchases").alias("purchases"))
    w = W.partitionBy("campaign_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return d.select("campaign_id", "day", F.sum("spend").over(w).alias("spend_7d"), F.sum("purchases").over(w).alias("purchases_7d"))


@query
def window_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Days of each window without any fact, or inside a known half-open gap."""
    gaps = spark.createDataFrame([(0, date(2024, 1, 5), date(2024, 1, 8), "outage"), (1, date(2024, 1, 20), date(2024, 1, 21), "late")], "g int, g_from date, g_until date, why string")
    spine = spark.createDataFrame([(n, CANON.as_of - timedelta(n - 1)) for n in CANON.windows], "days int, first date")
    spine = spine.select("days", F.explode(F.sequence("first", D(CANON.as_of), F.expr("interval 1 day"))).alias("day"))
    have = facts.daily(spark, sf).select("day").distinct().withColumn("seen", D(True))
    rows = spine.join(have, "day", "left").join(F.broadcast(gaps), (F.col("day") >= F.col("g_from")) & (F.col("day") < F.col("g_until")), "left")
    per_day = rows.groupBy("days", "day").agg(F.max("seen").alias("seen"), F.min_by("why", "g").alias("why"))
    gap = F.col("seen").isNull() | F.col("why").isNotNull()
    return per_day.groupBy("days").agg(F.count_if(gap).alias("gap_days"), F.array_join(F.array_sort(F.collect_list(F.when(gap, F.col("day").cast("string")))), ",").alias("gap_list"))


@query
def store_months(spark: SparkSession, sf: str) -> DataFrame:
    """Gross by order day, refunds by their own day, net and new customers a month."""
    first = W.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    o = facts.orders(spark, sf).withColumn("new", (F.row_number().over(first) == 1).cast("int"))
    month = F.date_format("day", "yyyy-MM").alias("month")
    sold = o.groupBy(month).agg(F.count("*").alias("orders"), F.sum("gross").alias("gross"), F.sum("new").alias("new_customers"))
    back = facts.refunds(spark, sf).groupBy(month).agg(F.sum("refund").alias("refunds"))
    both = sold.join(back, "month", "full")
    z = lambda c: F.coalesce(c, D(0)).cast("long").alias(c)
    return both.select("month", z("orders"), z("gross"), z("refunds"), (F.coalesce("gross", D(0)) - F.coalesce("refunds", D(0))).cast("long").alias("net"), z("new_customers"), r6(E.ratio(F.col("gross"), F.col("orders")), "aov"))


@query
def product_mix(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.coalesce("p_type", D("UNKNOWN")).alias("product_type"))
    j = li.join(p, "l_partkey")
    return j.groupBy("product_type").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count_distinct("l_orderkey").alias("orders"), F.sum(E.minor(F.col("l_extendedprice"))).alias("revenue"))


@query
def url_tags(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    tag = E.query_value(u, "ref")
    kind = F.when(u.isNull() | (F.trim(u) == ""), "NO_URL").when(u.rlike(r"\{\{(ad|campaign)\.id\}\}"), "ID_MACRO").when(u.rlike(r"\{\{(ad|campaign)\.name\}\}"), "NAME_MACRO").when(tag.isNotNull(), "STATIC_TEXT").otherwise("MISSING")
    return read(spark, sf, "pages").select("page_id", tag.alias("ref"), E.query_value(u, "page").alias("page"), E.source_class(tag).alias("source_class"), kind.alias("kind"))


@query
def name_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' priorities stand for names: a name resolves only if exactly one entity has it."""
    part = read(spark, sf, "part").select(E.normal_name(F.col("p_name")).alias("name"), "p_partkey")
    index = part.groupBy("name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("entity"))
    asked = read(spark, sf, "part").select(F.col("p_partkey").alias("asked"), E.normal_name(F.concat(D("  "), F.upper("p_name"), D(" "))).alias("name"))
    return asked.join(index, "name", "left").select("asked", F.when(F.col("n") == 1, F.col("entity")).alias("entity"), F.when(F.col("n") == 1, "NAME_MATCH").otherwise("UNRESOLVED").alias("resolution"))


@query
def season_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Seasons (inclusive) that each month of orders overlaps."""
    seasons = spark.createDataFrame([("DIWALI", date(1996, 11, 8), date(1996, 11, 14)), ("EOSS", date(1996, 12, 26), date(1997, 1, 15)), ("MONSOON", date(1997, 7, 1), date(1997, 8, 31))], "label string, s date, e date")
    m = facts.orders(spark, sf).select(F.trunc("day", "MM").alias("first")).distinct().withColumn("last", F.last_day("first"))
    hit = m.join(F.broadcast(seasons), (F.col("s") <= F.col("last")) & (F.col("e") >= F.col("first")), "left")
    return hit.groupBy("first").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels")).select(F.date_format("first", "yyyy-MM").alias("month"), "labels", (F.col("labels") == "").alias("off_season"))


@query
def demand_index(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue of each first week of a quarter against up to 30 latest other days of the 90 before it."""
    rev = facts.orders(spark, sf).groupBy("day").agg(F.sum("gross").alias("revenue"))
    tagged = rev.withColumn("quarter", F.trunc("day", "quarter")).withColumn("on", F.datediff("day", "quarter") < 7)
    season = tagged.where("on").groupBy("quarter").agg(F.avg("revenue").alias("season_mean"), F.count("*").alias("season_days"))
    base = season.select("quarter", F.explode(F.sequence(D(1), D(90))).alias("back")).withColumn("day", F.date_sub("quarter", F.col("back")))
    off = base.join(tagged.where("NOT on").select("day", "revenue"), "day")
    latest = off.withColumn("_r", F.row_number().over(W.partitionBy("quarter").orderBy("back"))).where("_r <= 30")
    mean = latest.groupBy("quarter").agg(F.avg("revenue").alias("base_mean"), F.count("*").alias("base_days"))
    ok = (F.col("base_days") >= 7) & (F.col("base_mean") != 0)
    return season.join(mean, "quarter", "left").select("quarter", "season_days", F.coalesce("base_days", D(0)).alias("base_days"), F.when(ok, E.rounded(F.col("season_mean") / F.col("base_mean"), 6)).alias("demand"))


@query
def guarded_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    newest = W.partitionBy("user_id").orderBy("event_id")
    target = e.where("event_id % 2 = 0").withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    merged, _ = version_guard(target, e.where("event_id % 2 = 1"), "user_id", "ts", "event_id")
    return merged


@query
def rejected_versions(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("user_id", "ts", "event_id")
    target = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("ts"))
    _, rejected = version_guard(target, e.where("event_id % 2 = 1"), "user_id", "ts", "event_id")
    return rejected.groupBy("user_id").agg(F.count("*").alias("rejected"))


@query
def budget_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Change events between replicated snapshots: one row a field that differs from the run before."""
    c = read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    snap = c.select("c_custkey", "c_acctbal", "c_mktsegment", F.explode(F.sequence(D(0), D(3))).alias("run"))
    snap = snap.select("c_custkey", "run", F.floor(F.col("c_acctbal") * (1 + F.when(F.col("c_custkey") % 4 == F.col("run"), 0.25).otherwise(0.0))).alias("budget"), F.when((F.col("c_custkey") % 7 == 0) & (F.col("run") == 2), "PAUSED").otherwise("ACTIVE").alias("status"))
    w = W.partitionBy("c_custkey").orderBy("run")
    was = snap.withColumn("_b", F.lag("budget").over(w)).withColumn("_s", F.lag("status").over(w)).where("run > 0")
    s = lambda f, a, b, p: F.struct(D(f).alias("field"), a.cast("string").alias("before"), b.cast("string").alias("after"), p.alias("percent"))
    pct = E.rounded(E.percent_change(F.col("budget"), F.col("_b")), 2)
    events = was.select("c_custkey", "run", F.inline(F.array(s("BUDGET", F.col("_b"), F.col("budget"), pct), s("STATUS", F.col("_s"), F.col("status"), D(None).cast("double")))))
    return events.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("material", F.coalesce(F.abs("percent") >= CANON.material_change_percent, D(False)))


@query
def learning_phase(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases since the last large day of spend (at most a week back) against the exit threshold."""
    d = facts.daily(spark, sf)
    reset = d.groupBy("ad_id").agg(F.max(F.when(F.col("spend") >= 30000, F.col("day"))).alias("reset"))
    start = F.greatest(F.coalesce("reset", D(date(2000, 1, 1))), F.date_sub(D(CANON.as_of), CANON.learning_days - 1))
    n = d.join(reset, "ad_id").withColumn("start", start).groupBy("ad_id", "start").agg(F.coalesce(F.sum(F.when((F.col("day") >= F.col("start")) & (F.col("day") <= D(CANON.as_of)), F.col("purchases"))), D(0)).alias("conversions"))
    return n.select("ad_id", "start", "conversions", (F.col("conversions") < CANON.learning_conversions).alias("learning"), F.greatest(D(0), CANON.learning_conversions - F.col("conversions")).cast("long").alias("to_exit"))


@query
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision unit, eligibility, suggested change and guardrail violations of every ad set (28 days)."""
    t = features.recent(spark, sf).where("days = 28 AND entity_type = 'ADSET'")
    owner = F.when(F.col("entity_id") % 3 == 0, "OWNS").when(F.col("entity_id") % 3 == 1, "DEFERS").otherwise("UNKNOWN")
    n, floor = F.col("purchases"), F.col("floor")
    reasons = F.array_compact(F.array(F.when(owner != "OWNS", "NOT_BUDGET_OWNER"), F.when((F.col("spend") <= 0) & (F.col("impressions") <= 0), "NOT_DELIVERING"), F.when(n < floor, "SAMPLE_TOO_SMALL")))
    excess = F.least(D(1.0), (n - floor) / floor.cast("double"))
    conf = F.when(F.size("reasons") == 0, F.greatest(D(0.5), F.least(D(0.9), 0.5 + 0.4 * excess))).otherwise(0.0)
    change = F.when(F.size("reasons") == 0, F.floor(5 + F.col("confidence") * 10 + 0.5)).cast("long")
    row = t.withColumn("reasons", reasons).withColumn("confidence", conf).withColumn("suggested", change)
    return row.select("entity_id", owner.alias("owner"), F.array_join("reasons", " | ").alias("reasons"), r6(F.col("confidence"), "confidence"), r6(F.col("confidence") * F.when(F.col("carts") > 60, 0.6).otherwise(1.0), "adjusted_confidence"), "suggested", F.coalesce(F.col("suggested") > CANON.max_change_percent, D(False)).alias("over_limit"))


@query
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability by confidence bucket, every bucket present; means only from ten points on."""
    p = read(spark, sf, "labels").select(((F.col("doc_id") * 37 % 100) / 100.0).alias("confidence"), F.col("quality").cast("double").alias("actual"))
    last = int(1 / CANON.calibration_width) - 1
    b = p.withColumn("bucket", F.least(F.greatest(F.floor(F.col("confidence") / CANON.calibration_width), D(0)), D(last)).cast("int"))
    agg = b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("actual").alias("a"), F.avg((F.col("confidence") - F.col("actual")) ** 2).alias("q"))
    all_ = spark.range(last + 1).select(F.col("id").cast("int").alias("bucket"))
    ok = F.col("n") >= CANON.calibration_min_n
    return all_.join(agg, "bucket", "left").select("bucket", F.coalesce("n", D(0)).alias("n"), r6(F.when(ok, F.col("c")), "mean_confidence"), r6(F.when(ok, F.col("a")), "mean_actual"), r6(F.when(ok, F.col("q")), "brier"))


@query
def rejection_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("ts", "event_type")
    day = E.reporting_day(F.col("ts"), CANON.timezone)
    return e.groupBy(day.alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("rejected")).select("day", "total", "rejected", r6(E.ratio(F.col("rejected"), F.col("total")), "rate"))


@query
def outcome_day(spark: SparkSession, sf: str) -> DataFrame:
    """First day on which an ad's purchases since the 8th reach five and its spend reaches 50,000."""
    d = facts.daily(spark, sf).where(F.col("day") > D(date(2024, 1, 7)))
    w = W.partitionBy("ad_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    c = d.select("ad_id", "day", F.sum("purchases").over(w).alias("p"), F.sum("spend").over(w).alias("s"))
    return c.groupBy("ad_id").agg(F.min(F.when((F.col("p") >= 5) & (F.col("s") >= 50000), F.col("day"))).alias("met_on"), F.max("p").alias("purchases"), F.max("s").alias("spend"))


@query
def hash_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families of parts with near hashes of 64 bits: ten digits stand for the brand, six for the type."""
    base = read(spark, sf, "part").select("p_brand", "p_type").distinct()
    digits = lambda c, n: F.substring(F.md5(c), 1, n)
    return hashes.families(base.select(F.concat_ws("|", "p_brand", "p_type").alias("asset"), F.concat(digits("p_brand", 10), digits("p_type", 6)).alias("hash")))


@query
def money_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select("o_orderkey", F.format_string("%.2f", "o_totalprice").alias("t"))
    inr, jpy, kwd = (E.parse_money(F.col("t"), D(c)) for c in ("INR", "JPY", "KWD"))
    return o.select("o_orderkey", inr.alias("inr"), jpy.alias("jpy"), kwd.alias("kwd"), E.format_money(inr, D("INR")).alias("text"))


@query
def calendar_days(spark: SparkSession, sf: str) -> DataFrame:
    d = facts.daily(spark, sf).select("day").distinct()
    return d.select("day", (F.dayofweek("day") - 1).alias("dow"), F.date_format("day", "EEEE").alias("day_name"), F.date_format("day", "MMMM").alias("month_name"), F.dayofweek("day").isin(1, 7).alias("weekend"))


@query
def archive_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Facts known at a day: the latest finished run of each ad and day, runs by event id."""
    e = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", E.minor(F.col("value")).alias("amount"))
    runs = e.select((F.col("event_id") % 50).alias("run")).distinct().withColumn("ok", F.col("run") % 7 != 0).withColumn("finished", F.date_add(D(date(2024, 1, 1)), (F.col("run") % 40).cast("int")))
    allowed = runs.where(F.col("ok") & (F.col("finished") <= D(date(2024, 1, 20))))
    rows = e.withColumn("run", F.col("event_id") % 50).join(F.broadcast(allowed.select("run", "finished")), "run")  # at most 50 runs
    w = W.partitionBy("user_id", "day").orderBy(F.desc("finished"), F.desc("event_id"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("user_id", "day", "run", "amount")


@query
def strategy_choice(spark: SparkSession, sf: str) -> DataFrame:
    """What two strategies choose in each window: most purchases, and highest raw ROAS; ties by least id."""
    t = features.recent(spark, sf).where("entity_type = 'ADSET' AND spend > 0").withColumn("roas", E.ratio(F.col("purchase_value"), F.col("spend")))
    system = t.groupBy("days").agg(F.max_by("entity_id", F.struct("purchases", -F.col("entity_id"))).alias("system"))
    naive = t.groupBy("days").agg(F.max_by("entity_id", F.struct("roas", -F.col("entity_id"))).alias("naive"))
    return system.join(naive, "days")


@query
def attribution_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Orders resolved by id, by name, or not at all, against purchases; blended store revenue over ad spend."""
    o = facts.orders(spark, sf).withColumn("how", F.when(F.col("o_orderkey") % 10 < 6, "AD_ID").when(F.col("o_orderkey") % 10 < 8, "NAME_MATCH"))
    n = o.agg(F.count_if(F.col("how") == "AD_ID").alias("by_id"), F.count_if(F.col("how") == "NAME_MATCH").alias("by_name"), F.count_if(F.col("how").isNull()).alias("unresolved"), F.sum("gross").alias("gross"))
    d = facts.daily(spark, sf).agg(F.sum("purchases").alias("purchases"), F.sum("spend").alias("spend"))
    return n.join(F.broadcast(d)).select("by_id", "by_name", "unresolved", "purchases", r6(E.ratio(F.col("by_id"), F.col("purchases")), "id_coverage"), r6(E.ratio(F.col("gross"), F.col("spend")), "blended_mer"))


@query
def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda t, kind, key, name: read(spark, sf, t).select(D(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(name).alias("name"))
    every = part("customer", "CUSTOMER", "c_custkey", "c_name").unionByName(part("supplier", "SUPPLIER", "s_suppkey", "s_name")).unionByName(part("part", "PART", "p_partkey", "p_name"))
    return every.where(F.lower("name").contains("12"))


@query
def newest_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@query
def open_orders_with_refunds(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    back = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(back, "o_orderkey", "left_semi")


@query
def orders_without_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_of_stream(spark, f"{sf}/events.parquet*", "user_id", "event_id", "ts", columns=("user_id", "event_id", "ts", "event_type"))
    return rows.select("user_id", "event_id", "event_type")
