"""Dimensions and store facts of the entity graph, from the driver's tables.

Customers stand for ads (ad set: five ads, campaign: 25, creative family: nation), so most entities have no delivery
at all. Events of a user are the delivery of the ad of that id. Orders carry a tag: an ad's id, a campaign's name, or
nothing that is known. The store's days are moved into the delivery's two months by the order's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.runtime import documents as read
from tallyforge.runtime import sized

FIRST_DAY = "2023-12-05"
DAYS = 57
LEVELS = ("AD", "ADSET", "CAMPAIGN", "CREATIVE_FAMILY", "ACCOUNT")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ad_id"), F.col("c_nationkey").cast("long").alias("family_id"), F.col("c_name").alias("name"))
    return c.select("ad_id", F.floor(F.col("ad_id") / 5).alias("adset_id"), F.floor(F.col("ad_id") / 25).alias("campaign_id"), "family_id", "name")


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns take the name of their first ad; the names of every seventh are one, so that they are ambiguous."""
    a = ads(spark, sf_dir).groupBy("campaign_id").agg(F.min_by("name", "ad_id").alias("first"))
    return a.select("campaign_id", F.when(F.col("campaign_id") % 7 == 6, "spare").otherwise(F.col("first")).alias("name"))


def levels(kinds: tuple[str, ...] = LEVELS) -> Column:
    """The entities of ``kinds`` that an ad's row belongs to: array of (entity_type, entity_id)."""
    ids = (F.col("ad_id"), F.col("adset_id"), F.col("campaign_id"), F.col("family_id"), F.lit(0))
    return F.array(*[F.struct(F.lit(k).alias("entity_type"), v.cast("long").alias("entity_id")) for k, v in zip(LEVELS, ids, strict=True) if k in kinds])


def entities(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = LEVELS) -> DataFrame:
    """Every entity of ``kinds``, with or without delivery."""
    return ads(spark, sf_dir).select(F.inline(levels(kinds))).distinct()


def delivery(spark: SparkSession, sf_dir: str, since: Column | None = None, until: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """A row an ad and day with all measures; ``since`` and ``until`` reach the scan, ``only`` (ad_id) the rows before they are summed. Reach is null without views."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    if since is not None:
        e = e.where(F.col("ts") >= since.cast("timestamp_ntz"))
    if until is not None:
        e = e.where(F.col("ts") < F.date_add(until, 1).cast("timestamp_ntz"))
    if only is not None:
        e = e.join(sized(only.select(F.col("ad_id").alias("user_id")).distinct()), "user_id", "left_semi")
    kind, v = F.col("event_type"), F.col("value")
    money = lambda *k: F.coalesce(F.sum(F.when(kind.isin(*k), E.minor(v))), F.lit(0)).cast("long")
    views = F.count_if(kind == "view")
    return e.groupBy(F.col("user_id").alias("ad_id"), F.to_date("ts").alias("day")).agg(
        views.alias("impressions"), F.when(views > 0, F.count_distinct(F.when(kind == "view", F.hour("ts")))).alias("reach"),
        F.count_if(kind == "click").alias("clicks"), F.count_if((kind == "click") & (v > 20)).alias("landings"), F.count_if(kind == "signup").alias("carts"),
        F.count_if((kind == "signup") & (v > 20)).alias("checkouts"), F.count_if(kind == "purchase").alias("purchases"), money("view", "click").alias("spend"), money("purchase").alias("purchase_value"),
        F.when((F.col("user_id") % 10 == 3) & (F.dayofmonth(F.to_date("ts")) > 20), "1d_click").otherwise("7d_click").alias("attribution"),
    )


def store_day(key: str) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col(key) % DAYS).cast("int"))


def store_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, day, gross, new_customer, tag): whether it is the customer's first order is null for every tenth."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("_first"))
    o = o.join(first, "o_custkey").join(campaigns(spark, sf_dir).withColumnRenamed("name", "_name"), F.floor(F.col("o_custkey") / 25) == F.col("campaign_id"), "left")
    last = F.col("o_orderkey") % 10
    tag = F.when(last < 5, F.col("o_custkey").cast("string")).when(last < 8, F.concat(F.lit("  "), F.upper("_name"), F.lit(" "))).when(last == 8, "99999999999")
    return o.select(F.col("o_orderkey").alias("order_id"), store_day("o_orderkey").alias("day"), E.minor(F.col("o_totalprice")).alias("gross"), F.when(last != 9, F.col("o_orderkey") == F.col("_first")).alias("new_customer"), tag.alias("tag"))


def store_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, day, refund): a refund's own day lies after its order's."""
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("order_id"), F.date_add(store_day("l_orderkey"), (3 * F.col("l_linenumber")).cast("int")).alias("day"), E.minor(F.col("l_extendedprice")).alias("refund"))


def ad_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ad_id, url): the page of an ad's id; many ads have none."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("ad_id"), "url").dropDuplicates(["ad_id"])
