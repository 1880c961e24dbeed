"""Domain facts from the driver's tables: ads delivery from ``events``, the store from ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.runtime import documents as read


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ad_id) of every ad that ever had an event; reads that column alone."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("ad_id")).distinct()


def daily(spark: SparkSession, sf_dir: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """One row an ad and day; error rows count as malformed. ``since`` and ``until`` (days, inclusive) reach the scan."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    if since is not None:
        e = e.where(F.col("ts") >= since.cast("timestamp_ntz"))
    if until is not None:
        e = e.where(F.col("ts") < F.date_add(until, 1).cast("timestamp_ntz"))
    kind = F.col("event_type")
    n = lambda *k: F.count_if(kind.isin(*k))
    money = lambda *k: F.coalesce(F.sum(F.when(kind.isin(*k), E.minor(F.col("value")))), F.lit(0)).cast("long")
    return e.groupBy(F.col("user_id").alias("ad_id"), F.to_date("ts").alias("day")).agg(
        n("view").alias("impressions"), n("click").alias("clicks"), n("signup").alias("carts"), n("purchase").alias("purchases"),
        n("error").alias("malformed"), money("view", "click").alias("spend"), money("purchase").alias("purchase_value"),
    )


def levels(ad: str = "ad_id"):
    """The entities an ad belongs to: array of (entity_type, entity_id)."""
    a = F.col(ad)
    of = {"AD": a, "ADSET": F.floor(a / 5), "CAMPAIGN": F.floor(a / 25), "CREATIVE_FAMILY": a % 7, "ACCOUNT": F.lit(0)}
    return F.array(*[F.struct(F.lit(k).alias("entity_type"), v.cast("long").alias("entity_id")) for k, v in of.items()])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), E.minor(F.col("o_totalprice")).alias("gross"))


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return li.select("l_orderkey", F.to_date("l_shipdate").alias("day"), E.minor(F.col("l_extendedprice")).alias("refund"))
