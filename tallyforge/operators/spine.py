"""Windowed features on a spine of entities: delivery and store totals, metric sets, trends, matches of orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E
from tallyforge.sources.dims import LEVELS, levels

COUNTS = ("impressions", "clicks", "landings", "carts", "checkouts", "purchases", "spend", "purchase_value")
STORE = ("orders", "new_orders", "gross", "refunds")


def windows_of(day: str, canon: Canon = CANON) -> Column:
    """The window lengths that hold a day, so that a row is repeated only for windows it is in."""
    age = F.datediff(F.lit(canon.as_of), F.col(day))
    return F.filter(F.array(*map(F.lit, canon.windows)), lambda n: (age >= 0) & (age < n))


def delivery_totals(daily: DataFrame, ads: DataFrame, canon: Canon = CANON, kinds: tuple[str, ...] = LEVELS) -> DataFrame:
    """(entity_type, entity_id, days, measures, attribution): null reach counts as zero; attribution is null where rows disagree."""
    # Summed by ad and window first: the explosion to levels works on ads, not on days.
    by_ad = daily.withColumn("days", F.explode(windows_of("day", canon))).groupBy("ad_id", "days").agg(*[F.sum(c).alias(c) for c in COUNTS], F.coalesce(F.sum("reach"), F.lit(0)).alias("reach"), F.min("attribution").alias("_lo"), F.max("attribution").alias("_hi"))
    spread = by_ad.join(ads, "ad_id").select("*", F.inline(levels(kinds)))
    same = F.when(F.min("_lo") == F.max("_hi"), F.min("_lo")).alias("attribution")
    return spread.groupBy("entity_type", "entity_id", "days").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "reach")], same)


def resolved(orders: DataFrame, ads: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(order_id, resolution, ad_id, campaign_id): by an ad's id, else by a campaign name that only one campaign has.

    Orders whose tag cannot be an id, or a name, stay out of the join that looks for it, so no join meets a null key."""
    tag = F.col("tag")
    number = F.when(tag.rlike(r"^\d{1,18}$"), tag.cast("long"))
    tagged = orders.select("order_id", number.alias("ad_id"), E.normal_name(tag).alias("name"))
    by_id = tagged.where("ad_id IS NOT NULL").join(ads.select("ad_id", "campaign_id"), "ad_id").select("order_id", F.lit("AD_ID").alias("resolution"), "ad_id", "campaign_id")
    unique = campaigns.groupBy(E.normal_name(F.col("name")).alias("name")).agg(F.count("*").alias("n"), F.min("campaign_id").alias("campaign_id")).where("n = 1")
    by_name = tagged.where("ad_id IS NULL AND name IS NOT NULL").join(unique, "name").select("order_id", F.lit("NAME_MATCH").alias("resolution"), F.lit(None).cast("long").alias("ad_id"), "campaign_id")
    return by_id.unionByName(by_name)


def matches(found: DataFrame, ads: DataFrame, kinds: tuple[str, ...] = LEVELS) -> DataFrame:
    """(entity_type, entity_id, order_id): an order once at each entity it counts for; one found by name only at its campaign and the account."""
    by_id = found.where("resolution = 'AD_ID'").select("order_id", "ad_id").join(ads, "ad_id").select("order_id", F.inline(levels(kinds)))
    up = F.array(*[F.struct(F.lit(k).alias("entity_type"), v.cast("long").alias("entity_id")) for k, v in (("CAMPAIGN", F.col("campaign_id")), ("ACCOUNT", F.lit(0))) if k in kinds])
    return by_id.unionByName(found.where("resolution = 'NAME_MATCH'").select("order_id", F.inline(up))) if {"CAMPAIGN", "ACCOUNT"} & set(kinds) else by_id


def store_totals(orders: DataFrame, refunds: DataFrame, matched: DataFrame, canon: Canon = CANON) -> DataFrame:
    """(entity_type, entity_id, days, orders, new_orders, gross, refunds): refunds by their own day, at the entities of
    their order, whose day may lie outside the window; refunds of orders that are not there are left out."""
    sold = orders.select("order_id", "gross", F.coalesce("new_customer", F.lit(False)).alias("new"), F.explode(windows_of("day", canon)).alias("days"))
    back = refunds.join(orders.select("order_id"), "order_id", "left_semi").select("order_id", "refund", F.explode(windows_of("day", canon)).alias("days"))
    key = ["entity_type", "entity_id", "days"]
    a = sold.join(matched, "order_id").groupBy(*key).agg(F.count("*").alias("orders"), F.count_if("new").alias("new_orders"), F.sum("gross").alias("gross"))
    b = back.groupBy("order_id", "days").agg(F.sum("refund").alias("refund")).join(matched, "order_id").groupBy(*key).agg(F.sum("refund").alias("refunds"))
    return a.join(b, key, "full")


def url_kind(url: Column) -> Column:
    return F.when(url.isNull() | (F.trim(url) == ""), "NO_URL").when(url.rlike(r"\{\{(ad|campaign)\.id\}\}"), "ID_MACRO").when(url.rlike(r"\{\{(ad|campaign)\.name\}\}"), "NAME_MACRO").when(url.rlike(r"[?&]ref="), "STATIC_TEXT").otherwise("MISSING")


def totals_on_spine(spine: DataFrame, delivery: DataFrame, store: DataFrame, canon: Canon = CANON) -> DataFrame:
    """Every entity and window, zeros where nothing happened."""
    key = ["entity_type", "entity_id", "days"]
    base = spine.withColumn("days", F.explode(F.array(*map(F.lit, canon.windows))))
    rows = base.join(delivery, key, "left").join(store, key, "left")
    return rows.select(*key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "reach", *STORE)], "attribution")


def metric_set(totals: DataFrame, urls: DataFrame) -> DataFrame:
    """Totals and their ratios, null where the divisor is zero. An ad whose address cannot carry its id has no store numbers."""
    r = lambda a, b, k=1.0: E.rounded(E.ratio(a * k, b), 6)
    c = F.col
    net = c("gross") - c("refunds")
    blind = (c("entity_type") == "AD") & url_kind(c("url")).isin("NO_URL", "MISSING")
    told = lambda x, name: F.when(~blind, x).alias(name)
    rows = totals.join(urls.withColumnRenamed("ad_id", "entity_id").withColumn("entity_type", F.lit("AD")), ["entity_type", "entity_id"], "left")
    return rows.select(
        "entity_type", "entity_id", "days", *COUNTS, "reach", "attribution",
        r(c("impressions"), c("reach")).alias("frequency"), r(c("spend"), c("impressions"), 1000.0).alias("cpm"), r(c("clicks"), c("impressions")).alias("ctr"), r(c("spend"), c("clicks")).alias("cpc"),
        r(c("purchases"), c("clicks")).alias("cvr"), r(c("carts"), c("landings")).alias("cart_rate"), r(c("checkouts"), c("carts")).alias("checkout_rate"), r(c("purchases"), c("checkouts")).alias("purchase_rate"),
        r(c("purchase_value"), c("spend")).alias("roas"), r(c("spend"), c("purchases")).alias("cpa"),
        *[told(c(x), f"store_{x}") for x in STORE], told(net, "store_net"), told(r(c("gross"), c("spend")), "store_roas"), told(r(c("gross"), c("orders")), "store_aov"),
        told(r(c("new_orders"), c("orders")), "store_new_share"), told(r(c("spend"), c("new_orders")), "store_new_cpa"), told(r(c("refunds"), c("gross")), "store_refund_rate"), told(net - c("spend"), "store_margin"),
    )


def trends(daily: DataFrame, ads: DataFrame, canon: Canon = CANON) -> DataFrame:
    """Eight metrics of the last seven days against the seven before: both values, the change and its category."""
    age = F.datediff(F.lit(canon.as_of), F.col("day"))
    rows = daily.where(age.between(0, 13)).join(ads, "ad_id").select(F.inline(levels()), (age < 7).alias("now"), *COUNTS)
    both = rows.groupBy("entity_type", "entity_id").agg(*[F.coalesce(F.sum(F.when(F.col("now") == now, F.col(x))), F.lit(0)).alias(f"{x}_{side}") for x in COUNTS for side, now in (("now", True), ("before", False))])
    of = {
        "spend": lambda s: F.col(f"spend_{s}").cast("double"), "impressions": lambda s: F.col(f"impressions_{s}").cast("double"), "clicks": lambda s: F.col(f"clicks_{s}").cast("double"),
        "purchases": lambda s: F.col(f"purchases_{s}").cast("double"), "purchase_value": lambda s: F.col(f"purchase_value_{s}").cast("double"),
        "roas": lambda s: E.ratio(F.col(f"purchase_value_{s}"), F.col(f"spend_{s}")), "cpa": lambda s: E.ratio(F.col(f"spend_{s}"), F.col(f"purchases_{s}")), "ctr": lambda s: E.ratio(F.col(f"clicks_{s}"), F.col(f"impressions_{s}")),
    }
    rows = both.select("entity_type", "entity_id", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), f("now").alias("now"), f("before").alias("before")) for k, f in of.items()])))
    change = E.percent_change(F.col("now"), F.col("before"))
    r6 = lambda x: E.rounded(x, 6)
    return rows.select("entity_type", "entity_id", "metric", r6(F.col("now")).alias("current"), r6(F.col("before")).alias("previous"), r6(change).alias("percent"), E.trend(change).alias("trend"))


def scaled_interval(value: Column, n: Column, z: float, increasing: bool) -> tuple[Column, Column]:
    """The interval of a metric that grows with the count (as ROAS), or falls with it (as CPA)."""
    low, high = E.poisson_interval(n, z)
    return (value * low / n, value * high / n) if increasing else (value * n / high, value * n / low)
