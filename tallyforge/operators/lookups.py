"""Questions about entities as a table of requests (request_id, entity_type, entity_id, days), answered together.

Requests reduce dimensions, facts and matches by semi-joins before anything is summed, so an answer costs what it asks for. Every
request gets a row; one about an entity that is not there says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CANON, Canon
from tallyforge.functions import exprs as E
from tallyforge.operators.spine import COUNTS
from tallyforge.runtime import sized
from tallyforge.sources.dims import levels

KEY = ["entity_type", "entity_id"]


def members(requests: DataFrame, ads: DataFrame) -> DataFrame:
    """(request_id, days, ad_id): the ads that each request is about."""
    return ads.select("ad_id", F.inline(levels())).join(sized(requests), KEY).select("request_id", "days", "ad_id")


def performance(requests: DataFrame, ads: DataFrame, delivery: Callable[[DataFrame], DataFrame], orders: DataFrame, refunds: DataFrame, matched: Callable[[DataFrame], DataFrame], canon: Canon = CANON) -> DataFrame:
    """Delivery and matched store numbers of each request's entity and window. ``delivery(only)`` gives the facts of the ads in
    ``only`` and ``matched(orders)`` (entity_type, entity_id, order_id) of some orders; orders and refunds are cut to the days asked for first."""
    asked = members(requests, ads)
    age = lambda day: F.datediff(F.lit(canon.as_of), F.col(day))
    inside = lambda day: age(day).between(0, F.col("days") - 1)
    measures = (*COUNTS, "reach")
    sums = delivery(asked.select("ad_id")).join(asked, "ad_id").where(inside("day")).groupBy("request_id").agg(*[F.sum(m).alias(m) for m in measures])
    wanted = matched(orders).join(sized(requests), KEY).select("request_id", "days", "order_id")
    sold = orders.where(age("day").between(0, max(canon.windows) - 1)).join(wanted, "order_id").where(inside("day")).groupBy("request_id").agg(F.count("*").alias("orders"), F.sum("gross").alias("gross"))
    back = refunds.where(age("day").between(0, max(canon.windows) - 1)).join(wanted, "order_id").where(inside("day")).groupBy("request_id").agg(F.sum("refund").alias("refunds"))
    known = asked.select("request_id").distinct().withColumn("found", F.lit(True))
    rows = requests.join(known, "request_id", "left").join(sums, "request_id", "left").join(sold, "request_id", "left").join(back, "request_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = rows.select("request_id", *KEY, "days", F.coalesce("found", F.lit(False)).alias("found"), *[n(c) for c in (*measures, "orders", "gross", "refunds")])
    r = lambda a, b: E.rounded(E.ratio(F.col(a), F.col(b)), 6)
    return rows.select("*", ((F.col("spend") > 0) | (F.col("impressions") > 0)).alias("delivering"), r("impressions", "reach").alias("frequency"), r("purchase_value", "spend").alias("roas"), r("spend", "purchases").alias("cpa"), r("gross", "spend").alias("store_roas"))


def recent_changes(requests: DataFrame, events: DataFrame) -> DataFrame:
    """How often and when last each kind of setting of the request's entity changed, and the last budget's percent."""
    own = events.join(sized(requests.select(*KEY).distinct()), KEY)
    is_ = lambda f: F.col("field") == f
    fields = ("BUDGET", "STATUS", "TARGETING", "BID_STRATEGY", "CREATIVE_ASSIGNMENT")
    per = own.groupBy(*KEY).agg(*[F.count_if(is_(f)).alias(f"{f.lower()}_changes") for f in fields], *[F.max(F.when(is_(f), F.col("detected_on"))).alias(f"last_{f.lower()}") for f in fields], F.max_by(F.when(is_("BUDGET"), F.col("percent")), F.when(is_("BUDGET"), F.col("run"))).alias("last_budget_percent"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return requests.join(per, KEY, "left").select("request_id", *KEY, *[zero(f"{f.lower()}_changes") for f in fields], *[f"last_{f.lower()}" for f in fields], "last_budget_percent")


def budget_owner(requests: DataFrame, snapshots: DataFrame, ads: DataFrame) -> DataFrame:
    """(request_id, KEY, unit_type, unit_id, daily, lifetime, escalated): the unit that owns the budget of each request's entity.

    An ad asks its ad set. An ad set owns its own, or passes to its campaign; a campaign owns its own, or passes to its only
    ad set that owns one. Whatever is unknown, or missing, has no unit. ``snapshots``: settings of one run."""
    sets = snapshots.where("entity_type = 'ADSET'").select(F.col("entity_id").alias("adset_id"), F.col("owner").alias("s_owner"), F.col("daily").alias("s_daily"), F.col("lifetime").alias("s_lifetime"))
    camps = snapshots.where("entity_type = 'CAMPAIGN'").select(F.col("entity_id").alias("campaign_id"), F.col("owner").alias("c_owner"), F.col("daily").alias("c_daily"), F.col("lifetime").alias("c_lifetime"))
    chain = ads.select("adset_id", "campaign_id").distinct()
    own = F.col("s_owner") == "ADSET"
    kids = sets.where(own).join(chain, "adset_id").groupBy("campaign_id").agg(F.count("*").alias("_kids"), F.min(F.struct("adset_id", "s_daily", "s_lifetime")).alias("_kid"))
    set_of = F.when(F.col("entity_type") == "ADSET", F.col("entity_id")).when(F.col("entity_type") == "AD", F.col("_adset"))
    asked = requests.join(ads.select(F.col("ad_id").alias("entity_id"), F.lit("AD").alias("entity_type"), F.col("adset_id").alias("_adset")).join(sized(requests.select(*KEY).distinct()), KEY, "left_semi"), KEY, "left").withColumn("adset_id", set_of)
    rows = asked.join(chain.withColumnRenamed("campaign_id", "_campaign"), "adset_id", "left").withColumn("campaign_id", F.when(F.col("entity_type") == "CAMPAIGN", F.col("entity_id")).otherwise(F.col("_campaign")))
    rows = rows.join(sets, "adset_id", "left").join(camps, "campaign_id", "left").join(kids, "campaign_id", "left")
    camp = F.col("entity_type") == "CAMPAIGN"
    c_own = F.col("c_owner") == "CAMPAIGN"
    # A null owner below means the level above, above it the level below; UNKNOWN means neither.
    unit = lambda kind, i, a, b: F.struct(F.lit(kind).alias("type"), i.alias("id"), a.alias("daily"), b.alias("lifetime"))
    top, low = unit("CAMPAIGN", F.col("campaign_id"), F.col("c_daily"), F.col("c_lifetime")), unit("ADSET", F.col("adset_id"), F.col("s_daily"), F.col("s_lifetime"))
    kid = unit("ADSET", F.col("_kid.adset_id"), F.col("_kid.s_daily"), F.col("_kid.s_lifetime"))
    there = lambda c: F.col(c).isNotNull()
    of_set = F.when(own, low).when(F.col("s_owner").isNull() & c_own & there("adset_id"), top)
    found = F.when(camp, F.when(c_own, top).when(F.col("c_owner").isNull() & (F.col("_kids") == 1), kid)).otherwise(of_set)
    rows = rows.withColumn("_unit", found)
    return rows.select("request_id", *KEY, F.col("_unit.type").alias("unit_type"), F.col("_unit.id").alias("unit_id"), F.col("_unit.daily").alias("daily"), F.col("_unit.lifetime").alias("lifetime"), F.coalesce((F.col("_unit.type") != F.col("entity_type")), F.lit(False)).alias("escalated"))


def campaign_context(requests: DataFrame, snapshots: DataFrame, ads: DataFrame, active: Column) -> DataFrame:
    """Status and owner of each requested campaign, and its ad sets and ads, all and active (``active``: a test of a snapshot)."""
    asked = requests.where("entity_type = 'CAMPAIGN'").select("request_id", F.col("entity_id").alias("campaign_id"))
    chain = ads.select("ad_id", "adset_id", "campaign_id").join(sized(asked.select("campaign_id").distinct()), "campaign_id", "left_semi")
    state = lambda kind, name: snapshots.where(F.col("entity_type") == kind).select(F.col("entity_id").alias(name), active.alias(f"_{name}"))
    on = lambda c: F.coalesce(f"_{c}", F.lit(False))
    rows = chain.join(state("AD", "ad_id"), "ad_id", "left").join(state("ADSET", "adset_id"), "adset_id", "left")
    n = rows.groupBy("campaign_id").agg(F.count("*").alias("ads"), F.count_if(on("ad_id")).alias("ads_active"), F.count_distinct("adset_id").alias("adsets"), F.count_distinct(F.when(on("adset_id"), F.col("adset_id"))).alias("adsets_active"))
    camps = snapshots.where("entity_type = 'CAMPAIGN'").select(F.col("entity_id").alias("campaign_id"), "status", "owner")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(camps, "campaign_id", "left").join(n, "campaign_id", "left").select("request_id", "campaign_id", "status", F.coalesce(F.col("owner") == "CAMPAIGN", F.lit(False)).alias("owns_budget"), *[zero(c) for c in ("adsets", "adsets_active", "ads", "ads_active")])


def product_mix(windows: DataFrame, orders: DataFrame, lines: DataFrame, canon: Canon = CANON) -> DataFrame:
    """(days, product_type, orders, quantity, revenue) of the account for each window length in ``windows`` (days). Orders are cut to the longest
    window before their lines are looked up; a line is repeated only for the windows it is in."""
    age = F.datediff(F.lit(canon.as_of), F.col("day"))
    inside = orders.where(age.between(0, max(canon.windows) - 1)).select("order_id", age.alias("_age"))
    asked = sized(windows.select("days").distinct())
    rows = lines.join(inside, "order_id").join(asked, F.col("_age") < F.col("days"))
    return rows.groupBy("days", "product_type").agg(F.count_distinct("order_id").alias("orders"), F.sum("quantity").cast("long").alias("quantity"), F.sum("revenue").cast("long").alias("revenue"))


def by_name(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(q, kind, id, name): entities whose name holds a term, letters' case aside. ``terms``: q, term; ``entities``: kind, id, name.

    Names are indexed by their runs of up to three characters: a term is looked up by its first such run, and only those that meet are compared.
    Empty terms find nothing."""
    asked = terms.select("q", F.lower("term").alias("_term")).where("_term <> ''").withColumn("_gram", F.substring("_term", 1, 3))
    sizes = sorted(r[0] for r in asked.select(F.char_length("_gram")).distinct().collect())  # at most 1, 2 and 3
    low = F.lower("name")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    runs = [grams(n) for n in sizes]
    index = entities.where("name IS NOT NULL").select("kind", "id", "name", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<string>"))).alias("_gram"))
    return index.join(sized(asked), "_gram").where(F.contains(F.lower("name"), F.col("_term"))).select("q", "kind", "id", "name").distinct()


def attribution_health(windows: DataFrame, orders: DataFrame, resolved: DataFrame, canon: Canon = CANON) -> DataFrame:
    """(days, by_id, by_name, unresolved, coverage): how the orders of each window length in ``windows`` (days) were told apart; the share found by id."""
    age = F.datediff(F.lit(canon.as_of), F.col("day"))
    rows = orders.where(age.between(0, max(canon.windows) - 1)).select("order_id", age.alias("_age")).join(resolved.select("order_id", "resolution"), "order_id", "left")
    per = rows.groupBy("_age").agg(F.count_if(F.col("resolution") == "AD_ID").alias("a"), F.count_if(F.col("resolution") == "NAME_MATCH").alias("b"), F.count_if(F.col("resolution").isNull()).alias("c"))
    # A row a day is left before windows multiply it.
    asked = windows.select("days").distinct()
    total = asked.join(sized(per), F.col("_age") < F.col("days"), "left").groupBy("days").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("a", "by_id"), ("b", "by_name"), ("c", "unresolved"))])
    return total.select("*", E.rounded(E.ratio(F.col("by_id"), F.col("by_id") + F.col("by_name") + F.col("unresolved")), 6).alias("coverage"))


def creative_fatigue(requests: DataFrame, ads: DataFrame, composite: Column) -> DataFrame:
    """The creative family of each requested ad, how many variations it has, and whether a fatigue score may be given at all: not to composites,
    whose delivered mix is unknown. An ad that is not there has no family."""
    asked = requests.where("entity_type = 'AD'").select("request_id", F.col("entity_id").alias("ad_id"))
    own = asked.join(ads.select("ad_id", "family_id"), "ad_id", "left")
    n = ads.join(sized(own.select("family_id").distinct()), "family_id", "left_semi").groupBy("family_id").agg(F.count("*").alias("variations"))
    kind = F.when(F.col("family_id").isNotNull(), F.when(composite, "COMPOSITE").otherwise("STANDARD"))
    return own.join(sized(n), "family_id", "left").select("request_id", "ad_id", F.col("family_id").isNotNull().alias("applicable"), "family_id", kind.alias("creative_type"), F.coalesce(kind == "STANDARD", F.lit(False)).alias("eligible"), "variations")
