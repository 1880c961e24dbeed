"""Setting snapshots of campaigns, ad sets and ads from their documents, and the run that each run is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = ("owner", "daily", "lifetime", "status", "targeting", "bid_strategy", "creatives")


def owned(own: Column, daily: Column, lifetime: Column) -> list[Column]:
    """Owner and budgets: the budgets are kept only where the unit itself owns them."""
    kept = own.isin("CAMPAIGN", "ADSET")
    return [own.alias("owner"), F.when(kept, daily).alias("daily"), F.when(kept, lifetime).alias("lifetime")]


def built(documents: DataFrame) -> DataFrame:
    """(entity_type, entity_id, run, day, FIELDS) from documents of the same columns with entity_type and parent.

    A campaign owns its budget if it has one; without one, its ad sets own theirs (null) if any has one, else it is UNKNOWN. An
    ad set owns its budget if its campaign has none, has none (null) under a campaign with one, and is UNKNOWN otherwise.
    Targeting and bids are an ad set's or campaign's, creatives an ad's; an ad set whose campaign is missing has no campaign budget above it."""
    has = F.col("daily").isNotNull() | F.col("lifetime").isNotNull()
    camps, sets, ads = (documents.where(F.col("entity_type") == k) for k in ("CAMPAIGN", "ADSET", "AD"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    key = ["entity_type", "entity_id", "run", "day"]
    kids = sets.groupBy(F.col("parent").alias("entity_id"), "run").agg(F.count_if(has).alias("_owning"))
    own = F.when(has, "CAMPAIGN").when(F.coalesce("_owning", F.lit(0)) == 0, "UNKNOWN")
    a = camps.join(kids, ["entity_id", "run"], "left").select(*key, *owned(own, F.col("daily"), F.col("lifetime")), "status", *none("string", "targeting"), "bid_strategy", *none("string", "creatives"))
    above = camps.select(F.col("entity_id").alias("parent"), "run", has.alias("_above"))
    top = F.coalesce("_above", F.lit(False))
    own = F.when(top & ~has, F.lit(None).cast("string")).when(~top & has, "ADSET").otherwise("UNKNOWN")
    b = sets.join(above, ["parent", "run"], "left").select(*key, *owned(own, F.col("daily"), F.col("lifetime")), "status", "targeting", "bid_strategy", *none("string", "creatives"))
    c = ads.select(*key, *none("string", "owner"), *none("long", "daily", "lifetime"), "status", *none("string", "targeting", "bid_strategy"), F.coalesce("creatives", F.lit("")).alias("creatives"))
    return a.unionByName(b).unionByName(c)


def previous_runs(log: DataFrame) -> DataFrame:
    """(entity_type, run, previous): each finished run and the latest one that finished before it. Runs that failed or still
    go on are not there, neither as a run nor as the one before. ``log``: entity_type, run, status, finished_at; one row a run."""
    done = log.where("status = 'SUCCEEDED' AND finished_at IS NOT NULL")
    before = F.lag("run").over(W.partitionBy("entity_type").orderBy("finished_at", "run"))
    return done.select("entity_type", "run", before.alias("previous"))


def keyed(snapshots: DataFrame) -> DataFrame:
    """``snapshots``, an error where a row's ``snapshot_key`` names another entity or run than its columns."""
    if "snapshot_key" not in snapshots.columns:
        return snapshots
    own = F.concat_ws("_", "entity_type", F.col("entity_id").cast("string"), F.col("run").cast("string"))
    same = F.assert_true(F.col("snapshot_key") == own, F.concat(F.lit("snapshot key of another entity: "), F.coalesce("snapshot_key", F.lit("none"))))
    return snapshots.where(same.isNull())
