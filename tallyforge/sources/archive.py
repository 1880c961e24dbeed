"""Raw archive of JSON documents, and the entity documents read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = """id string, type string, owner string, daily_budget long, lifetime_budget long, status string, campaign_id string, targeting variant, bid_strategy string, creatives array<string>,
 placements array<string>, creative struct<feed: struct<images: array<struct<hash: string>>, videos: array<struct<hash: string>>, bodies: array<struct<hash: string>>>, hash: string>"""
_PARTS = ("source", "year", "month", "day", "run")


def write(docs: DataFrame, path: str) -> None:
    """Sink of (source, day, run, body): JSON lines in one folder a source, calendar day and run. A run written again replaces its own."""
    day = F.col("day")
    rows = docs.select(F.col("body").alias("value"), "source", F.date_format(day, "yyyy").alias("year"), F.date_format(day, "MM").alias("month"), F.date_format(day, "dd").alias("day"), "run")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).text(path)


def read(spark: SparkSession, path: str, source: str, until_day: str | None = None) -> DataFrame:
    """(day, run, body, file) of a source, up to a day; the folders of other sources and days are not opened."""
    rows = spark.read.schema("value string, source string, year string, month string, day string, run long").text(path).where(F.col("source") == source)
    rows = rows.select(F.to_date(F.concat_ws("-", "year", "month", "day")).alias("day"), "run", F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"))
    return rows if until_day is None else rows.where(F.col("day") <= F.lit(until_day).cast("date"))


def canonical(value: Column) -> Column:
    """A VARIANT as JSON with the keys of every object in order, however deep, so that equal values are equal texts. Lists keep their order; null, and JSON's null, are null."""
    text = F.to_json(value)
    return F.when(text != "null", text)


def canonical_text(text: Column) -> Column:
    """JSON text with the keys of every object in order; null if it is no JSON, or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def entities(rows: DataFrame) -> DataFrame:
    """Entity documents: budgets, canonical targeting, creatives in order, distinct member hashes of a feed, placements only if all are texts."""
    e = rows.withColumn("e", F.from_json("body", ENTITY)).withColumn("_raw", F.get_json_object("body", "$.placements"))
    feed = F.col("e.creative.feed")
    members = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.transform(feed[k], lambda x: x["hash"]), F.array().cast("array<string>")) for k in ("images", "videos", "bodies")]))))
    texts = F.col("_raw").rlike(r'^\[("[^"]*"(,"[^"]*")*)?\]$')
    return e.select(
        F.col("e.id").try_cast("long").alias("entity_id"), F.col("e.type").alias("entity_type"), "day", "run", F.col("e.owner").alias("owner"), F.col("e.daily_budget").alias("daily"), F.col("e.lifetime_budget").alias("lifetime"),
        F.col("e.status").alias("status"), canonical(F.col("e.targeting")).alias("targeting"), F.col("e.bid_strategy").alias("bid_strategy"), F.array_join(F.array_sort(F.col("e.creatives")), ",").alias("creatives"),
        F.when(feed.isNotNull(), "COMPOSITE").when(F.col("e.creative").isNotNull(), "STANDARD").alias("creative_kind"), F.when(feed.isNotNull(), F.array_join(members, ",")).otherwise(F.col("e.creative.hash")).alias("members"),
        F.when(texts, F.array_join("e.placements", ",")).alias("placements"), F.col("e.campaign_id").try_cast("long").alias("parent"),
    )
