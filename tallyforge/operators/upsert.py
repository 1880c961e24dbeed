"""Version-guarded upsert: a newer or equal version replaces, an older one is rejected and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.runtime import new_path, table

BUCKET = "bucket"


def once(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, an error where a key occurs more than once (null counts as a key)."""
    n = F.count("*").over(W.partitionBy(key))
    alone = F.assert_true(F.col("_n") <= 1, F.concat(F.lit(f"repeated key in the {what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.withColumn("_n", n).where(alone.isNull()).drop("_n")


def version_guard(target: DataFrame, incoming: DataFrame, key: str, version: str, arrival: str) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected). Among equal versions the last arrival wins; ``arrival`` orders incoming rows. A key that the target holds twice is an error."""
    ranked = incoming.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version), F.desc(arrival))))
    current = once(target.select(key, F.col(version).alias("_current")), key, "target")
    met = ranked.join(current, key, "left")
    accepted = met.where((F.col("_r") == 1) & (F.col("_current").isNull() | (F.col(version) >= F.col("_current")))).drop("_r", "_current")
    rejected = met.where((F.col("_r") > 1) | (F.col(version) < F.col("_current"))).drop("_r")
    merged = target.join(accepted.select(key), key, "left_anti").unionByName(accepted, allowMissingColumns=True)
    return merged, rejected


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(rows: DataFrame, key: str, buckets: int, path: str | None = None) -> str:
    """Write ``rows`` in folders by bucket of ``key``; the path."""
    path = path or new_path(rows.sparkSession, "store")
    rows.withColumn(BUCKET, bucket_of(key, buckets)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return path


def apply(spark: SparkSession, path: str, incoming: DataFrame, key: str, version: str, arrival: str, buckets: int) -> DataFrame:
    """Upsert ``incoming`` into the folders of ``path`` and return what was rejected. Only buckets that incoming rows fall in are read and
    replaced (at most ``buckets`` numbers come to the driver); what replaces them is complete before the first is touched."""
    rows = table(incoming.withColumn(BUCKET, bucket_of(key, buckets)), "incoming")
    touched = [r[BUCKET] for r in rows.select(BUCKET).distinct().collect()]
    stored = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)) if touched else spark.read.parquet(path).limit(0)
    merged, rejected = version_guard(stored, rows, key, version, arrival)
    out, refused = table(merged.select(*stored.columns), "merged"), table(rejected.drop(BUCKET), "rejected")
    if touched:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return refused
