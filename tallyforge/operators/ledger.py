"""Run bookkeeping, guarded partial writes, gaps and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.operators.merge import merged as deep
from tallyforge.operators.upsert import once
from tallyforge.runtime import sized


def pending(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests whose task has no run that succeeded: a task is run once in effect."""
    return requests.join(log.where("status = 'SUCCEEDED'").select("task_id").distinct(), "task_id", "left_anti")


def health(log: DataFrame) -> DataFrame:
    """(task_id, watermark, status): the watermark moves with successful runs only; a source that brought no rows is not unhealthy."""
    done = F.col("status") == "SUCCEEDED"
    agg = log.groupBy("task_id").agg(F.max(F.when(done, F.col("at"))).alias("watermark"), F.count_if(done).alias("_ok"), F.coalesce(F.sum(F.when(done, F.col("rows"))), F.lit(0)).alias("rows"), F.max_by("status", "at").alias("last"))
    state = F.when(F.col("last") != "SUCCEEDED", "failing").when(F.col("rows") > 0, "healthy").otherwise("no_new_data")
    return agg.select("task_id", "watermark", "rows", state.alias("status"))


def guarded_patch(stored: DataFrame, patches: DataFrame, key: str, version: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(merged, log). A patch is merged, however deep its fields nest, only into the stored row of its own version; what it leaves null keeps its value.

    A key that either side holds twice is an error. The log says WRITTEN, SKIPPED_STALE or MISSING for every patch; a stored row without a version is stale."""
    types = {f.name: f.dataType for f in stored.schema} | {f"_{f.name}": f.dataType for f in patches.schema}
    p = patches.select(F.col(key).alias("_key"), F.col(version).alias("_target"), *[F.col(f).alias(f"_{f}") for f in fields])
    p = once(p, "_key", "patches")
    met = stored.join(p, F.col(key) == F.col("_key"), "left")
    same = F.coalesce(F.col(version) == F.col("_target"), F.lit(False))
    merged = met.select(*[F.when(same, deep(F.col(c), F.col(f"_{c}"), types[c], types[f"_{c}"])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])
    held = once(stored.select(F.col(key).alias("_key"), F.col(version).alias("_stored"), F.lit(True).alias("_held")), "_key", "stored rows")
    log = p.join(held, "_key", "left")
    outcome = F.when(F.col("_held").isNull(), "MISSING").when(F.col("_stored").eqNullSafe(F.col("_target")) & F.col("_stored").isNotNull(), "WRITTEN").otherwise("SKIPPED_STALE")
    return merged, log.select(F.col("_key").alias(key), outcome.alias("outcome"))


def first_seen(stored: DataFrame, incoming: DataFrame, key: str, stamp: str) -> DataFrame:
    """``incoming`` in place of the stored rows, keeping the time each key was first seen."""
    old = stored.select(F.col(key), F.col(stamp).alias("_old"))
    return incoming.join(old, key, "left").withColumn(stamp, F.coalesce("_old", stamp)).drop("_old")


def known_gap(backfilled_through: Column, today: Column, reach: int = CANON.order_window_days) -> tuple[Column, Column]:
    """First and last day (exclusive) that neither the backfill nor the reachable days cover; null if there are none."""
    earliest = F.date_sub(today, reach - 1)
    gap = backfilled_through.isNotNull() & (F.date_add(backfilled_through, 1) < earliest)
    return F.when(gap, F.date_add(backfilled_through, 1)), F.when(gap, earliest)


def active_version(versions: DataFrame, key: str, version: str, active: str) -> DataFrame:
    """(key, version) of the active row of each key; more than one is an error."""
    on = versions.where(F.col(active)).groupBy(key).agg(F.count("*").alias("_n"), F.max(version).alias(version))
    return on.where(F.assert_true(F.col("_n") <= 1, F.lit("more than one active version")).isNull()).select(key, version)


def published(versions: DataFrame, key: str, version: str, active: str) -> DataFrame:
    """``versions`` with the newest of each key active and all others not."""
    from pyspark.sql import Window as W

    return versions.withColumn(active, F.col(version) == F.max(version).over(W.partitionBy(key)))


def overwrite(df: DataFrame, path: str, *parts: str) -> None:
    """Replace the partitions that ``df`` has rows for, whatever they held; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


_RUN = "task_id string, run string, rows long, watermark string"


def commit(spark: SparkSession, path: str, task_id: str, run: str, rows: DataFrame, watermark: str) -> bool:
    """Write what a task brought and the row of its run, so that both are seen together or not at all; False, and nothing
    is written, if a run of the task was committed before.

    ``path`` holds a folder of rows a run and a folder of one log row a task. The log row comes last and readers (``committed``) take only
    runs that have one, so a write that fails, at whatever point, leaves nothing to be seen and no watermark; the next
    run of the task writes its own folder. ``watermark``: the column whose largest value is the run's."""
    if not committed_runs(spark, path).where(F.col("task_id") == task_id).isEmpty():
        return False
    data = f"{path}/data/run={run}"
    rows.write.mode("overwrite").parquet(data)
    n, top = spark.read.schema(rows.schema).parquet(data).agg(F.count("*"), F.max(watermark).cast("string")).first()
    spark.createDataFrame([(task_id, run, n, top)], _RUN).coalesce(1).write.mode("error").parquet(f"{path}/log/task={task_id}")
    return True


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, run, rows, watermark) of every run whose data count."""
    found = spark.createDataFrame([], _RUN)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        found = found.unionByName(spark.read.schema(_RUN).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{path}/log"))
    return found


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows (and their run) of committed runs; folders of other runs are not opened where the runs are few enough to be sent to all tasks."""
    rows = spark.read.schema(f"{schema}, run string").parquet(f"{path}/data")
    return rows.join(sized(committed_runs(spark, path).select("run")), "run", "left_semi")
