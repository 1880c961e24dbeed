"""Session helpers shared by every operator: shared-folder tables, sized broadcasts, column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side with a few fixed-width columns may be broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, a new one is set: in local mode a
    temporary folder, on a cluster one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tf-scratch-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tf-{label}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_written: dict[str, list[str]] = {}
_named: dict[str, list[str]] = {}
#: Spark's setting by which a write removes its own shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """A table that is written needs its shuffle files no more: they go at the end of the write, not when the driver collects garbage."""
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that operators of this application wrote, once their results have been used; how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def table(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    writer = df.write.option("compression", compression) if compression else df.write
    with _tidy(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key``, as many as a shuffle has partitions: joins and
    aggregations by ``key`` then read it in place."""
    spark, name = df.sparkSession, f"tf_{label}_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _named.setdefault(spark.sparkContext.applicationId, []).append(name)
    with _tidy(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", new_path(spark, label)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only if it is known to have at most ``limit`` rows; else the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
