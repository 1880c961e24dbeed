"""A stream of versioned rows, judged against keyed state: the highest version of every key that has come so far.

State holds one version and one arrival a key, so it grows with keys, not with rows or batches. Each batch's
accepted and rejected rows are appended under the batch's number, so a batch that runs again overwrites its own; nothing that was
written before is read or written again. Rows that come late, however late, are judged and logged, never dropped. With the same
folder a later call goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType, TimestampType

from tallyforge.runtime import new_path

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Guard(StatefulProcessor):
    """Marks each row of a key as accepted or not. Of a batch's rows the one of highest version (then last arrival) is held against
    the version kept so far; a version at least as high is accepted. ``immutable``: the first row of a key stays, all others are rejected.

    Plain rows, since most keys bring few: building pandas frames for a key cost far more than judging it."""

    def __init__(self, version: str, arrival: str, schema: StructType, immutable: bool = False):
        self.version, self.arrival, self.schema, self.immutable = schema.names.index(version), schema.names.index(arrival), schema, immutable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", StructType([self.schema[self.version]]))
        self.told = Row(*self.schema.names, "accepted", "kept_version")
        self.zoned = isinstance(self.schema[self.version].dataType, TimestampType)

    def beats(self, a: Row, b: Row) -> bool:
        """Whether ``a``, which came after ``b``, takes its place; rows without a version lose to those with one, and the first of them stays."""
        (x, i), (y, j) = ((None if r[self.version] != r[self.version] else r[self.version], r[self.arrival]) for r in (a, b))
        if x is None or y is None:
            return x is not None or (y is None and i is not None and (j is None or i < j))
        if self.immutable:
            return x < y or (x == y and i is not None and (j is None or i < j))
        return x > y or (x == y and j is not None and (i is None or i > j))

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.kept.get()
        kept = held[0] if held is not None else None
        # Rows bring instants with their zone, state gives them back in the local one.
        kept = kept.astimezone(timezone.utc) if kept is not None and self.zoned else kept
        # Losers leave at once, so one row is held.
        best = None
        for row in rows:
            if best is None:
                best = row
                continue
            loser, best = (best, row) if self.beats(row, best) else (row, best)
            yield self.told(*loser, False, kept)
        if best is None:
            return
        now = None if best[self.version] != best[self.version] else best[self.version]
        fine = kept is None or (not self.immutable and now is not None and now >= kept)
        yield self.told(*best, fine, kept)
        if fine:
            self.kept.update((now,))

    def close(self) -> None:
        pass


def guarded(rows: DataFrame, key: str, version: str, arrival: str, immutable: bool = False) -> DataFrame:
    """A stream of ``rows`` with ``accepted`` and ``kept_version`` (the version kept before the batch)."""
    out = StructType(list(rows.schema.fields)).add("accepted", BooleanType()).add("kept_version", rows.schema[version].dataType)
    return rows.groupBy(key).transformWithState(Guard(version, arrival, rows.schema, immutable), outputStructType=out, outputMode="Append", timeMode="None")


def run(spark: SparkSession, source: str, key: str, event_id: str, ts: str, folder: str | None = None, immutable: bool = False, columns: tuple[str, ...] | None = None) -> str:
    """Judge all files of ``source`` that are there now; null keys are left out. The folder with ``accepted`` and ``rejected``, of all
    ``columns`` (key, event_id and ts among them)."""
    folder = folder or new_path(spark, "stream")
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).where(F.col(key).isNotNull()).select(*(columns or "*"))

    def keep(batch: DataFrame, number: int) -> None:
        # A row that a batch holds twice counts once.
        once = W.partitionBy(event_id).orderBy(F.desc("accepted"))
        rows = batch.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
        rows.write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/judged/batch={number}")

    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = guarded(rows, key, ts, event_id, immutable).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held) if held else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return folder


def latest_of_stream(spark: SparkSession, source: str, key: str, event_id: str, ts: str, folder: str | None = None, immutable: bool = False, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The latest row of each key after all files of ``source`` that are there now: the last one accepted."""
    folder = run(spark, source, key, event_id, ts, folder, immutable, columns)
    found = spark.read.parquet(f"{folder}/judged").where("CAST(accepted AS boolean)")
    last = W.partitionBy(key).orderBy(F.desc("batch"))
    return found.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "batch", "accepted", "kept_version")


def rejected_of_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The log: rejected rows with the version that was kept before their batch (null if there was none) and the batch."""
    return spark.read.parquet(f"{folder}/judged").where("NOT CAST(accepted AS boolean)").drop("accepted")
