"""Deep merges, guarded writes, buckets, committed runs and keyed stream state."""

from __future__ import annotations

import tempfile
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.operators import ledger, merge, upsert
from tallyforge.streaming import latest


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_deep_merge_keeps_siblings_at_every_depth(spark):
    old = spark.createDataFrame([(1, '{"w":{"a":{"x":1,"y":2},"b":5},"m":{"k":{"p":1},"l":{"p":2}},"t":[1,2]}'), (2, None), (3, '{"w":{"a":{"x":1}}}')], "id long, j string")
    new = spark.createDataFrame([(1, '{"w":{"a":{"y":9},"c":7},"m":{"k":{"q":3},"n":{"p":4}},"t":[3]}'), (2, '{"w":{"a":{"y":1}}}'), (3, None)], "id long, j string")
    a = old.select("id", F.from_json("j", "w struct<a: struct<x: int, y: int>, b: int>, m map<string, struct<p: int, q: int>>, t array<int>").alias("o"))
    b = new.select(F.col("id").alias("_id"), F.from_json("j", "w struct<a: struct<y: int>, c: int>, m map<string, struct<p: int, q: int>>, t array<int>").alias("n"))
    both = a.join(b, F.col("id") == F.col("_id"))
    got = {r["id"]: r["v"] for r in both.select("id", F.to_json(merge.merged(F.col("o"), F.col("n"), a.schema["o"].dataType, b.schema["n"].dataType)).alias("v")).collect()}
    assert got[1] == '{"w":{"a":{"x":1,"y":9},"b":5,"c":7},"m":{"k":{"p":1,"q":3},"l":{"p":2},"n":{"p":4}},"t":[3]}'
    assert got[2] == '{"w":{"a":{"y":1}}}' and got[3] == '{"w":{"a":{"x":1}}}'


def test_patches_of_nested_fields_and_versions(spark):
    stored = spark.createDataFrame([(1, 2, ((1, 2), "s")), (2, None, ((3, 4), "t")), (3, 5, None)], "id long, v long, w struct<a: struct<x: int, y: int>, b: string>")
    patches = spark.createDataFrame([(1, 2, ((9,),)), (2, 2, ((9,),)), (3, 5, ((7,),)), (4, 1, ((7,),))], "id long, v long, w struct<a: struct<y: int>>")
    merged, log = ledger.guarded_patch(stored, patches, "id", "v", ("w",))
    assert {r["id"]: r["w"] and (r["w"]["a"]["x"], r["w"]["a"]["y"], r["w"]["b"]) for r in merged.collect()} == {1: (1, 9, "s"), 2: (3, 4, "t"), 3: (None, 7, None)}
    assert dict(map(tuple, log.collect())) == {1: "WRITTEN", 2: "SKIPPED_STALE", 3: "WRITTEN", 4: "MISSING"}
    with pytest.raises(Exception, match="repeated key in the patches"):
        ledger.guarded_patch(stored, patches.union(patches), "id", "v", ("w",))[0].collect()
    with pytest.raises(Exception, match="repeated key in the stored"):
        ledger.guarded_patch(stored.union(stored), patches, "id", "v", ("w",))[1].collect()


def test_a_target_that_repeats_a_key_is_an_error(spark):
    target, new = spark.createDataFrame([(1, 1, 0), (1, 1, 0)], "k int, v int, a int"), spark.createDataFrame([(1, 2, 1)], "k int, v int, a int")
    with pytest.raises(Exception, match="repeated key in the target"):
        upsert.version_guard(target, new, "k", "v", "a")[0].collect()


def test_only_touched_buckets_are_replaced(spark):
    import os

    rows = spark.createDataFrame([(i, 1, 0) for i in range(40)], "k long, v long, a long")
    path = upsert.create(rows, "k", 8)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    refused = upsert.apply(spark, path, spark.createDataFrame([(3, 2, 1), (3, 3, 2), (5, 0, 3)], "k long, v long, a long"), "k", "v", "a", 8)
    assert sorted((r["k"], r["v"]) for r in refused.collect()) == [(3, 2), (5, 0)]
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 40 and got[3] == 3 and got[5] == 1
    touched = {r["b"] for r in rows.where("k IN (3, 5)").select(upsert.bucket_of("k", 8).alias("b")).collect()}
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept <= files() and not (before - kept) & files()
    upsert.apply(spark, path, rows.limit(0), "k", "v", "a", 8)
    assert spark.read.parquet(path).count() == 40


def test_rows_and_their_run_are_seen_together(spark):
    path = folder()
    schema = "x long, day date"
    rows = spark.createDataFrame([(1, date(2025, 1, 1)), (2, date(2025, 1, 3))], schema)
    assert ledger.committed_runs(spark, path).count() == 0
    assert ledger.commit(spark, path, "t1", "r1", rows, "day")
    bad = rows.withColumn("x", F.when(F.col("x") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("long"))
    with pytest.raises(PySparkException):
        ledger.commit(spark, path, "t2", "r2", bad, "day")
    # The rows are there, the log row is not: a crash between the two.
    rows.write.parquet(f"{path}/data/run=r3")
    assert ledger.committed(spark, path, schema).count() == 2
    assert [tuple(r) for r in ledger.committed_runs(spark, path).collect()] == [("t1", "r1", 2, "2025-01-03")]
    assert not ledger.commit(spark, path, "t1", "r9", rows, "day") and ledger.committed(spark, path, schema).count() == 2
    assert ledger.commit(spark, path, "t2", "r2", rows, "day") and ledger.committed(spark, path, schema).count() == 4
    empty = rows.limit(0)
    assert ledger.commit(spark, path, "t4", "r4", empty, "day")
    assert {(r["task_id"], r["rows"], r["watermark"]) for r in ledger.committed_runs(spark, path).collect()} == {("t1", 2, "2025-01-03"), ("t2", 2, "2025-01-03"), ("t4", 0, None)}


def test_immutable_rows_and_state_that_follows_keys(spark):
    source, home = folder(), folder()
    at = lambda d: datetime(2024, 1, d)
    put = lambda rows: spark.createDataFrame(rows, "k long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    put([(1, 10, at(5)), (1, 11, at(3)), (2, 12, at(1))])
    read = lambda: {r["k"]: r["event_id"] for r in latest.latest_of_stream(spark, source, "k", "event_id", "ts", home, immutable=True).collect()}
    assert read() == {1: 11, 2: 12}
    put([(1, 20, at(9)), (2, 21, at(1)), (3, 22, at(2))])
    assert read() == {1: 11, 2: 12, 3: 22}
    log = sorted((r["event_id"], r["batch"], r["kept_version"]) for r in latest.rejected_of_stream(spark, home).collect())
    assert log == [(10, 0, None), (20, 1, at(3)), (21, 1, at(1))]


def test_versions_without_a_value_lose_to_those_with_one(spark):
    source, home = folder(), folder()
    put = lambda rows: spark.createDataFrame(rows, "k long, event_id long, ts long").coalesce(1).write.mode("append").parquet(source)
    put([(1, 1, None), (2, 2, None), (2, 3, 7)])
    read = lambda: {r["k"]: r["event_id"] for r in latest.latest_of_stream(spark, source, "k", "event_id", "ts", home).collect()}
    assert read() == {1: 1, 2: 3}
    put([(1, 4, 5), (2, 5, None), (2, 6, 7)])
    assert read() == {1: 4, 2: 6}
