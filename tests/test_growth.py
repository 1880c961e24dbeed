"""What larger tables need of a plan: no text is shuffled, nothing is read or computed twice; results on small inputs beside it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from tallyforge.plans import entities, timeline
from tallyforge.sources import csvsplit, intake, orders
from tallyforge.streaming import latest


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df: DataFrame) -> int:
    text = plan(df)
    return text.count("Exchange") - text.count("BroadcastExchange")


def folder(text: str) -> str:
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{path}/a.csv", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_records_of_csv_blocks_are_joined_without_moving_text(spark):
    text = 'id,name\n1,"two\nlines ""x"""\r\n\n2,plain\n3,"' + "long\n" * 60 + '"\n4,"open\nand shut"\n'
    want = ['1,"two\nlines ""x"""', "2,plain", '3,"' + "long\n" * 60 + '"', '4,"open\nand shut"']
    path = folder(text)
    assert shuffles(csvsplit.records(spark, path)) == 0
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, rows in (("40b", "2"), ("150b", "1"), ("1m", "3")):
            for c, v in zip(held, (size, "16", rows), strict=True):
                spark.conf.set(c, v)
            assert sorted(r[0] for r in csvsplit.records(spark, path).collect()) == want
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_an_export_is_parsed_once(spark):
    head = ",".join(["Row", *orders.EXPORT])
    values = {"Row": "1", "ID": "5", "Created At": "2025-01-01 00:00:00 +0530", "Price: Total": "1.50", "Price: Subtotal": "1.00", "Price: Total Discount": "0"}
    path = folder(head + "\n" + ",".join(values.get(c, "") for c in ["Row", *orders.EXPORT]) + "\n")
    for part in orders.export_orders(orders.export(spark, path)):
        assert "FileScan text" not in plan(part) and shuffles(part) == 0


def test_orders_of_a_csv_are_grouped_in_place(spark):
    path = folder('Row,ID,Name,Created At,Customer: ID,Line: Type,Line: Product ID,Line: Quantity,Line: Total,Refund: ID\n0,7,#7,t,3,,,,,\n1,7,,,,Line Item,1,2,5.00,\n2,7,,,,Refund Line,1,,-1.00,R1\n3,7,,,,Refund Line,1,,-1.00,R1\n')
    got = intake.csv_orders(intake.order_csv(spark, path)[0])
    assert shuffles(got) == 0 and "FileScan text" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(7, "#7", "t", 3, 1, 2, 500, 1, 200)]


def test_stream_rows_are_judged_without_frames_so_large_versions_stay_exact(spark):
    source, home = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    big = 2**53
    put = lambda rows: spark.createDataFrame(rows, "k long, event_id long, ts long, more string").coalesce(1).write.mode("append").parquet(source)
    read = lambda: [tuple(r) for r in latest.latest_of_stream(spark, source, "k", "event_id", "ts", home, columns=("k", "event_id", "ts")).collect()]
    put([(1, 1, None, "x"), (1, 2, big + 1, "x")])
    assert read() == [(1, 2, big + 1)]
    put([(1, 3, big, "x"), (1, 4, None, "x")])
    assert read() == [(1, 2, big + 1)]
    log = latest.rejected_of_stream(spark, home)
    assert log.columns == ["k", "event_id", "ts", "kept_version", "batch"] and sorted((r["event_id"], r["kept_version"]) for r in log.collect()) == [(1, None), (3, big + 1), (4, big + 1)]


def test_unit_documents_are_parsed_once_and_only_kinds_asked_for_are_kept(spark):
    snaps = timeline._snapshots(spark, "/root/testdata/sf0.001", ("ADSET", "CAMPAIGN"))
    assert "FileScan text" not in plan(snaps)
    assert {r[0] for r in snaps.select("entity_type").distinct().collect()} == {"ADSET", "CAMPAIGN"}


def test_totals_compute_the_stores_orders_once(spark):
    assert "o_custkey" not in plan(entities.totals(spark, "/root/testdata/sf0.001", ("ADSET", "CAMPAIGN"), (28,)))
