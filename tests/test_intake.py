from __future__ import annotations

import json
import tempfile
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.operators.backtest import backtest
from tallyforge.sources import intake

HEAD = "Row,ID,Name,Created At,Customer: ID,Line: Type,Line: Product ID,Line: Quantity,Line: Total,Refund: ID\n"


def csv(spark, body):
    path = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "orders.csv"
    path.write_text(HEAD + body, encoding="utf-8")
    return intake.order_csv(spark, str(path))


def test_csv_takes_the_first_value_that_is_not_blank_and_counts_junk(spark):
    rows, junk = csv(spark, '3,7,late,,,Refund Line,9,,-1.50,R1\n1,7,,,,Line Item,9,2,3.00,\n2,7,"#7, a",2025-01-01 00:00:00 +0530,5,Line Item,9,x,4.00,\n4,7,,,,Refund Line,9,,-0.25,R1\n9, ,junk,,,,,,,\n10,######,,,,,,,,\n')
    assert junk.count() == 2
    got = intake.csv_orders(rows).collect()
    assert [tuple(r) for r in got] == [(7, "#7, a", "2025-01-01 00:00:00 +0530", 5, 2, 2, 700, 1, 175)]
    assert intake.csv_orders(csv(spark, "")[0]).count() == 0


def test_store_orders_fall_back_to_lines_where_no_refund_went_through(spark):
    back = lambda status: {"id": "r", "transactions": [{"kind": "refund", "status": status, "amount": "-2.00"}, {"kind": "void", "status": "success", "amount": "9.00"}], "lines": [{"subtotal": "1.00", "tax": "0.10"}]}
    docs = [{"id": "gid://s/Order/1", "refunds": [back("success"), back("failure")], "lineItems": [{"product": "p", "quantity": 3, "total": "1.25"}, {"product": None, "quantity": None, "total": None}]}, {"id": "gid://s/Order/2"}, {"id": None}]
    bodies = [(json.dumps(d),) for d in docs] + [("not json",), (None,)]
    got = sorted(map(tuple, intake.store_orders(spark.createDataFrame(bodies, "body string")).collect()))
    assert got == [(1, None, None, 2, 3, 125, 310), (2, None, None, 0, 0, 0, 0)]


def test_report_rows_read_leniently_and_drop_rows_without_ad_or_day(spark):
    docs = [{"ad_id": "5", "date_start": "2025-01-02", "spend": "1.20", "impressions": "12.0", "clicks": " 3x", "attribution_setting": "7d_click_1d_view", "actions": [{"action_type": "purchase", "value": "2"}, {"action_type": "purchase", "value": "8"}]}, {"ad_id": "", "date_start": "2025-01-02"}, {"ad_id": "6", "date_start": "soon"}]
    got = intake.report_rows(spark.createDataFrame([(json.dumps(d),) for d in docs], "body string")).collect()
    assert [tuple(r) for r in got] == [(5, date(2025, 1, 2), 12, 3, 120, 2, 0, "7d_click,1d_view")]


def test_archive_paths_with_another_form_give_nulls(spark):
    df = spark.createDataFrame([("x/raw/ads/2025/01/02/daily_rows_r7_3.json",), ("raw/ads/2025/13/02/a_b_1.json",), ("other",), (None,)], "p string")
    got = [tuple(r) for r in df.select(*intake.archive_parts(F.col("p"))).collect()]
    assert got[0] == ("ads", date(2025, 1, 2), "daily_rows", "r7", 3)
    assert got[1][1] is None and got[2][0] is None and got[3][4] is None


def test_instants_and_days(spark):
    df = spark.createDataFrame([("2025-04-17 00:03:50 +0530",), ("2025-04-17 00:03:50",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(E.parse_instant(F.col("t"))).collect()]
    assert got[1:] == [None, None, None]
    day = df.limit(1).select(E.reporting_day(E.parse_instant(F.col("t")), "Asia/Kolkata").alias("d"))
    assert day.first()[0] == date(2025, 4, 17)
    a, b = E.day_bounds(F.col("d"), "America/New_York")
    spring = spark.createDataFrame([(date(2025, 3, 9),)], "d date")
    assert spring.select(((F.unix_micros(b) - F.unix_micros(a)) / 3600e6).alias("h")).first()["h"] == 23
    assert spring.select(E.native_day(F.col("d"), "Pacific/Honolulu", "Asia/Kolkata").alias("x")).first()["x"] == date(2025, 3, 10)


def test_backtest_knows_nothing_of_later_days(spark):
    schema = "e long, day date, spend long, purchases long, purchase_value long"
    d = lambda n: date(2025, 1, n)
    rows = [(1, d(1), 100, 20, 100), (2, d(1), 100, 5, 900), (1, d(2), 100, 30, 500), (2, d(2), 100, 30, 1), (3, d(2), 100, 99, 9999)]
    got = {r["strategy"]: r for r in backtest(spark.createDataFrame(rows, schema), F.col("e"), [d(1)], 7, 14, 12).collect()}
    assert got["SYSTEM"]["entity_id"] == 1 and got["NAIVE"]["entity_id"] == 2
    assert got["SYSTEM"]["verdict"] == "ABOVE_TARGET" and got["NAIVE"]["verdict"] == "BELOW_TARGET"
    assert got["NAIVE"]["brier"] is None and abs(got["SYSTEM"]["brier"] - (1 - got["SYSTEM"]["confidence"]) ** 2) < 1e-5
    assert backtest(spark.createDataFrame([], schema), F.col("e"), [d(1)], 7, 14, 12).count() == 0
    few = backtest(spark.createDataFrame(rows[1:2], schema), F.col("e"), [d(1)], 7, 14, 12).collect()
    assert [(r["strategy"], r["verdict"]) for r in few] == [("NAIVE", None)]


def test_every_intake_query_runs_on_the_smallest_tables(spark):
    from tallyforge.plans.intake import ORACLE_SQL, QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)
    for name, query in QUERIES.items():
        assert query(spark, "/root/testdata/sf0.001").count() >= 0, name
