"""Full exports, documents and reports on small inputs."""

from __future__ import annotations

import json
import tempfile
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.sources import orders


def test_export_rejects_orders_without_a_price_and_keeps_first_values(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/e.csv"
    head = ["Row", *orders.EXPORT]
    rows = [
        {"Row": "2", "ID": "5", "Name": "late", "Price: Total": "9.00", "Line: Type": "Line Item", "Line: Quantity": "2", "Line: Total": "3.00"},
        {"Row": "1", "ID": "5", "Name": "five\nand more", "Created At": "2025-01-01 00:00:00 +0530", "Price: Total": "1.50", "Price: Subtotal": "1.00", "Price: Total Discount": "0", "Billing: Country Code": "IN", "Currency": "KWD", "Payment: Status": "PAID"},
        {"Row": "3", "ID": "5", "Line: Type": "Refund Line", "Line: Total": "-0.250", "Refund: ID": "R"}, {"Row": "4", "ID": "5", "Line: Type": "Refund Line", "Line: Total": "-1", "Refund: ID": "R"},
        {"Row": "5", "ID": "6", "Created At": "2025-01-01 00:00:00 +0530", "Price: Total": "1", "Line: Type": "Line Item", "Line: Total": "1"}, {"Row": "6", "ID": "#### end"}, {"Row": "7", "ID": " "},
    ]
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(head) + "\n" + "".join(",".join('"' + r.get(c, "").replace('"', '""') + '"' for c in head) + "\n" for r in rows))
    own, lines, refunds, rejected = orders.export_orders(orders.export(spark, path))
    got = own.collect()
    assert [(r["order_id"], r["name"], r["currency"], r["total"], r["shipping"], r["country"], r["status"]) for r in got] == [(5, "five\nand more", "KWD", 1500, None, "IN", "paid")]
    assert [(r["quantity"], r["total"]) for r in lines.collect()] == [(2, 3000)] and [(r["refund_id"], r["amount"]) for r in refunds.collect()] == [("R", 1250)]
    assert [tuple(r) for r in rejected.collect()] == [(6, "Price: Subtotal, Price: Total Discount")]


def test_documents_and_reports(spark):
    docs = [json.dumps({"id": "gid://s/Order/1", "presentmentCurrency": "JPY", "totalPrice": "12", "billingAddress": {"countryCode": "JP"}, "refunds": [{"amount": "-3"}]}), json.dumps({"id": "x"}), None]
    got = orders.document_orders(spark.createDataFrame([(d,) for d in docs], "body string")).collect()
    assert [tuple(r) for r in got] == [(1, None, "JPY", 12, "JP", 0, 1, 3)]
    rows = [{"ad_id": "1", "adset_id": "2", "campaign_id": "3", "date_start": "2025-01-02", "impressions": "-5", "reach": "x", "actions": [{"action_type": "purchase", "value": "2"}]}, {"ad_id": "1", "adset_id": "", "campaign_id": "3", "date_start": "2025-01-02"}]
    good, bad = orders.insights(spark.createDataFrame([(json.dumps(r),) for r in rows], "body string"), "Asia/Kolkata", "Asia/Kolkata", "INR")
    r = good.first()
    assert (r["day"], r["impressions"], r["reach"], r["frequency"], r["purchases"], r["spend"]) == (date(2025, 1, 2), 0, None, None, 2, 0) and bad.count() == 1


def test_windows_and_amounts_that_cannot_be_read_stop_the_query(spark):
    w = spark.createDataFrame([(date(2025, 1, 31), date(2025, 2, 2))], "a date, b date")
    assert tuple(orders.window_calendar(w, "a", "b").first())[2:] == (3, 2, 0.666667, "2025-01,2025-02")
    with pytest.raises(PySparkException):
        orders.window_calendar(w, "b", "a").collect()
    text = spark.createDataFrame([("1.5",), (None,), ("1.555",)], "t string")
    assert [r[0] for r in text.where("t IS NULL OR t = '1.5'").select(orders.amount(F.col("t"), F.lit("INR"))).collect()] == [150, None]
    with pytest.raises(PySparkException):
        text.select(orders.amount(F.col("t"), F.lit("INR"))).collect()
