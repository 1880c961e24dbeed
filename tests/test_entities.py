"""Entity spine, archive, changes, decisions, bookkeeping and the stream, on small tables."""

from __future__ import annotations

import tempfile
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.operators import changes, decide, ledger, seasons, spine
from tallyforge.sources import archive, dims, intake
from tallyforge.streaming.latest import latest_of_stream, rejected_of_stream

ADS = "ad_id long, adset_id long, campaign_id long, family_id long, name string"
DAILY = "ad_id long, day date, impressions long, reach long, clicks long, landings long, carts long, checkouts long, purchases long, spend long, purchase_value long, attribution string"


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="module")
def ads(spark):
    return spark.createDataFrame([(1, 10, 100, 7, "one"), (2, 10, 100, 8, "two"), (3, 11, 101, 7, "three")], ADS)


def test_every_entity_has_a_row_and_mixed_attribution_is_null(spark, ads):
    rows = [(1, date(2024, 1, 30), 10, None, 4, 3, 2, 1, 1, 100, 300, "a"), (1, date(2024, 1, 20), 5, 2, 0, 0, 0, 0, 0, 50, 0, "b"), (2, date(2023, 11, 1), 9, 9, 9, 9, 9, 9, 9, 9, 9, "a"), (99, date(2024, 1, 30), 1, 1, 1, 1, 1, 1, 1, 1, 1, "a")]
    orders = spark.createDataFrame([(5, date(2024, 1, 29), 1000, True, "1"), (6, date(2024, 1, 1), 500, None, " Only "), (7, date(2024, 1, 30), 9, True, "404"), (8, date(2024, 1, 30), 9, True, None)], "order_id long, day date, gross long, new_customer boolean, tag string")
    refunds = spark.createDataFrame([(6, date(2024, 1, 28), 70), (77, date(2024, 1, 28), 5)], "order_id long, day date, refund long")
    camps = spark.createDataFrame([(100, "only"), (101, "same"), (102, "SAME")], "campaign_id long, name string")
    found = spine.resolved(orders, ads, camps)
    assert sorted((r["order_id"], r["resolution"], r["campaign_id"]) for r in found.collect()) == [(5, "AD_ID", 100), (6, "NAME_MATCH", 100)]
    store = spine.store_totals(orders, refunds, spine.matches(found, ads))
    levels = ads.select(F.inline(dims.levels())).distinct()
    t = spine.totals_on_spine(levels, spine.delivery_totals(spark.createDataFrame(rows, DAILY), ads), store).cache()
    assert t.count() == levels.count() * 4
    by = {(r["entity_type"], r["entity_id"], r["days"]): r for r in t.collect()}
    assert by["AD", 1, 7]["spend"] == 100 and by["AD", 1, 14]["spend"] == 150 and by["AD", 3, 28]["spend"] == 0 and by["ACCOUNT", 0, 56]["reach"] == 2
    assert (by["AD", 1, 7]["attribution"], by["AD", 1, 14]["attribution"], by["AD", 3, 28]["attribution"]) == ("a", None, None)
    assert (by["CAMPAIGN", 100, 7]["orders"], by["CAMPAIGN", 100, 7]["refunds"], by["CAMPAIGN", 100, 56]["orders"], by["ADSET", 10, 56]["orders"]) == (1, 70, 2, 1)
    assert by["ACCOUNT", 0, 56]["new_orders"] == 1
    urls = spark.createDataFrame([(1, "http://x/?ref=a"), (3, " ")], "ad_id long, url string")
    m = {(r["entity_type"], r["entity_id"], r["days"]): r for r in spine.metric_set(t, urls).collect()}
    assert m["AD", 1, 7]["store_roas"] == 10.0 and m["AD", 1, 7]["roas"] == 3.0 and m["AD", 1, 7]["frequency"] is None
    assert m["AD", 3, 7]["store_orders"] is None and m["AD", 2, 7]["store_orders"] is None and m["ADSET", 11, 7]["store_orders"] == 0
    tr = {r["metric"]: r for r in spine.trends(spark.createDataFrame(rows, DAILY), ads).where("entity_type = 'AD' AND entity_id = 1").collect()}
    assert len(tr) == 8 and tr["spend"]["percent"] == 100.0 and tr["spend"]["trend"] == "UP" and tr["cpa"]["previous"] is None


def test_interval_of_a_metric_that_falls_with_the_count(spark):
    n, v = F.lit(25.0), F.lit(100.0)
    up, down = spine.scaled_interval(v, n, 1.645, True), spine.scaled_interval(v, n, 1.645, False)
    r = spark.range(1).select(up[0].alias("a"), up[1].alias("b"), down[0].alias("c"), down[1].alias("d")).first()
    assert r["a"] < 100 < r["b"] and r["c"] < 100 < r["d"] and abs(r["a"] * r["d"] - 10000) < 1e-6


def test_archive_replaces_a_run_and_reads_documents(spark):
    path = folder() + "/raw"
    doc = '{"id":"7","type":"AD","creative":{"feed":{"images":[{"hash":"b"},{"hash":"a"}],"videos":[{"hash":"b"}]}},"targeting":{"z":"1","a":"2"},"creatives":["2","1"],"placements":["x",3]}'
    rows = [("entities", date(2025, 1, 2), 1, "stale"), ("entities", date(2025, 1, 3), 2, doc), ("other", date(2025, 1, 2), 1, "{}")]
    schema = "source string, day date, run long, body string"
    archive.write(spark.createDataFrame(rows, schema), path)
    archive.write(spark.createDataFrame([("entities", date(2025, 1, 2), 1, '{"id":"x"}')], schema), path)
    got = archive.read(spark, path, "entities")
    assert sorted((r["run"], r["body"]) for r in got.collect()) == [(1, '{"id":"x"}'), (2, doc)]
    assert archive.read(spark, path, "entities", "2025-01-02").count() == 1
    e = {r["run"]: r for r in archive.entities(got).collect()}
    assert (e[2]["entity_id"], e[2]["creative_kind"], e[2]["members"], e[2]["placements"], e[2]["targeting"], e[2]["creatives"]) == (7, "COMPOSITE", "a,b", None, '{"a":"2","z":"1"}', "1,2")
    assert e[1]["entity_id"] is None


def test_changes_compare_each_run_with_the_one_before(spark):
    schema = "entity_id long, run long, day date, owner string, daily long, lifetime long, status string, targeting string, bid_strategy string, creatives string"
    d = date(2025, 1, 1)
    rows = [
        (1, 1, d, "ADSET", 100, None, "ON", "{}", None, "a"), (1, 2, d, "ADSET", 125, None, "ON", "{}", "LOW", "a"), (1, 3, d, "UNKNOWN", None, None, "OFF", "{}", "LOW", "a"),
        (2, 1, d, "ADSET", 0, None, "ON", "{}", None, "a"), (2, 2, d, "ADSET", 5, None, "ON", "{}", None, "a"), (3, 1, d, "ADSET", 1, None, "ON", "{}", None, "a"), (3, 3, d, "ADSET", 9, None, "ON", "{}", None, "a"),
        (4, 1, d, "ADSET", None, 10, "ON", "{}", None, "a"), (4, 2, d, "ADSET", None, 8, "ON", "{}", None, "b"), (5, 1, d, "ADSET", 10, None, "ON", "{}", None, "a"), (5, 2, d, "ADSET", None, 10, "ON", "{}", None, "a"),
    ]
    ev = changes.events(spark.createDataFrame(rows, schema)).cache()
    got = sorted((r["entity_id"], r["run"], r["field"], r["percent"], r["material"]) for r in ev.collect())
    assert got == [(1, 2, "BID_STRATEGY", None, False), (1, 2, "BUDGET", 25.0, True), (1, 3, "STATUS", None, False), (2, 2, "BUDGET", None, False), (4, 2, "BUDGET", -20.0, True), (4, 2, "CREATIVE_ASSIGNMENT", None, False), (5, 2, "BUDGET", None, False)]
    only = changes.enriched(ev, spark.createDataFrame([(1,), (9,)], "entity_id long")).collect()
    assert [(r["entity_id"], r["changes"], r["budget"], r["last_material_budget"]) for r in only] == [(1, 3, 1, d)]


def test_guardrails(spark):
    schema = "i int, kind string, owner string, unit_owns boolean, spend long, impressions long, purchases long, percent double"
    rows = [(0, "INCREASE_BUDGET", "ADSET", True, 2000000, 5, 30, 20.0), (1, "INCREASE_BUDGET", "ADSET", True, 2000000, 5, 30, -20.5), (2, "INSUFFICIENT_DATA", "UNKNOWN", False, 0, 0, 0, None), (3, "INCREASE_BUDGET", "CAMPAIGN", False, 0, 0, 2, None), (4, "INCREASE_BUDGET", "UNKNOWN", False, 0, 0, 40, 1.0)]
    p = spark.createDataFrame(rows, schema)
    out = {r["i"]: (r["rejection_reason"], r["final_kind"]) for r in decide.judged(p, decide.violations(p, F.lit(30), F.lit(1000000))).collect()}
    assert out[0] == (None, "INCREASE_BUDGET") and out[1] == ("MAX_CHANGE_PERCENT_EXCEEDED", "INSUFFICIENT_DATA") and out[2] == (None, "INSUFFICIENT_DATA")
    assert out[3][0] == "DECISION_UNIT_NOT_BUDGET_OWNER | NOT_DELIVERING | MIN_PURCHASES_NOT_MET | MIN_SPEND_NOT_MET" and out[4][0] == "NO_DECISION_UNIT | MIN_SPEND_NOT_MET"
    c = spark.range(1).select(decide.adjusted_confidence(F.lit(0.8), F.lit(True), F.lit(True)).alias("a"), decide.adjusted_confidence(F.lit(1.7), F.lit(False), F.lit(False)).alias("b")).first()
    assert abs(c["a"] - 0.36) < 1e-12 and c["b"] == 1.0


def test_patches_versions_and_runs(spark):
    stored = spark.createDataFrame([(1, 2, 5.0, "a"), (2, 1, 6.0, "b")], "id long, v long, x double, y string")
    merged, log = ledger.guarded_patch(stored, spark.createDataFrame([(1, 2, 9.0), (2, 2, 9.0), (3, 2, 9.0)], "id long, v long, x double"), "id", "v", ("x",))
    assert sorted(map(tuple, merged.collect())) == [(1, 2, 9.0, "a"), (2, 1, 6.0, "b")]
    assert dict(map(tuple, log.collect())) == {1: "WRITTEN", 2: "SKIPPED_STALE", 3: "MISSING"}
    v = spark.createDataFrame([("k", 1, True), ("k", 2, True)], "k string, version int, active boolean")
    with pytest.raises(PySparkException):
        ledger.active_version(v, "k", "version", "active").collect()
    assert [tuple(r) for r in ledger.active_version(ledger.published(v, "k", "version", "active"), "k", "version", "active").collect()] == [("k", 2)]
    runs = spark.createDataFrame([("a", 1, "SUCCEEDED", 0), ("a", 2, "FAILED", 0), ("b", 1, "SUCCEEDED", 3)], "task_id string, at long, status string, rows long")
    assert {r["task_id"]: (r["watermark"], r["status"]) for r in ledger.health(runs).collect()} == {"a": (1, "failing"), "b": (1, "healthy")}
    assert ledger.pending(spark.createDataFrame([("a",), ("c",)], "task_id string"), runs).collect()[0]["task_id"] == "c"
    gap = spark.range(1).select(*ledger.known_gap(F.lit(date(2025, 1, 1)), F.lit(date(2025, 6, 30))), *ledger.known_gap(F.lit(date(2025, 5, 1)), F.lit(date(2025, 6, 30)))).first()
    assert tuple(gap) == (date(2025, 1, 2), date(2025, 5, 2), None, None)


def test_seasons_in_words(spark):
    w = spark.createDataFrame([(date(2025, 10, 16), date(2025, 10, 20), date(2025, 7, 1), date(2025, 7, 5)), (date(2025, 7, 2), date(2025, 7, 3), date(2025, 7, 1), date(2025, 7, 1))], "start date, end date, base_start date, base_end date")
    a, b = seasons.context(w, seasons.calendar(spark)).orderBy("start").collect()
    assert a["summary"] == "window is off-season; baseline is off-season." and not a["spans_boundary"]
    assert b["labels"] == ["dhanteras", "diwali"] and b["summary"] == "window covers dhanteras and diwali; baseline is off-season; different seasonal regimes."


def test_money_of_one_currency_only(spark):
    df = spark.createDataFrame([(1, "INR"), (2, "USD")], "m long, c string")
    with pytest.raises(PySparkException):
        df.select(E.same_currency(F.col("m"), F.col("c"), "INR")).collect()
    with pytest.raises(PySparkException):
        df.agg(E.money_sum(F.col("m"), F.col("c"))).collect()
    assert df.where("c = 'INR'").agg(E.money_sum(F.col("m"), F.col("c")).alias("s")).first()["s"] == 1
    t = spark.createDataFrame([(" a, ,b ",), (",",), (None,)], "t string").select(E.tags(F.col("t")).alias("t"), E.untrusted(F.lit("<b>")).alias("u")).collect()
    assert [r["t"] for r in t] == [["a", "b"], None, None] and t[0]["u"] == "<untrusted>&lt;b&gt;</untrusted>"


def test_a_quoted_line_break_stays_in_its_row(spark):
    path = folder() + "/o.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write('Row,ID,Name,Created At,Customer: ID,Line: Type,Line: Product ID,Line: Quantity,Line: Total,Refund: ID\n1,7,"two\nlines ""x""",,5,Line Item,9,2,3.00,\n')
    rows, junk = intake.order_csv(spark, path)
    got = intake.csv_orders(rows).collect()
    assert junk.count() == 0 and [(r["order_id"], r["name"], r["lines"]) for r in got] == [(7, 'two\nlines "x"', 1)]


def test_the_stream_goes_on_and_logs_what_it_rejects(spark):
    source, home = folder(), folder()
    at = lambda d: datetime(2024, 1, d)
    put = lambda rows: spark.createDataFrame(rows, "k long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    put([(1, 10, at(5)), (1, 11, at(3)), (2, 12, at(1)), (1, 10, at(5)), (None, 13, at(9))])
    read = lambda: {r["k"]: r["event_id"] for r in latest_of_stream(spark, source, "k", "event_id", "ts", home).collect()}
    assert read() == {1: 10, 2: 12}
    put([(1, 20, at(4)), (2, 21, at(2)), (3, 22, at(1))])
    assert read() == {1: 10, 2: 21, 3: 22}
    assert read() == {1: 10, 2: 21, 3: 22}
    log = sorted((r["event_id"], r["batch"], r["kept_version"]) for r in rejected_of_stream(spark, home).collect())
    assert log == [(11, 0, None), (20, 1, at(5))]


def test_learning_restarts_with_a_large_change_of_spend(spark, ads):
    rows = [(1, date(2024, 1, d), 100 if d < 28 else 130, 4) for d in range(20, 31)] + [(3, date(2024, 1, 29), 10, 60)]
    d = spark.createDataFrame(rows, "ad_id long, day date, spend long, purchases long").join(ads, "ad_id")
    got = {(r["entity_type"], r["entity_id"]): r for r in changes.learning(d, F.slice(dims.levels(), 1, 2)).collect()}
    one, three = got["AD", 1], got["ADSET", 11]
    assert (one["reset_day"], one["start"], one["cause"], one["conversions"], one["learning"], one["to_exit"]) == (date(2024, 1, 28), date(2024, 1, 28), "budget change", 12, True, 38)
    assert (three["reset_day"], three["cause"], three["conversions"], three["learning"], three["to_exit"]) == (None, "created", 60, False, 0)


def test_demand_needs_two_occurrences_with_enough_days_before(spark):
    cal = spark.createDataFrame([("a", date(2025, 1, 20), date(2025, 1, 21)), ("a", date(2025, 3, 1), date(2025, 3, 1)), ("b", date(2025, 1, 3), date(2025, 1, 3))], "label string, first date, last date")
    days = spark.range(90).select(F.date_add(F.lit(date(2025, 1, 1)), F.col("id").cast("int")).alias("day"))
    season = F.col("day").isin(date(2025, 1, 20), date(2025, 1, 21), date(2025, 3, 1))
    rev = days.select("day", F.when(season, 30).otherwise(10).alias("revenue"), (F.col("day") != date(2025, 1, 21)).alias("clean"))
    e = {(r["label"], r["first"]): r for r in seasons.demand(rev, cal).collect()}
    assert (e["a", date(2025, 1, 20)]["season_days"], e["a", date(2025, 1, 20)]["base_days"], e["a", date(2025, 1, 20)]["ratio"]) == (1, 18, 3.0)
    assert (e["a", date(2025, 3, 1)]["base_days"], e["b", date(2025, 1, 3)]["base_days"], e["b", date(2025, 1, 3)]["ratio"]) == (30, 2, None)
    assert {r["label"]: (r["usable"], r["demand"]) for r in seasons.demand_index(seasons.demand(rev, cal)).collect()} == {"a": (2, 3.0), "b": (0, None)}


def test_overwrite_replaces_only_the_partitions_it_has(spark):
    path = folder() + "/t"
    ledger.overwrite(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "x int, p string"), path, "p")
    ledger.overwrite(spark.createDataFrame([(9, "a")], "x int, p string"), path, "p")
    assert sorted((r["x"], r["p"]) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]
