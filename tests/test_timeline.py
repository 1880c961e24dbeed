"""Runs, nested settings, versions and windows at any day, on small tables."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.operators import bitemporal, changes, cumulative, snapshots
from tallyforge.sources import archive

SNAP = "entity_type string, entity_id long, run string, day date, owner string, daily long, lifetime long, status string, targeting string, bid_strategy string, creatives string"
LOG = "entity_type string, run string, status string, finished_at timestamp"
D = date(2025, 1, 1)


def row(run, kind="ADSET", i=1, owner="ADSET", daily=100, lifetime=None, status="ON", targeting="{}", creatives=None):
    return (kind, i, run, D, owner, daily, lifetime, status, targeting, None, creatives)


def found(spark, rows, log):
    ev = changes.events(spark.createDataFrame(rows, SNAP), spark.createDataFrame(log, LOG))
    return sorted((r["entity_type"], r["entity_id"], r["run"], r["field"], r["percent"]) for r in ev.collect())


def done(run, n, kind="ADSET", status="SUCCEEDED"):
    return (kind, run, status, datetime(2025, 1, n) if status != "RUNNING" else None)


def test_a_skipped_run_loses_no_change(spark):
    rows = [row("a"), row("c", daily=200)]
    assert found(spark, rows, [done("a", 1), done("c", 3)]) == [("ADSET", 1, "c", "BUDGET", 100.0)]
    # Without a log every run with snapshots counts.
    plain = changes.events(spark.createDataFrame([(1, 1, *row("a")[3:]), (1, 3, *row("c", daily=200)[3:])], "entity_id long, run long, " + SNAP.split("run string, ")[1]))
    assert [(r["run"], r["percent"]) for r in plain.collect()] == [(3, 100.0)]


def test_failed_unfinished_and_first_runs_are_passed_over(spark):
    rows = [row("a"), row("b", daily=150), row("c", daily=200), row("d", daily=200)]
    log = [done("a", 1), done("b", 2, status="FAILED"), done("c", 3), done("d", 4, status="RUNNING")]
    assert found(spark, rows, log) == [("ADSET", 1, "c", "BUDGET", 100.0)]
    # The order is that of finishing, not of names; runs of another kind do not count.
    log = [done("c", 1), done("a", 2), done("b", 2, kind="AD")]
    assert found(spark, rows[:1] + rows[2:3], log) == [("ADSET", 1, "a", "BUDGET", -50.0)]
    assert found(spark, rows[:1], [done("a", 1)]) == []


def test_new_absent_and_equal_entities_give_nothing(spark):
    rows = [row("a", i=1), row("b", i=1), row("b", i=2), row("a", i=3), row("c", i=3, daily=5)]
    assert found(spark, rows, [done("a", 1), done("b", 2), done("c", 3)]) == []


def test_budgets_that_change_level(spark):
    rows = [row("a"), row("b", owner=None, daily=None), row("c", owner="UNKNOWN", daily=None), row("d", daily=7)]
    got = found(spark, rows, [done(r, n) for n, r in enumerate("abcd", 1)])
    assert got == [("ADSET", 1, "b", "BUDGET", None)]


def test_a_key_of_another_entity_is_an_error(spark):
    df = spark.createDataFrame([row("a"), row("b", daily=1)], SNAP)
    own = F.concat_ws("_", "entity_type", "entity_id", "run")
    log = spark.createDataFrame([done("a", 1), done("b", 2)], LOG)
    assert changes.events(df.withColumn("snapshot_key", own), log).count() == 1
    with pytest.raises(PySparkException, match="another entity"):
        changes.events(df.withColumn("snapshot_key", F.when(F.col("run") == "b", "ADSET_2_b").otherwise(own)), log).collect()


def test_nested_key_order_is_no_change_and_nested_values_are(spark):
    texts = ['{"geo":{"b":[{"y":1,"x":2}],"a":"q"},"age":1}', '{"age":1,"geo":{"a":"q","b":[{"x":2,"y":1}]}}', '{"age":1,"geo":{"a":"q","b":[{"x":2,"y":3}]}}', '{"age":1,"geo":{"a":"q","b":[]}}']
    docs = spark.createDataFrame([(D, n, '{"id":"1","type":"ADSET","daily_budget":5,"targeting":' + t + "}") for n, t in enumerate(texts)] + [(D, 9, '{"id":"2","type":"ADSET","targeting":null}'), (D, 9, '{"id":"3","type":"ADSET"}')], "day date, run long, body string")
    e = archive.entities(docs).cache()
    by = {r["run"]: r["targeting"] for r in e.where("entity_id = 1").collect()}
    assert by[0] == by[1] == '{"age":1,"geo":{"a":"q","b":[{"x":2,"y":1}]}}'
    assert [r["targeting"] for r in e.where("entity_id > 1").collect()] == [None, None]
    ev = changes.events(e.select("entity_id", "run", "day", F.lit("ADSET").alias("owner"), "daily", "lifetime", "status", "targeting", "bid_strategy", "creatives").where("entity_id = 1"))
    assert sorted((r["run"], r["field"]) for r in ev.collect()) == [(2, "TARGETING"), (3, "TARGETING")]
    t = spark.createDataFrame([('{"b":1,"a":{"d":[2,1],"c":null}}',), ("no",), (None,), ('{"a":1,"a":2}',)], "t string").select(archive.canonical_text(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in t] == ['{"a":{"c":null,"d":[2,1]},"b":1}', None, None, None]


def test_snapshots_of_three_kinds_and_budget_owners(spark):
    schema = "entity_type string, entity_id long, run long, day date, parent long, daily long, lifetime long, status string, targeting string, bid_strategy string, creatives string"
    unit = lambda kind, i, parent=None, daily=None, lifetime=None: (kind, i, 1, D, parent, daily, lifetime, "ON", "{}", "LOW", "c1")
    rows = [unit("CAMPAIGN", 1, daily=9), unit("CAMPAIGN", 2), unit("CAMPAIGN", 3), unit("CAMPAIGN", 4)]
    rows += [unit("ADSET", 11, 1), unit("ADSET", 12, 1, daily=4), unit("ADSET", 21, 2, lifetime=7), unit("ADSET", 22, 2), unit("ADSET", 31, 3), unit("ADSET", 91, 9, daily=1), unit("AD", 5, daily=3)]
    got = {(r["entity_type"], r["entity_id"]): r for r in snapshots.built(spark.createDataFrame(rows, schema)).collect()}
    owners = {k: (r["owner"], r["daily"], r["lifetime"]) for k, r in got.items()}
    assert owners["CAMPAIGN", 1] == ("CAMPAIGN", 9, None) and owners["CAMPAIGN", 2] == (None, None, None)
    assert owners["CAMPAIGN", 3] == owners["CAMPAIGN", 4] == ("UNKNOWN", None, None)
    assert owners["ADSET", 11] == (None, None, None) and owners["ADSET", 12] == ("UNKNOWN", None, None) and owners["ADSET", 21] == ("ADSET", None, 7)
    assert owners["ADSET", 22] == owners["ADSET", 31] == ("UNKNOWN", None, None) and owners["ADSET", 91] == ("ADSET", 1, None)
    assert owners["AD", 5] == (None, None, None) and got["AD", 5]["creatives"] == "c1" and got["ADSET", 11]["creatives"] is None and got["CAMPAIGN", 1]["targeting"] is None


FACT = "run string, entity_id long, ad_id long, day date, spend long, impressions long, purchases long, purchase_value long"


def test_versions_are_valid_from_their_run_to_the_next(spark):
    t = lambda n: datetime(2024, 1, n)
    rows = [(r, 1, 1, date(2024, 1, 1), spend, 1, 1, 1) for r, spend in (("a", 10), ("b", 20), ("c", 30), ("bad", 99), ("late", 40))]
    log = [("a", "SUCCEEDED", t(2)), ("b", "SUCCEEDED", t(5)), ("c", "SUCCEEDED", t(5)), ("bad", "FAILED", t(3)), ("late", "SUCCEEDED", t(20))]
    v = bitemporal.versions(spark.createDataFrame(rows, FACT), spark.createDataFrame(log, "run string, status string, finished_at timestamp"), ["ad_id", "day"])
    assert sorted((r["spend"], r["known_from"].day, r["known_to"] and r["known_to"].day) for r in v.collect()) == [(10, 2, 5), (30, 5, 20), (40, 20, None)]
    asked = spark.createDataFrame([(n, date(2023, 12, 20), date(2024, 1, 3), t(n)) for n in (1, 2, 4, 5, 19, 20)], "n int, lo date, hi date, at timestamp")
    got = bitemporal.known_at(v, asked, 15)
    assert sorted((r["n"], r["spend"]) for r in got.collect()) == [(2, 10), (4, 10), (5, 30), (19, 30), (20, 40)]


def store(spark):
    return spark.createDataFrame([(date(2024, 1, 20), 500, datetime(2024, 1, 21), None), (date(2024, 1, 21), 900, datetime(2024, 3, 1), None)], "day date, net long, known_from timestamp, known_to timestamp")


def run_backtest(spark, rows, days, **options):
    facts = spark.createDataFrame(rows, "entity_id long, day date, spend long, impressions long, purchases long, purchase_value long, known_from timestamp, known_to timestamp")
    gaps = spark.createDataFrame([(date(2024, 1, 20), date(2024, 1, 22)), (date(2024, 1, 22), date(2024, 1, 23))], "start date, end date")
    return {(r["as_of"], r["strategy"][:5]): r for r in bitemporal.backtest(facts, store(spark), gaps, days, **options).collect()}


def test_backtest_at_many_days_sees_only_what_was_known(spark):
    early, late = datetime(2023, 12, 1), datetime(2024, 2, 20)
    day = date(2024, 1, 25)
    rows = [(1, date(2024, 1, 10), 1000, 5, 60, 2000, early, None), (2, date(2024, 1, 24), 100, 5, 1, 900, early, None), (1, date(2024, 1, 24), 100, 5, 0, 100, early, None)]
    rows += [(3, date(2024, 1, 24), 1000, 5, 90, 9000, late, None), (1, date(2024, 2, 5), 1000, 5, 80, 3000, datetime(2024, 2, 6), None), (1, date(2024, 2, 6), 5, 5, 5, 5, datetime(2024, 6, 1), None)]
    got = run_backtest(spark, rows, [day, day + timedelta(30), date(2023, 1, 1)])
    a = got[day, "SYSTE"]
    assert (a["unit_id"], a["action"], a["confidence"], a["change_percent"], a["verdict"], a["purchases_after"]) == (1, "INCREASE_BUDGET", 0.9, 14.0, "ABOVE_TARGET", 80)
    assert a["brier"] == pytest.approx(0.01) and a["store_to_spend"] == pytest.approx(500 / 1200, abs=1e-6) and a["gap_days"] == 4
    b = got[day, "NAIVE"]
    assert (b["unit_id"], b["change_percent"], b["confidence"], b["brier"]) == (2, 20.0, None, None)
    # A month later the late run has ended; nothing is known at the year's begin.
    assert got[day + timedelta(30), "SYSTE"]["unit_id"] == 1 or got[day + timedelta(30), "SYSTE"]["unit_id"] == 3
    empty = got[date(2023, 1, 1), "SYSTE"]
    assert (empty["unit_id"], empty["action"], empty["store_to_spend"], empty["gap_days"]) == (None, "INSUFFICIENT_DATA", None, 0)


def test_a_change_beyond_the_limit_is_refused(spark):
    from dataclasses import replace

    rows = [(1, date(2024, 1, 10), 1000, 5, 60, 2000, datetime(2023, 12, 1), None)]
    got = run_backtest(spark, rows, [date(2024, 1, 12)], canon=replace(CANON, max_change_percent=10.0))
    a, b = got[date(2024, 1, 12), "SYSTE"], got[date(2024, 1, 12), "NAIVE"]
    assert (a["unit_id"], a["action"], a["refused"], a["change_percent"], a["confidence"]) == (1, "INSUFFICIENT_DATA", True, None, None)
    assert (b["action"], b["refused"], b["change_percent"]) == ("INCREASE_BUDGET", False, 20.0)


def test_windows_at_many_days_equal_sums_day_by_day(spark):
    rng = random.Random(6)
    first = date(2023, 11, 1)
    rows = [(rng.choice("ab"), rng.randrange(3), first + timedelta(rng.randrange(90)), rng.randrange(50), None if rng.random() < 0.1 else rng.randrange(9)) for _ in range(400)]
    spine = [("a", i) for i in range(4)] + [("b", 0)]
    as_of, windows = [first + timedelta(n) for n in (0, 3, 40, 41, 89, 200)], (1, 7, 56)
    got = cumulative.windows_at(spark.createDataFrame(rows, "t string, i long, day date, x long, y long"), spark.createDataFrame(spine, "t string, i long"), ["t", "i"], ("x", "y"), as_of, windows)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(t") == 2
    want = {}
    for t, i in spine:
        for d in as_of:
            for n in windows:
                own = [r for r in rows if r[:2] == (t, i) and d - timedelta(n) < r[2] <= d]
                want[t, i, d, n] = (sum(r[3] for r in own), sum(r[4] or 0 for r in own))
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == want


def test_one_file_is_read_by_many_tasks_whatever_its_line_breaks(spark):
    import tempfile

    from tallyforge.sources import csvsplit

    rng = random.Random(3)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    word = lambda: "".join(rng.choice('ab",\n\r é') for _ in range(rng.randrange(30)))
    want = []
    for n in range(3):
        with open(f"{path}/{n}.csv", "w", encoding="utf-8", newline="") as f:
            f.write('id,"na\nme",end\n' if n == 1 else "id,name,end\r\n")
            for k in range(400):
                text, end = word(), "\r\n" if n == 0 else "\n"
                text = text.replace("\r", "")
                want.append((n * 1000 + k, text, "z"))
                f.write(f'{n * 1000 + k},"{text.replace(chr(34), chr(34) * 2)}",z{end}')
            f.write("\n" if n == 2 else "")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = csvsplit.rows(spark, path, "id long, name string, end string")
        tasks = spark.read.text(path).rdd.getNumPartitions()
        got = sorted((r["id"], r["name"] or "", r["end"]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 20 and got == sorted(want)
