from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import exprs as E
from tallyforge.operators.components import connected_components
from tallyforge.operators.upsert import version_guard


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "currency", "want"), [("12.34", "INR", 1234), ("12.345", "INR", None), ("7", "JPY", 7), ("7.5", "JPY", None), ("1.234", "KWD", 1234), ("-0.05", "INR", -5), ("x", "INR", None), (None, "INR", None)])
def test_money(spark, text, currency, want):
    assert one(spark, E.parse_money(F.lit(text).cast("string"), F.lit(currency))) == want


@pytest.mark.parametrize(("amount", "currency", "want"), [(5, "INR", "0.05"), (-1234, "INR", "-12.34"), (7, "JPY", "7"), (1, "KWD", "0.001")])
def test_money_text(spark, amount, currency, want):
    assert one(spark, E.format_money(F.lit(amount), F.lit(currency))) == want


def test_interval_grows_with_n_and_verdict(spark):
    lows = [one(spark, E.poisson_interval(F.lit(float(n)), 1.645)[0]) for n in (0, 1, 10, 100)]
    assert lows[0] is None and lows[1] < lows[2] < lows[3] < 100
    assert one(spark, E.verdict(F.lit(1.0), F.lit(2.0), 1.0)) == "NOT_DISTINGUISHABLE"
    assert one(spark, E.verdict(F.lit(1.1), F.lit(2.0), 1.0)) == "ABOVE_TARGET"


def test_reporting_day_and_rounding(spark):
    assert one(spark, E.reporting_day(F.lit("2025-04-16 18:33:50").cast("timestamp"), "Asia/Kolkata")) == date(2025, 4, 17)
    assert one(spark, E.rounded(F.lit(-2.5), 0)) == -2.0
    assert one(spark, E.volume_trend(F.lit(0), F.lit(0))) is None
    assert one(spark, E.hamming(F.lit("ff"), F.lit("0f"))) == 4 and one(spark, E.hamming(F.lit("fg"), F.lit("0f"))) is None
    assert one(spark, E.query_value(F.lit("/a?x=1&utm=a%20b+c"), "utm")) == "a b c"


def test_hash_families_of_any_length(spark):
    from tallyforge.operators import hashes

    rng, rows = random.Random(4), [("none", None), ("word", "xyz"), ("odd", "abc")]
    for digits in (6, 16, 33, 64):
        for i in range(8):
            x = rng.getrandbits(4 * digits)
            rows.append((f"{digits}-{i}-0", f"{x:0{digits}x}"))
            for bits in (6, 10, 11):
                y = x ^ sum(1 << k for k in rng.sample(range(4 * digits), bits))
                rows.append((f"{digits}-{i}-{bits}", f"{y:0{digits}X}"))
    up = {k: k for k, _ in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    good = [(k, h) for k, h in rows if h and h != "xyz"]
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if len(x) == len(y) and (int(x, 16) ^ int(y, 16)).bit_count() <= 10:
                p, q = sorted((find(a), find(b)))
                up[q] = p
    got = {r["asset"]: r["family"] for r in hashes.families(spark.createDataFrame(rows, "asset string, hash string")).collect()}
    assert got == {k: find(k) for k, _ in rows}
    assert got["16-0-10"] == got["16-0-0"] and one(spark, E.hamming(F.lit("f" * 40), F.lit("0" * 40))) == 160


def test_upsert_does_not_depend_on_order(spark):
    rows = [(k, v, a) for k in range(4) for v, a in ((1, 1), (3, 2), (3, 3), (2, 4))]
    target = spark.createDataFrame([(0, 9, 0), (1, 3, 0), (9, 1, 0)], "k int, v int, a int")
    out = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        merged, rejected = version_guard(target, spark.createDataFrame(rows, "k int, v int, a int"), "k", "v", "a")
        out.append((sorted(map(tuple, merged.collect())), rejected.count()))
    assert out[0] == out[1]
    assert out[0][0] == [(0, 9, 0), (1, 3, 3), (2, 3, 3), (3, 3, 3), (9, 1, 0)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (7, 7)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)] + [(None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_query_has_sql_and_runs_on_the_smallest_tables(spark):
    import __spark_entry__ as entry
    from tallyforge.plans.queries import QUERIES

    assert set(QUERIES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
    assert QUERIES["rejected_versions"](spark, "/root/testdata/sf0.001").count() > 0


def test_written_tables_can_be_dropped(spark):
    from tallyforge import runtime

    runtime.drop_tables(spark)
    kept = runtime.table(spark.range(3), "some")
    assert kept.count() == 3 and runtime.drop_tables(spark) == 1 and runtime.drop_tables(spark) == 0
    many = runtime.bucketed(spark.range(50).withColumnRenamed("id", "d"), "d", "some")
    assert many.count() == 50 and "Exchange" not in many.groupBy("d").count()._jdf.queryExecution().executedPlan().toString()


def test_tables_written_on_the_way_can_be_dropped(spark):
    from tallyforge import runtime

    held = runtime.table(spark.range(5).repartition(2), "probe")
    dealt = runtime.bucketed(spark.range(7), "id", "probe")
    assert held.count() == 5 and dealt.count() == 7
    names = {t.name for t in spark.catalog.listTables() if t.name.startswith("tf_probe")}
    assert len(names) == 1 and runtime.drop_tables(spark) >= 2
    assert not names & {t.name for t in spark.catalog.listTables()} and runtime.drop_tables(spark) == 0
