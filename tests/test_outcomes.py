from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyforge.operators.outcomes import evaluate, season_set

RECS = "rec_id long, unit_id long, status string, kind string, accepted_day date, min_spend long, min_purchases long, baseline double, packet_day date, window_days int"
DAILY = "unit_id long, day date, spend long, purchases long, purchase_value long"


def d(n):
    return date(2024, 1, n)


def rec(i, unit=1, status="COMPLETE", kind="INCREASE_BUDGET", accepted=d(5), spend=100, purchases=10, baseline=1.0):
    return (i, unit, status, kind, accepted, spend, purchases, baseline, accepted, 7)


def run(spark, recs, daily, seasons=()):
    seasons = list(seasons) or [("NONE", date(2000, 1, 1), date(2000, 1, 1))]
    return {r["rec_id"]: r for r in evaluate(spark.createDataFrame(recs, RECS), spark.createDataFrame(daily, DAILY), seasons).collect()}


def test_reasons_come_in_order_and_nulls_are_named(spark):
    recs = [rec(1, status=None), rec(2, accepted=None), rec(3, spend=None, purchases=None), rec(4, unit=None), rec(5, kind=None), rec(6, kind="INSUFFICIENT_DATA"), rec(7, baseline=None), rec(8, unit=77)]
    got = run(spark, recs, [(1, d(6), 500, 50, 900)])
    assert [got[i]["reason"] for i in range(1, 9)] == ["NOT_COMPLETE", "NOT_ACCEPTED", "NO_THRESHOLD", "NO_DECISION_UNIT", "NOTHING_TO_SCORE", "NOTHING_TO_SCORE", "NO_BASELINE", None]
    assert got[8]["state"] == "NOT_YET_ELIGIBLE"


def test_both_thresholds_must_be_met_and_the_day_of_acceptance_does_not_count(spark):
    daily = [(1, d(5), 10**6, 10**3, 1), (1, d(6), 150, 4, 600), (1, d(8), 50, 3, 200), (1, d(8), 50, 13, 200), (1, d(9), 9999, 99, 0)]
    got = run(spark, [rec(1), rec(2, purchases=None), rec(3, spend=10**9)], daily)
    assert (got[1]["met_on"], got[1]["spend"], got[1]["purchases"], got[1]["raw_class"]) == (d(8), 250, 20, "SUCCESS")
    assert got[2]["met_on"] == d(6) and got[3]["state"] == "NOT_YET_ELIGIBLE"


def test_zero_spend_and_too_little_evidence(spark):
    got = run(spark, [rec(1, spend=None), rec(2, unit=2, purchases=None), rec(3, unit=3, purchases=None), rec(4, unit=4, spend=0, purchases=0)], [(1, d(7), 0, 10, 5), (2, d(7), 100, 0, 0), (3, d(7), 100, 1, 99)])
    assert (got[1]["state"], got[1]["reason"]) == ("SKIPPED", "NO_SPEND")
    assert got[2]["raw_class"] == got[3]["raw_class"] == "NEUTRAL"
    assert (got[4]["met_on"], got[4]["reason"]) == (d(6), "NO_SPEND")


def test_a_season_in_one_window_only_confounds(spark):
    daily = [(1, d(6), 500, 50, 9000)]
    assert run(spark, [rec(1)], daily, [("S", d(6), d(6))])[1]["class"] == "SEASONALLY_CONFOUNDED"
    assert run(spark, [rec(1)], daily, [("S", date(2023, 12, 1), d(31))])[1]["class"] == "SUCCESS"
    one = spark.range(1).select(season_set([("B", d(1), d(3)), ("A", d(3), d(4)), ("A", d(2), d(2))], F.lit(d(3)), F.lit(d(3))).alias("x"))
    assert one.first()["x"] == ["A", "B"]


def test_no_recommendations(spark):
    assert run(spark, [], []) == {}
