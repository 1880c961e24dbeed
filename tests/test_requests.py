"""Tables of requests on small tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import lookups

REQ = "request_id long, entity_type string, entity_id long, days int"
SNAP = "entity_type string, entity_id long, owner string, daily long, lifetime long, status string"


@pytest.fixture(scope="module")
def ads(spark):
    return spark.createDataFrame([(1, 10, 100, 7, "one"), (2, 10, 100, 8, "two"), (3, 11, 100, 7, "three"), (4, 12, 101, 7, "four"), (5, 13, 102, 7, "five")], "ad_id long, adset_id long, campaign_id long, family_id long, name string")


def snap(kind, i, owner, daily=None, lifetime=None, status="O"):
    return (kind, i, owner, daily, lifetime, status)


def test_budget_owner_of_ads_sets_and_campaigns(spark, ads):
    rows = [snap("CAMPAIGN", 100, None), snap("ADSET", 10, "ADSET", 5), snap("ADSET", 11, "UNKNOWN"), snap("CAMPAIGN", 101, "CAMPAIGN", None, 9), snap("ADSET", 12, None), snap("CAMPAIGN", 102, "UNKNOWN"), snap("ADSET", 13, None)]
    asked = [(1, "AD", 1, 7), (2, "ADSET", 10, 7), (3, "CAMPAIGN", 100, 7), (4, "AD", 3, 7), (5, "ADSET", 12, 7), (6, "AD", 4, 7), (7, "CAMPAIGN", 101, 7), (8, "CAMPAIGN", 102, 7), (9, "AD", 5, 7), (10, "AD", 99, 7), (11, "CAMPAIGN", 99, 7), (12, "ADSET", 99, 7)]
    got = {r["request_id"]: (r["unit_type"], r["unit_id"], r["daily"], r["lifetime"], r["escalated"]) for r in lookups.budget_owner(spark.createDataFrame(asked, REQ), spark.createDataFrame(rows, SNAP), ads).collect()}
    assert got[1] == ("ADSET", 10, 5, None, True) and got[2] == ("ADSET", 10, 5, None, False) and got[3] == ("ADSET", 10, 5, None, True)
    assert got[5] == got[6] == ("CAMPAIGN", 101, None, 9, True) and got[7] == ("CAMPAIGN", 101, None, 9, False)
    assert all(got[i] == (None, None, None, None, False) for i in (4, 8, 9, 10, 11, 12))


def test_a_campaign_with_two_owning_sets_has_no_unit(spark, ads):
    rows = [snap("CAMPAIGN", 100, None), snap("ADSET", 10, "ADSET", 5), snap("ADSET", 11, "ADSET", 6)]
    got = lookups.budget_owner(spark.createDataFrame([(1, "CAMPAIGN", 100, 7)], REQ), spark.createDataFrame(rows, SNAP), ads).first()
    assert got["unit_type"] is None


def test_campaign_context_counts_active_children(spark, ads):
    rows = [snap("CAMPAIGN", 100, "CAMPAIGN", 1), snap("ADSET", 10, None, status="O"), snap("ADSET", 11, None, status="F"), snap("AD", 1, None), snap("AD", 2, None, status="F")]
    got = {r["request_id"]: tuple(r)[1:] for r in lookups.campaign_context(spark.createDataFrame([(1, "CAMPAIGN", 100, 7), (2, "CAMPAIGN", 55, 7), (3, "AD", 1, 7)], REQ), spark.createDataFrame(rows, SNAP), ads, F.col("status") == "O").collect()}
    assert got == {1: (100, "O", True, 2, 1, 3, 1), 2: (55, None, False, 0, 0, 0, 0)}


def test_performance_reads_only_what_is_asked_for(spark, ads):
    asked = spark.createDataFrame([(1, "ADSET", 10, 7), (2, "CAMPAIGN", 100, 14), (3, "AD", 77, 7), (4, "ADSET", 10, 7)], REQ)
    cols = "ad_id long, day date, impressions long, reach long, clicks long, landings long, carts long, checkouts long, purchases long, spend long, purchase_value long"
    facts = spark.createDataFrame([(1, date(2024, 1, 30), 10, 5, 1, 1, 1, 1, 1, 100, 300), (2, date(2024, 1, 20), 4, None, 1, 1, 1, 1, 0, 50, 0), (4, date(2024, 1, 30), 9, 9, 9, 9, 9, 9, 9, 9, 9)], cols)
    seen = []

    def delivery(only):
        seen.append(sorted(r["ad_id"] for r in only.distinct().collect()))
        return facts.join(only.distinct(), "ad_id", "left_semi")

    orders = spark.createDataFrame([(5, date(2024, 1, 29), 1000), (6, date(2024, 1, 18), 500), (7, date(2023, 1, 1), 7)], "order_id long, day date, gross long")
    refunds = spark.createDataFrame([(6, date(2024, 1, 28), 70)], "order_id long, day date, refund long")
    matched = lambda some: spark.createDataFrame([("ADSET", 10, 5), ("CAMPAIGN", 100, 5), ("CAMPAIGN", 100, 6), ("CAMPAIGN", 100, 7), ("CAMPAIGN", 101, 6)], "entity_type string, entity_id long, order_id long")
    got = {r["request_id"]: r for r in lookups.performance(asked, ads, delivery, orders, refunds, matched).collect()}
    assert seen == [[1, 2, 3]]
    assert (got[1]["spend"], got[1]["orders"], got[1]["gross"], got[1]["refunds"], got[1]["roas"], got[1]["frequency"]) == (100, 1, 1000, 0, 3.0, 2.0)
    assert (got[2]["spend"], got[2]["orders"], got[2]["gross"], got[2]["refunds"]) == (150, 2, 1500, 70) and tuple(got[4])[4:] == tuple(got[1])[4:]
    assert (got[3]["found"], got[3]["delivering"], got[3]["spend"], got[3]["roas"]) == (False, False, 0, None)


def test_recent_changes_of_entities_without_any(spark):
    ev = spark.createDataFrame([("AD", 1, 3, date(2025, 1, 3), "STATUS", None), ("AD", 1, 2, date(2025, 1, 2), "BUDGET", 5.0), ("AD", 1, 4, date(2025, 1, 4), "BUDGET", None)], "entity_type string, entity_id long, run long, detected_on date, field string, percent double")
    got = {r["request_id"]: r for r in lookups.recent_changes(spark.createDataFrame([(1, "AD", 1, 7), (2, "AD", 2, 7)], REQ), ev).collect()}
    assert (got[1]["budget_changes"], got[1]["last_budget"], got[1]["status_changes"], got[2]["budget_changes"], got[2]["last_budget"]) == (2, date(2025, 1, 4), 1, 0, None)


def test_evidence_document_of_the_unit_that_owns_the_budget(spark):
    from tallyforge.operators import evidence

    cols = "entity_type string, entity_id long, days int, impressions long, clicks long, landings long, carts long, checkouts long, purchases long, spend long, purchase_value long, reach long, gross long"
    good, idle = (100, 10, 5, 4, 3, 90, 1000, 2000, 50, 10), (0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    rows = [("ADSET", 10, n, *good) for n in (7, 14, 28, 56)] + [("CAMPAIGN", 101, n, *good) for n in (7, 14, 28, 56)] + [("ADSET", 13, n, *idle) for n in (7, 14, 28, 56)]
    windows = evidence.window_facts(spark.createDataFrame(rows, cols))
    ev = [("ADSET", 10, date(2024, 1, 28), "BUDGET", 25.0, True), ("ADSET", 10, date(2024, 2, 3), "STATUS", None, False), ("CAMPAIGN", 101, date(2024, 1, 1), "TARGETING", None, False)]
    changed = evidence.change_facts(spark.createDataFrame(ev, "entity_type string, entity_id long, detected_on date, field string, percent double, material boolean"))
    bought = [("ADSET", 10, date(2024, 1, 27), 60), ("ADSET", 10, date(2024, 1, 29), 20)]
    learning = evidence.learning_facts(spark.createDataFrame(bought, "entity_type string, entity_id long, day date, purchases long"), changed)
    owners = [(1, "AD", 1, "ADSET", 10, True), (2, "CAMPAIGN", 101, "CAMPAIGN", 101, False), (3, "ADSET", 13, "ADSET", 13, False), (4, "AD", 9, None, None, False), (5, "ADSET", 77, "ADSET", 77, False)]
    own = spark.createDataFrame(owners, "request_id long, entity_type string, entity_id long, unit_type string, unit_id long, escalated boolean").withColumn("daily", F.lit(5).cast("long")).withColumn("lifetime", F.lit(None).cast("long"))
    season = F.struct(F.array(F.lit("holi")).alias("labels"))
    got = {r["request_id"]: r for r in evidence.documents(own, windows, changed, learning, season).collect()}
    assert [got[i]["outcome"] for i in range(1, 6)] == ["EVIDENCE", "EVIDENCE", "NOT_DELIVERING", "NO_DECISION_UNIT", "NOT_DELIVERING"]
    assert got[3]["document"] is None and got[4]["document"] is None
    a, b = got[1]["document"], got[2]["document"]
    assert a["escalated_from"]["type"] == "AD" and a["unit"]["daily"] == 5 and sorted(a["windows"]) == [7, 14, 28, 56] and a["season"]["labels"] == ["holi"]
    assert a["decision"]["reasons"] == ["IN_LEARNING_PHASE", "RECENT_MAJOR_CHANGE"] and a["decision"]["percent"] is None
    # A material budget change starts the count anew: only what came from its day on counts.
    assert (a["learning"]["active"], a["learning"]["to_exit"], a["changes"]["hours_since_budget"], a["changes"]["last_budget_percent"]) == (True, 30, 72.0, 25.0)
    assert (b["decision"]["eligible"], b["decision"]["confidence"], b["decision"]["percent"], b["escalated_from"], b["learning"]) == (True, 0.9, 14, None, None)
    assert a["windows"][28]["verdict"] == "ABOVE_TARGET" and a["windows"][28]["roas"] == 2.0 and a["windows"][28]["store_roas"] == 0.01


def test_names_are_found_by_any_part_of_them(spark):
    rows = [("P", 1, "Red ABBA car"), ("P", 2, "abbey"), ("Q", 3, "ab"), ("Q", 4, None), ("Q", 5, ""), ("Q", 6, "éÉx")]
    terms = [(1, "ABB"), (2, "b"), (3, "abbey road"), (4, ""), (5, None), (6, "ba c"), (7, "éx"), (8, "AB")]
    got = lookups.by_name(spark.createDataFrame(terms, "q long, term string"), spark.createDataFrame(rows, "kind string, id long, name string"))
    want = {(q, i) for q, t in terms for _, i, n in rows if t and n and t.lower() in n.lower()}
    assert {(r["q"], r["id"]) for r in got.collect()} == want and got.count() == len(want)
    assert lookups.by_name(spark.createDataFrame([], "q long, term string"), spark.createDataFrame(rows, "kind string, id long, name string")).count() == 0
