"""The season calendar and what it says of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dated windows (both days inclusive) of the calendar, with how sure their dates are.
CALENDAR = (
    ("holi", "2025-03-13", "2025-03-14", "confirmed"),
    ("holi", "2026-03-03", "2026-03-04", "estimated"),
    ("akshaya_tritiya", "2025-04-29", "2025-04-30", "estimated"),
    ("akshaya_tritiya", "2026-04-20", "2026-04-21", "estimated"),
    ("raksha_bandhan", "2025-08-09", "2025-08-09", "confirmed"),
    ("raksha_bandhan", "2026-08-28", "2026-08-28", "confirmed"),
    ("ganesh_chaturthi", "2025-08-27", "2025-08-27", "confirmed"),
    ("ganesh_chaturthi", "2026-09-14", "2026-09-14", "confirmed"),
    ("navratri", "2025-09-22", "2025-10-02", "confirmed"),
    ("navratri", "2026-10-11", "2026-10-20", "confirmed"),
    ("dhanteras", "2025-10-17", "2025-10-18", "estimated"),
    ("dhanteras", "2026-11-05", "2026-11-06", "estimated"),
    ("diwali", "2025-10-19", "2025-10-23", "estimated"),
    ("diwali", "2026-11-07", "2026-11-10", "estimated"),
    ("wedding_season", "2024-11-15", "2025-02-15", "estimated"),
    ("wedding_season", "2025-04-15", "2025-06-30", "estimated"),
    ("wedding_season", "2025-11-15", "2026-02-15", "estimated"),
    ("wedding_season", "2026-04-15", "2026-06-30", "estimated"),
    ("wedding_season", "2026-11-15", "2027-02-15", "estimated"),
)


def calendar(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(CALENDAR), "label string, first string, last string, confidence string")
    return rows.select("label", F.to_date("first").alias("first"), F.to_date("last").alias("last"), "confidence")


def labels_of(windows: DataFrame, seasons: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """``windows`` with the sorted labels that each one's days touch. ``seasons`` is a calendar: a few dozen rows."""
    held = seasons.agg(F.collect_list(F.struct("label", "first", "last")).alias("_c"))
    hit = F.filter("_c", lambda s: (s["first"] <= F.col(end)) & (s["last"] >= F.col(start)))
    return windows.join(F.broadcast(held)).withColumn(name, F.array_sort(F.array_distinct(F.transform(hit, lambda s: s["label"])))).drop("_c")


def listed(labels: Column) -> Column:
    """Labels as words: a, b and c."""
    names = F.transform(labels, lambda x: F.replace(x, F.lit("_"), F.lit(" ")))
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(names, -1)))


def context(windows: DataFrame, seasons: DataFrame) -> DataFrame:
    """Windows (start, end, base_start, base_end) with labels, whether window and baseline are of different regimes, and both in words."""
    w = labels_of(labels_of(windows, seasons, "start", "end", "labels"), seasons, "base_start", "base_end", "base_labels")
    w = w.withColumn("spans_boundary", F.col("labels") != F.col("base_labels"))
    own = F.when(F.size("labels") == 0, "window is off-season").otherwise(F.concat(F.lit("window covers "), listed(F.col("labels"))))
    base = F.when(F.size("base_labels") == 0, "baseline is off-season").otherwise(F.concat(F.lit("baseline covers "), listed(F.col("base_labels"))))
    return w.withColumn("summary", F.concat(own, F.lit("; "), base, F.when(F.col("spans_boundary"), "; different seasonal regimes").otherwise(""), F.lit(".")))


def demand(revenue: DataFrame, seasons: DataFrame, lookback: int = 90, most: int = 30, least: int = 7) -> DataFrame:
    """(label, first, season_days, base_days, ratio) of each occurrence: mean revenue of its clean days over that of the
    latest clean off-season days before it. ``revenue``: a row a day (day, revenue, clean), days without sales included.

    The ratio is null with no clean day of the season, fewer than ``least`` days before it, or a zero mean."""
    from pyspark.sql import Window as W

    from tallyforge.functions import exprs as E

    clean = revenue.where("clean").select("day", "revenue")
    dates = seasons.select("label", "first", "last")
    inside = dates.select("label", "first", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    season = inside.join(clean, "day").groupBy("label", "first").agg(F.avg("revenue").alias("_s"), F.count("*").alias("season_days"))
    off = clean.join(inside.select("day").distinct(), "day", "left_anti")
    back = dates.select("label", "first", F.explode(F.sequence(F.lit(1), F.lit(lookback))).alias("_b")).withColumn("day", F.date_sub("first", F.col("_b")))
    latest = back.join(off, "day").withColumn("_r", F.row_number().over(W.partitionBy("label", "first").orderBy("_b"))).where(F.col("_r") <= most)
    base = latest.groupBy("label", "first").agg(F.avg("revenue").alias("_m"), F.count("*").alias("base_days"))
    ok = (F.coalesce("season_days", F.lit(0)) >= 1) & (F.coalesce("base_days", F.lit(0)) >= least) & (F.col("_m") != 0)
    rows = dates.join(season, ["label", "first"], "left").join(base, ["label", "first"], "left")
    return rows.select("label", "first", F.coalesce("season_days", F.lit(0)).alias("season_days"), F.coalesce("base_days", F.lit(0)).alias("base_days"), F.when(ok, E.ratio(F.col("_s"), F.col("_m"))).alias("ratio"))


def demand_index(occurrences: DataFrame, needed: int = 2) -> DataFrame:
    """(label, usable, demand): the mean ratio of a label with at least ``needed`` usable occurrences."""
    by = occurrences.groupBy("label").agg(F.count("ratio").alias("usable"), F.avg("ratio").alias("_mean"))
    return by.select("label", "usable", F.when(F.col("usable") >= needed, F.col("_mean")).alias("demand"))


def demand_of(windows: DataFrame, occurrences: DataFrame, labels: str = "labels", needed: int = 2) -> DataFrame:
    """``windows`` (start, labels, ...) with demand and usable: the mean ratio of all usable occurrences of the window's labels if there are
    at least ``needed``, and how many there are. A window without labels has the demand 1 and none."""
    usable = occurrences.where("ratio IS NOT NULL").groupBy("label").agg(F.count("*").alias("_n"), F.sum("ratio").alias("_sum"))
    per = windows.select("start", F.explode(labels).alias("label")).join(usable, "label").groupBy("start").agg(F.sum("_n").alias("usable"), F.sum("_sum").alias("_sum"))
    off, n = F.size(labels) == 0, F.coalesce("usable", F.lit(0))
    rows = windows.join(per, "start", "left")
    return rows.withColumn("demand", F.when(off, F.lit(1.0)).when(n >= needed, F.col("_sum") / n)).withColumn("usable", n).drop("_sum")
