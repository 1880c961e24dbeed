"""Window totals at any as-of days, from running sums: a window is the difference of two of them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def windows_at(daily: DataFrame, spine: DataFrame, key: list[str], measures: tuple[str, ...], as_of: list[date], windows: tuple[int, ...]) -> DataFrame:
    """(key, as_of, days, measures): totals of the ``days`` up to each as-of day, for every row of ``spine`` (key), zeros where nothing happened.

    ``daily`` (key, day, measures) is summed by key and day, then merged with the days at which running sums are needed
    (at most one an as-of day and edge of a window): one shuffle by key, and no fact is repeated for windows or days. Each
    key's sums at those days become one map, from which its windows are read. Days outside all windows are left out by the scan's bounds."""
    need = sorted({d for t in as_of for d in (t, *(t - timedelta(n) for n in windows))})
    inside = daily.where(F.col("day").between(F.lit(need[0] + timedelta(1)), F.lit(need[-1])))
    facts = inside.groupBy(*key, "day").agg(*[F.sum(m).alias(m) for m in measures])
    asked = spine.select(*key, F.explode(F.array(*map(F.lit, need))).alias("day"), *[F.lit(0).cast("long").alias(m) for m in measures], F.lit(True).alias("_asked"))
    rows = facts.select(*key, "day", *[F.col(m).cast("long").alias(m) for m in measures], F.lit(False).alias("_asked")).unionByName(asked)
    upto = W.partitionBy(*key).orderBy("day").rangeBetween(W.unboundedPreceding, 0)
    sums = rows.select(*key, "day", "_asked", F.struct(*[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(m) for m in measures]).alias("_s")).where("_asked")
    held = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("day", "_s"))).alias("_at"))
    pairs = F.array(*[F.struct(F.lit(t).alias("as_of"), F.lit(n).alias("days"), F.lit(t - timedelta(n)).alias("_from")) for t in as_of for n in windows])
    out = held.select(*key, "_at", F.inline(pairs))
    return out.select(*key, "as_of", "days", *[(F.element_at("_at", F.col("as_of"))[m] - F.element_at("_at", F.col("_from"))[m]).alias(m) for m in measures])
