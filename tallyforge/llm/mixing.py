"""Mixing sources to target weights by Pareto order sampling.

A source with target t and size S owes each of its documents r = t / S copies. floor(r) whole copies are
certain; the rest, with inclusion odds f / (1 - f) for f = r - floor(r), is a fixed-size sample: documents
are ranked by their random odds divided by the inclusion odds and taken in that order until the source's
remaining words are met (the last one in part, so a source meets its target to the word). Random numbers come from a digest of the
id, so reruns agree. Built-in functions only.

The inclusion odds are those of a source, so documents of one source are equally likely to be taken.

Null texts have size 0 and are never taken; a null source is a source of its own, after all others. Rows
with equal ids draw equal numbers and are ranked by size; where rows of equal id and size are the last of a sample, its
remaining words are shared equally (less than one word a row is left). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.text import n_words
from tallyforge.runtime import sized, table

MAX_COPIES = 3
OWN = ("source", "size", "source_size", "target", "copies", "taken")
#: Steps of the rank scale on which the boundary of each sample is located before rows are ordered.
RANK_STEPS = 4096


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of ``seed:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) with targets by weight, stopped at ``max_copies`` times the size.

    ``sizes`` has source and size. The excess of stopped sources is reshared by weight: with sources in the
    order of limit / weight, those before the first one that its share leaves below its limit are stopped.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = by.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_copies))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = W.orderBy("_ratio", "_n").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("_ratio", "_n").rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    listed = listed.withColumn("_share", share).withColumn("_free", F.col("_share") <= F.col("_ratio"))
    level = F.min_by(F.when(F.col("_free"), F.col("_share")), F.when(F.col("_free"), F.struct("_ratio", "_n"))).over(everything)
    return listed.select("source", "source_size", F.when(F.col("_free"), level * F.col("_w")).otherwise(F.col("_cap")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: key, size, source_size, target, copies (whole ones) and taken (words, the last in part), and the columns
    of ``keep``; one named like a column of the result comes as ``kept_<name>``."""
    clash = {c: f"kept_{c}" for c in keep if c in OWN}
    if clash:
        docs, keep = docs.withColumns({new: F.col(old) for old, new in clash.items()}), tuple(clash.get(c, c) for c in keep)
    sizes = lambda *more: docs.select(F.col(key).alias("_key"), "source", n_words(F.col("text")).alias("size"), *more)
    base = table(sizes(), "mix-sizes")
    return select_copies(sizes(*keep) if keep else base, base, seed, weights, keep).withColumnRenamed("_key", key)


def select_copies(rows: DataFrame, base: DataFrame, seed: str, weights: tuple[int, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each of ``rows`` (_key, source, size, keep), from the sizes in ``base``.

    The last document of a source's sample is found among the ids of one rank step; every row then decides by its own rank,
    so rows (and their texts) are not moved."""
    targets = table(source_targets(base, weights), "mix-targets")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = targets.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"), "source_size", "target", F.floor(r).alias("_whole"), (r - F.floor(r)).alias("_f"))

    def ranked(rows: DataFrame, per: DataFrame) -> DataFrame:
        keyed = rows.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull()).drop("source")
        u = uniform(F.col("_key"), seed)
        q = F.when(F.col("_f") > 0, (u / (1 - u)) / (F.col("_f") / (1 - F.col("_f"))))
        return keyed.join(sized(per), ["_s", "_null"]).withColumn("_q", q)

    at = ["_s", "_null"]
    step = F.least(F.lit(RANK_STEPS - 1), F.floor(F.col("_q") / (1 + F.col("_q")) * RANK_STEPS)).cast("int")
    drawn = ranked(base, per).where("_q IS NOT NULL").withColumn("_step", step)
    steps = drawn.groupBy(*at, "_step").agg(F.sum("size").alias("_words"), F.first(F.col("target") - F.col("_whole") * F.col("source_size")).alias("_left"))
    steps = steps.withColumn("_upto", F.coalesce(F.sum("_words").over(W.partitionBy(*at).orderBy("_step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # The step in which the remaining words run out: the last one that starts before them.
    edge = steps.where(F.col("_upto") <= F.col("_left")).groupBy(*at).agg(F.max(F.struct("_step", "_upto", "_left")).alias("_e"))
    edge = table(edge.select(*at, F.col("_e._step").alias("_step"), F.col("_e._upto").alias("_upto"), F.round("_e._left").cast("long").alias("_left")), "mix-edges")
    # Rows that tie (equal key, so equal number, and equal size) share what their place in the order gets.
    ties = drawn.join(sized(edge), [*at, "_step"]).groupBy(*at, "_q", "_key", "size").agg(F.count("*").alias("_c"), F.first("_left").alias("_left"), F.first("_upto").alias("_upto"))
    before = F.col("_upto") + F.coalesce(F.sum(F.col("size") * F.col("_c")).over(W.partitionBy(*at).orderBy("_q", "_key", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ties = ties.withColumn("_rest", F.col("_left") - before).where("_rest > 0")
    place = F.struct(F.col("_q").alias("q"), F.col("_key").alias("key"), F.col("size").alias("size"))
    last = ties.groupBy(*at).agg(F.max_by(F.struct(place.alias("place"), F.least("size", F.floor(F.col("_rest") / F.col("_c"))).alias("part")), place).alias("_last"))
    out = ranked(rows, table(per.join(last, at, "left"), "mix-places"))
    extra = F.when(F.col("_q").isNull() | F.col("_last").isNull(), 0).when(place < F.col("_last.place"), F.col("size")).when(place == F.col("_last.place"), F.col("_last.part")).otherwise(0)
    out = out.withColumn("_extra", extra)
    copies = F.when(F.col("size") > 0, F.col("_whole") + (F.col("_extra") == F.col("size")).cast("int")).otherwise(0).cast("long")
    return out.select("_key", *keep, "size", "source_size", "target", copies.alias("copies"), (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs``, all columns, repeated as often as the mix takes them whole; a document taken in
    part counts as whole from half its words on."""
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row")
    picked = mix(docs.select("doc_id", "source", "text", row), seed=seed, weights=weights, keep=("_row",))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return picked.where("2 * taken >= size AND size > 0").select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select("_row.*")
