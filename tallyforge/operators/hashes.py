"""Families of near perceptual hashes of any length, by bands of bits (pigeonhole) and a check of the distance."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.config import CANON
from tallyforge.functions import exprs as E
from tallyforge.operators.components import connected_components
from tallyforge.runtime import table

#: Distinct hashes for which the number of bands is chosen; no link depends on it.
EXPECTED = 100_000


@functools.lru_cache(maxsize=1024)
def bands(bits: int, limit: int) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks) of bands: two hashes within ``limit`` differ by one of the masks in some band."""

    def parts(m: int) -> list[tuple[int, int]]:
        ends = [bits * i // m for i in range(m + 1)]
        return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]

    def cost(m: int) -> float:
        near = [(sum(comb(w, r) for r in range(min(w, limit // m) + 1)), w) for _, w in parts(m)]
        return sum(n + EXPECTED * n / 2.0**w for n, w in near)

    m = min(range(1, min(limit + 1, bits) + 1), key=cost)
    flips = lambda w: [sum(1 << i for i in at) for r in range(min(w, limit // m) + 1) for at in combinations(range(w), r)]
    return [(a, w, flips(w)) for a, w in parts(m)]


def _pieces(limit: int, near: bool):
    """Each band's value of each hash, or with ``near`` the values that its partners' bands may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, piece, text = [], [], [], []
            for h in batch.column("hash").to_pylist():
                x = int(h, 16)
                for i, (shift, width, masks) in enumerate(bands(4 * len(h), limit)):
                    own = (x >> shift) & ((1 << width) - 1)
                    found = [f"{own ^ m:x}" for m in masks] if near else [f"{own:x}"]
                    piece += found
                    size += [len(h)] * len(found)
                    at += [i] * len(found)
                    text += [h] * len(found)
                if len(text) > 100_000:
                    yield pa.record_batch({"size": pa.array(size, pa.int32()), "at": pa.array(at, pa.int32()), "piece": piece, "hash": text})
                    size, at, piece, text = [], [], [], []
            if text:
                yield pa.record_batch({"size": pa.array(size, pa.int32()), "at": pa.array(at, pa.int32()), "piece": piece, "hash": text})

    return run


def near_hashes(hashes: DataFrame, limit: int = CANON.hamming_limit, column: str = "hash") -> DataFrame:
    """(x, y): all pairs x < y of distinct hex hashes (lower case) of equal length within ``limit`` bits."""
    h = F.lower(F.col(column))
    own = table(hashes.select(h.alias("hash")).where(F.col("hash").rlike("^[0-9a-f]+$")).distinct(), "hashes")
    schema = "size int, at int, piece string, hash string"
    at = ["size", "at", "piece"]
    a = own.mapInArrow(_pieces(limit, True), schema).withColumnRenamed("hash", "x")
    b = own.mapInArrow(_pieces(limit, False), schema).withColumnRenamed("hash", "y")
    return a.join(b, at).where((F.col("x") < F.col("y")) & (E.hamming(F.col("x"), F.col("y")) <= limit)).select("x", "y").distinct()


def families(assets: DataFrame, limit: int = CANON.hamming_limit, key: str = "asset", column: str = "hash") -> DataFrame:
    """(key, family, variations) of distinct keys with their hashes: family is the least key linked by hashes
    within ``limit`` bits. Null hashes and such that are not hex link with nothing."""
    h = F.lower(F.col(column))
    rows = assets.select(key, F.when(h.rlike("^[0-9a-f]+$"), h).alias("_hash"))
    # Equal hashes are one node; keys without a hash are one each.
    node = F.when(F.col("_hash").isNotNull(), F.xxhash64(F.lit("hash"), "_hash")).otherwise(F.xxhash64(F.lit("key"), F.col(key)))
    rows = table(rows.withColumn("_node", node), "hash-assets")
    edges = near_hashes(rows, limit, "_hash").select(F.xxhash64(F.lit("hash"), "x").alias("a"), F.xxhash64(F.lit("hash"), "y").alias("b"))
    found = rows.join(connected_components(edges).toDF("_node", "_c"), "_node", "left").select(key, F.coalesce("_c", "_node").alias("_c"))
    least = found.groupBy("_c").agg(F.min(key).alias("family"), F.count("*").alias("variations"))
    return found.join(least, "_c").select(key, "family", "variations")
