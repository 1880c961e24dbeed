"""Importance resampling of documents towards a target distribution over hashed word features.

Identical texts are collapsed by grouping the full text (counted before the shuffle); each distinct text is split
and hashed once and its buckets are kept in two bytes each. Bucket counts of the corpus multiply each text's counts
by its number of copies. A bucket's gain is the scaled logarithm of target share over corpus share, with one added
to every bucket; a text's weight is the mean gain of its features. Weights go back to documents by the SHA-256 of the
text; texts with over a ``HOT``-th of all rows (so fewer than ``HOT``) are broadcast, the others joined by a shuffle.
Then each document adds its own noise, and the highest scores are drawn. Places come from the counts of
the integer scores, so no task orders all rows.

Null texts are empty: no features, weight 0. A null id counts as empty in the noise and goes last among equal
scores. Rows that repeat id and text get one place each. An empty target leaves the gains to the corpus counts.
No rows give no rows. Counts of all buckets are an array in each task and on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.crc import crc32
from tallyforge.llm.kernels import chunks, column, lower
from tallyforge.runtime import sized, table

BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: A text with more than this part of all rows is hot.
HOT = 10_000
#: Repeated rows that are given places together.
TOGETHER = 65_536

_word = np.zeros(256, bool)
_word[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_blank = np.array([0x20], np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of neighbouring words of lower-cased texts, in order, and how many each text has."""
    own = _word[data]
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = own[inner]
    last[inner - 1] = own[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = np.diff(np.searchsorted(start, offsets))
    one = crc32(data, start, end)
    out = np.empty((len(start), 2), np.uint32)
    out[:, 0] = one
    zero = np.zeros(max(0, len(start) - 1), np.int64)
    out[:-1, 1] = crc32(data, start[1:], end[1:], crc32(_blank, zero, zero + 1, one[:-1]))
    keep = np.ones((len(start), 2), bool)
    keep[np.cumsum(n)[n > 0] - 1, 1] = False
    return out[keep] % np.uint32(buckets), np.maximum(0, 2 * n - 1)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def featured(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``texts`` (m, key, text) with the text replaced by n_features and its buckets, two bytes each (four if many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(2))
            for i, j in chunks(offsets, 1 << 22):
                found, n = features(lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], buckets)
                raw = found.astype(_kind(buckets))
                at = np.concatenate(([0], np.cumsum(n))) * raw.itemsize
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(raw)])
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), held.cast(pa.binary())], names=["m", "key", "n_features", "buckets"])

    return texts.mapInArrow(run, "m long, key binary, n_features long, buckets binary")


def bucket_counts(held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``held`` (m, buckets), each text m times. At most a row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(1))
            found = data.view(_kind(buckets))
            n = np.zeros(buckets, np.int64)
            m, size = batch.column(0).to_numpy(), np.diff(offsets) // found.itemsize
            # Texts with equally many copies are counted together, so counts stay whole numbers.
            for copies in np.unique(m):
                n += copies * np.bincount(found[np.repeat(m == copies, size)], minlength=buckets)
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in held.select("m", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) for each bucket."""
    s, t, size = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(scale * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighted(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, m, n_features, weight): the floored mean gain over each text's features (0 if it has none)."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(3))
            n = batch.column(2).to_numpy()
            sums = np.concatenate(([0], np.cumsum(gain[data.view(kind)])))
            total = sums[np.cumsum(n)] - sums[np.cumsum(n) - n]
            yield pa.record_batch([batch.column(1), batch.column(0), batch.column(2), pa.array(total // np.maximum(n, 1))], names=["key", "m", "n_features", "weight"])

    return held.select("m", "key", "n_features", "buckets").mapInArrow(run, "key binary, m long, n_features long, weight long")


def noise(key: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise of an id, from the first 32 bits of a SHA-256, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(u))).cast("long")


def places(scored: DataFrame, n: int) -> DataFrame:
    """``scored`` (id, n_features, weight, score) with its rank by score, ties by id, if it is among the first ``n``, else null."""
    columns = ["id", "n_features", "weight", "score"]
    same = table(scored.groupBy(*columns).agg(F.count("*").alias("c")), "resampling-same")
    per = same.groupBy("score").agg(F.sum("c").alias("c")).withColumn("wide", F.floor(F.col("score") / 64))
    per = table(per, "resampling-scores")
    # Scores are whole numbers in a range that logarithms bound; sums over wide steps first, then inside each.
    ahead = lambda by: F.coalesce(F.sum("c").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wide = per.groupBy("wide").agg(F.sum("c").alias("c")).withColumn("_wide", ahead(W.orderBy(F.desc("wide")))).drop("c")
    before = per.join(wide, "wide").select("score", (F.col("_wide") + ahead(W.partitionBy("wide").orderBy(F.desc("score")))).alias("_before"))
    before = table(before, "resampling-before")
    group = W.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    at = same.join(sized(before), "score").withColumn("_at", F.col("_before") + ahead(group))
    many = at.where(F.col("c") > TOGETHER).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(TOGETHER).cast("long")))).repartition("id", "_part")
    parts = at.where(F.col("c") <= TOGETHER).withColumn("_part", F.lit(0).cast("long")).unionByName(many)
    own = parts.withColumn("_i", F.explode(F.sequence("_part", F.least(F.col("c"), F.col("_part") + TOGETHER) - 1)))
    rank = F.col("_at") + F.col("_i") + 1
    return own.select(*columns, F.when(rank <= n, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, scale: int = SCALE, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """A row a document: key, n_features, weight, score, rank (of the ``percent`` drawn, else null). ``target`` has ``text``."""
    digest = lambda c: F.unhex(F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256))

    def held(rows: DataFrame) -> DataFrame:
        texts = rows.groupBy(F.coalesce(F.col(text), F.lit("")).alias("_text")).agg(F.count("*").alias("m"))
        return table(featured(texts.select("m", digest(F.col("_text")).alias("key"), "_text"), buckets), "resampling-features", "zstd")

    own = held(docs)
    gain = gains(bucket_counts(own, buckets), bucket_counts(held(target), buckets), scale)
    weights = table(weighted(own, gain), "resampling-weights")
    ids = table(docs.select(F.col(key).cast("long").alias("id"), digest(F.col(text)).alias("key")), "resampling-ids")
    hot = F.col("m") * HOT > ids.count()
    marked = ids.join(F.broadcast(weights.where(hot).drop("m")), "key", "left")
    cold = marked.where("weight IS NULL").select("id", "key").join(weights.where(~hot).drop("m"), "key")
    of = marked.where("weight IS NOT NULL").unionByName(cold.select(*marked.columns)).drop("key")
    scored = table(of.withColumn("score", F.col("weight") + noise(F.col("id"), seed, scale)), "resampling-scored")
    able = F.col("n_features") >= 2 * least_words - 1
    drawn = places(scored.where(able), scored.where(able).count() * percent // 100)
    rest = scored.where(~able).select(*drawn.columns[:-1], F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", key)


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns, with distinct keys (rows that repeat a key are all taken if one is)."""
    drawn = resample(docs, target, key, **options).where("rank IS NOT NULL").select(F.col(key).alias("_key")).distinct()
    return docs.join(drawn, F.col(f"`{key}`").cast("long").eqNullSafe(F.col("_key")), "left_semi")
