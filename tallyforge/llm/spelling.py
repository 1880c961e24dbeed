"""Spelling variants by rolling-hash deletions.

Words are counted in tasks (Arrow counts a batch, Spark sums). Each distinct word gives one integer key for every
code point that may be deleted, made of the polynomial hash of what stands before it and of what stands behind it,
and one key of the whole word; all keys of a batch come from two running sums. Keys are radix-partitioned by their
high bits and sorted, and one pass over each partition keeps the runs that hold two different words. What is left
is looked up and decided on the strings: words that agree once the code point at the same place is gone differ by a
replacement, and a word equal to another with one code point gone differs by an insertion. Each group reports sums
and its best words to its members, never pairs.

A word's form is the near word with most occurrences, if it has ``ratio`` times the word's own; roots are found by
pointer jumping over forms.

Nulls have no words; an id that is null counts as empty before the colon. Repeated rows count again, with equal
slips. Words of any length are kept whole: keys carry the word's number, not its letters. Equal counts go to the
first in code-point order. No words give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.crc import crc32, of_bytes
from tallyforge.llm.kernels import U, chunks, column, lower, mix, powers
from tallyforge.runtime import table

SLIP = 199
LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
#: Bytes of words whose keys are made at a time.
KEY_BYTES = 1 << 20

_LATIN_LEAD = 0xC3
_letter = np.zeros(256, bool)
_letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), _LATIN_LEAD]] = True


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of the maximal runs of letters in each text, and the text of each run."""
    own = _letter[data]
    own[1:] |= data[:-1] == _LATIN_LEAD
    first, last = own.copy(), own.copy()
    first[1:] &= ~own[:-1]
    last[:-1] &= ~own[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = own[inner]
    last[inner - 1] = own[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)))


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as an Arrow array of strings."""
    size = end - start
    at = _before(size)
    where = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[where])))


def _slipped(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: np.ndarray, crc: np.ndarray) -> list[str]:
    out = []
    for i in which.tolist():
        run = data[start[i] : end[i]].tobytes().decode()
        gone = int(crc[i]) % len(run)
        out.append(run[:gone] + run[gone + 1 :])
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n): the words of at least ``least_chars`` code points and how often each occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in chunks(offsets, 1 << 22):
                part, off = lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                start, end, doc = _runs(part, off)
                chars = end - start - np.diff(_before(part == _LATIN_LEAD)[np.stack((start, end), 1)])[:, 0]
                long = chars >= least_chars
                start, end, doc, chars = start[long], end[long], doc[long], chars[long]
                prefix = of_bytes([b"%s:" % (b"" if k is None else str(k).encode()) for k in ids[i:j]])
                crc = crc32(part, start, end, prefix[doc])
                hit = crc % np.uint32(slip) == 0
                cut = [w for w in _slipped(part, start, end, np.flatnonzero(hit), crc) if len(w) >= least_chars]
                words = pa.chunked_array([_gathered(part, start[~hit], end[~hit]), pa.array(cut, pa.large_string())])
                found = pc.value_counts(words)
                yield pa.record_batch([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words and where each word begins (and the end)."""
    text = "".join(words.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return points, _before(pc.utf8_length(words).to_numpy(zero_copy_only=False))


def deletion_keys(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, place): a key for every code point of every word, as if it were not there, and one of the whole
    word (place -1). Equal strings have equal keys."""
    p, inv = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, U)
    np.cumsum(mix(points.astype(U) + U(1)) * p[: len(points)], out=sums[1:])
    size = np.diff(at)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(points))
    prefix = sums[place] - sums[at[word]]
    # What stands behind moves one place forward when the code point goes.
    suffix = (sums[at[word + 1]] - sums[place + 1]) * inv[1] if len(points) else prefix
    mark = lambda n: n.astype(U) * U(0xD6E8FEB86659FD93)
    gone = mix((prefix + suffix) * inv[at[word]] + mark(size[word] - 1))
    whole = mix((sums[at[1:]] - sums[at[:-1]]) * inv[at[:-1]] + mark(size))
    return np.concatenate((gone, whole)), np.concatenate((word, np.arange(len(size)))), np.concatenate((place - at[word], np.full(len(size), -1)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1)
        _, offsets = column(words)
        for i, j in chunks(offsets, KEY_BYTES):
            key, word, place = deletion_keys(*_points(words.slice(i, j - i)))
            for a in range(0, len(key), KEY_BYTES):
                at = slice(a, a + KEY_BYTES)
                yield pa.record_batch([pa.array(key[at].view(np.int64)), pa.array(ids[i:j][word[at]]), pa.array(place[at].astype(np.int32))], names=["key", "wid", "place"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key two different words share. The last run waits for the next batch."""
    names = ["key", "wid", "place"]
    held: list[np.ndarray] | None = None

    def shared(cols: list[np.ndarray]) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        many = np.minimum.reduceat(cols[1], first) != np.maximum.reduceat(cols[1], first)
        keep = np.repeat(many, np.diff(np.append(first, len(cols[0]))))
        return pa.record_batch([pa.array(c[keep]) for c in cols], names=names)

    for batch in batches:
        cols = [batch.column(n).to_numpy() for n in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))[-1])
        held = [c[last:] for c in cols]
        if last:
            yield shared([c[:last] for c in cols])
    if held is not None and len(held[0]):
        yield shared(held)


def _gone(word: Column, place: Column) -> Column:
    return F.when(place < 0, word).otherwise(F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words of ``words`` (wid, word, n) are one edit away, and the one with largest n
    as (less: minus n, word). Words without a near one have no row."""
    radix = F.shiftrightunsigned("key", 44)
    dealt = words.select("wid", "word").mapInArrow(_keyed, "key long, wid long, place int")
    met = dealt.repartition(radix).sortWithinPartitions("key").mapInArrow(_met, "key long, wid long, place int").select("wid", "place")
    held = table(met.join(words, "wid").select("word", "n", "place", _gone(F.col("word"), F.col("place")).alias("left")), "spelling-met")
    best = lambda n, w: F.struct((-F.col(n)).alias("less"), F.col(w).alias("word"))
    # Replaced: all that agree without the code point at one place. The best of the others is the first, or the second for the first.
    group = W.partitionBy("left", "place")
    ranked = group.orderBy(F.desc("n"), "word")
    by_place = held.where("place >= 0").withColumn("_g", F.count("*").over(group)).where("_g > 1")
    over = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one, two = F.nth_value(F.struct("n", "word"), 1).over(over), F.nth_value(F.struct("n", "word"), 2).over(over)
    other = by_place.withColumn("_one", one).withColumn("_two", two).withColumn("_o", F.when(F.col("_one.word") == F.col("word"), F.col("_two")).otherwise(F.col("_one")))
    replaced = other.select("word", (F.col("_g") - 1).alias("near"), best("_o.n", "_o.word").alias("best"))
    # Inserted: a whole word equal to another without one code point (once, wherever in a run of equal ones it goes).
    short = held.where("place < 0").select("left", F.col("n").alias("short_n"))
    long = held.where("place >= 0").select("left", "word", "n").distinct()
    both = long.join(short, "left")
    up = both.select("word", F.lit(1).cast("long").alias("near"), best("short_n", "left").alias("best"))
    down = both.groupBy("left").agg(F.count("*").alias("near"), F.min(best("n", "word")).alias("best")).withColumnRenamed("left", "word")
    found = replaced.unionByName(up).unionByName(down)
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the end of each chain. Every round doubles the distance followed; chains
    rise in n by ``ratio`` a step, so few rounds settle them."""
    at = table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = table(at.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at
    raise RuntimeError(f"chains of forms did not end in {max_rounds} rounds")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """A row a word: word, form, root, n, n_near, form_n."""
    counted = word_counts(docs, key, text, slip, least_chars).where(F.col("n") >= least_count)
    words = table(counted.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "spelling-words")
    near = near_words(words)
    most = -F.col("best.less")
    up = most >= ratio * F.col("n")
    of = words.select("word", "n").join(near, "word", "left")
    of = table(of.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(up, F.col("best.word")).alias("form"), F.when(up, most).alias("form_n")), "spelling-forms")
    ends = roots(of.where("form IS NOT NULL").select("word", "form"))
    return of.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def normalized(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, root, n): the words of each text that have another root, and how often they occur there, for
    rewriting or statistics. ``found``: result of ``variants``. Texts are split once; roots are joined by word."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[A-Za-zÀ-ÿ]+"), 0)
    said = docs.select(F.col(key).alias("_key"), F.explode(runs).alias("word")).groupBy("_key", "word").agg(F.count("*").alias("n"))
    changed = found.where("root <> word").select("word", "root")
    return said.join(changed, "word").select(F.col("_key").alias(key), "word", "root", "n")
