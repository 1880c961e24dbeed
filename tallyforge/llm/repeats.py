"""Where windows of a fixed length recur, found through minimizer anchors; shared by the two substring operators.

1. Tasks cut documents into runs of windows with one minimizer and send (hash, document, start). Anchors seen
   twice in a batch are known at once and leave one marker, so a frequent one costs a row a batch.
2. Runs whose anchor occurs elsewhere go back to their documents, which take a 128-bit BLAKE2b digest of the whole
   run: equal runs collapse to one, and only anchors with runs that differ ("branches") need their windows looked at
   one by one.
3. Windows of branches are settled by the operator's own method.
Starts and counts are exact: an anchor is only ever a reason to look, and equality is decided by content or its digest.
Texts are written once, bucketed by document, so that no later step moves them again.

Documents are told apart by id and a hash of the text: null ids with different texts are different documents, as
are the texts of one id. Repeated rows (same id and text) are one document whose result is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.runtime import bucketed, table

NO_ID = -(1 << 63)
#: Rows: a run to compare, a run known to recur, a marker of its anchor.
OPEN, KNOWN, MARK = 0, 1, 2
#: Bits of the number of windows of a run with one anchor.
AHEAD = 10


@dataclass(frozen=True)
class Unit:
    """What windows are made of: bytes or words."""

    length: int
    gram: int
    words: bool

    def part(self, data: np.ndarray, offsets: np.ndarray) -> Part:
        if not self.words:
            return Part(data, offsets, data, None)
        start, end, bounds = K.words(data, offsets)
        raw, at = K.joined_words(data, start, end)
        return Part(K.word_hashes(data, start, end), bounds, raw, at)


@dataclass(frozen=True)
class Part:
    """Symbols of some documents (``bounds``: where they start, and the end), and the bytes they stand for."""

    sym: np.ndarray
    bounds: np.ndarray
    raw: np.ndarray
    at: np.ndarray | None

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.at is not None:
            start, end = self.at[start], self.at[end]
        return K.digests(self.raw, start, end)


def _scramble(key: np.ndarray, d: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(key ^ K.mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``read``, written in buckets of d."""
    base, names = read(docs, key, text)
    return bucketed(base, "d", "texts"), names


def read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(d, t), the form every step joins on, and the names of d.

    Where each id has one text, d is the id (``NO_ID`` for null) and there are no names. Else d is a number in the
    order of ids (null first) and text hashes, and the names are a table (d, key, hash)."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_hash(text).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = rows.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    if texts.where((F.col("low") != F.col("high")) | (F.col("key") == NO_ID)).isEmpty():
        return rows.select(F.coalesce("key", F.lit(NO_ID)).alias("d"), "t"), None
    order = rows.select("key", "hash").distinct().repartitionByRange(F.col("key").asc_nulls_first(), F.col("hash")).sortWithinPartitions(F.col("key").asc_nulls_first(), "hash")
    names = table(order.select(F.monotonically_increasing_id().alias("d"), "key", "hash"), "document-numbers")
    of = names.toDF("d", "_key", "_hash")
    return table(rows.join(of, F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash"))).select("d", "t"), "documents"), names


def named(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """``rows`` with the ids of documents in place of their d in ``columns``."""
    for c in columns:
        if names is None:
            rows = rows.withColumn(c, F.when(F.col(c) != NO_ID, F.col(c)))
        else:
            of = names.select(F.col("d").alias("_d"), F.col("key").alias("_key"))
            rows = rows.join(of, F.col(c) == F.col("_d"), "left").withColumn(c, F.col("_key")).drop("_d", "_key")
    return rows


def _twins(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``keys`` (last first, as lexsort), first of each run of the last key, size of each run."""
    order = np.lexsort(keys)
    k = keys[-1][order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, head, np.diff(np.append(head, len(k)))


def recurring_runs(base: DataFrame, unit: Unit) -> DataFrame:
    """(d, starts): for each document the runs whose anchor occurs more than once anywhere."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = K.column(batch.column(1))
            d, w, a = [], [], []
            for i, j in K.chunks(off):
                part = unit.part(data[off[i] : off[j]], off[i : j + 1] - off[i])
                doc, start, _, key, _ = K.anchors(part.sym, part.bounds, unit.length, unit.gram)
                d.append(ids[doc + i])
                w.append(start)
                a.append(key)
            if not d or not sum(map(len, d)):
                continue
            d, w, a = np.concatenate(d), np.concatenate(w), np.concatenate(a)
            order, head, n = _twins(a)
            many = np.repeat(n > 1, n)
            d, w, a = d[order], w[order], a[order]
            mark = head[n > 1]
            pk = np.where(many, _scramble(a, d, w), a)
            yield pa.record_batch({
                "pk": _signed(np.concatenate((pk, a[mark]))),
                "d": np.concatenate((d, np.full(len(mark), NO_ID))),
                "p": np.concatenate((w * 4 + many, np.full(len(mark), MARK))),
            })

    rows = base.mapInArrow(find, "pk long, d long, p long")
    met = rows.withColumn("n", F.count("*").over(W.partitionBy("pk"))).where("(p & 3) = 1 OR ((p & 3) = 0 AND n > 1)")
    return met.groupBy("d").agg(F.collect_list(F.shiftright("p", 2)).alias("starts"))


def _merged(d: np.ndarray, w: np.ndarray, nw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one document that follow each other without a gap become one."""
    order = np.lexsort((w, d))
    d, w, nw = d[order], w[order], nw[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] > w[:-1] + nw[:-1])
    k = np.flatnonzero(new)
    end = np.maximum.reduceat(w + nw, k) if len(k) else w
    return d[k], w[k], end - w[k]


def compared_runs(base: DataFrame, starts: DataFrame, unit: Unit, keep_first: bool) -> DataFrame:
    """(pk, d, w, nw, ahead, span, branch, multi, n): recurring runs beside the others with their anchor.

    span: all windows of the run are repeats (of an earlier start, or with ``keep_first`` off, of any other);
    branch: first of its equals, and runs with the same anchor differ; multi: an equal run stands elsewhere;
    n: how many different runs the anchor has; ahead: how far behind the start of a branch its anchor lies.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            data, off = K.column(batch.column("t"))
            lists = batch.column("starts")
            loff, lval = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            for i, j in K.chunks(off):
                part = unit.part(data[off[i] : off[j]], off[i : j + 1] - off[i])
                doc, start, nw, key, ahead = K.anchors(part.sym, part.bounds, unit.length, unit.gram)
                at = part.bounds[doc] + start
                wanted = np.zeros(len(part.sym) + 1, bool)
                wanted[np.repeat(part.bounds[:-1], np.diff(loff[i : j + 1])) + lval[loff[i] : loff[j]]] = True
                keep = wanted[at]
                doc, start, nw, key, ahead, at = doc[keep], start[keep], nw[keep], key[keep], ahead[keep], at[keep]
                s1, s2 = part.digests(at, at + nw + unit.length - 1)
                for o, x in zip(out, (key, s1, s2, ids[doc + i], start, nw, ahead), strict=True):
                    o.append(x)
            if not out[0] or not sum(map(len, out[0])):
                continue
            a, s1, s2, d, w, nw, ahead = map(np.concatenate, out)
            order = np.lexsort((w, d, s2, s1, a))
            a, s1, s2, d, w, nw, ahead = (x[order] for x in (a, s1, s2, d, w, nw, ahead))
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
            once = np.ones(len(a), bool)  # a repeated row brings the same run again
            once[1:] = head[1:] | (d[1:] != d[:-1]) | (w[1:] != w[:-1])
            a, s1, s2, d, w, nw, ahead, head = (x[once] for x in (a, s1, s2, d, w, nw, ahead, head))
            h = np.flatnonzero(head)
            multi = np.diff(np.append(h, len(a))) > 1
            # Later equals in this batch are settled; what follows each other goes on as one row.
            kd, kw, kn = _merged(d[~head], w[~head], nw[~head])
            zero = np.zeros(len(kd), np.int64)
            flags = np.concatenate((multi * 4 + OPEN, np.full(len(kd), 4 + KNOWN)))
            # A run of one anchor is at most as long as a window, so its anchor's place fits beside its length.
            size = np.concatenate((nw[h] + (ahead[h] << AHEAD), kn))
            yield pa.record_batch({
                "pk": np.concatenate((_signed(a[h]), _signed(_scramble(np.zeros(len(kd), np.uint64), kd, kw)))),
                "s1": np.concatenate((s1[h], zero)), "s2": np.concatenate((s2[h], zero)),
                "d": np.concatenate((d[h], kd)), "p": (np.concatenate((w[h], kw)) << 32) + (size << 4) + flags,
            })

    joined = base.join(starts, "d").select("d", "t", "starts")
    rows = joined.mapInArrow(find, "pk long, s1 long, s2 long, d long, p long")
    by_anchor, by_run = W.partitionBy("pk"), W.partitionBy("pk", "s1", "s2")
    rows = rows.withColumn("w", F.shiftright("p", 32)).withColumn("kind", F.col("p").bitwiseAND(F.lit(3)))
    spot, seg = F.struct("d", "w"), F.struct("s1", "s2")
    known = F.col("kind") == KNOWN
    rows = (
        rows.withColumn("_lo", F.min(spot).over(by_run)).withColumn("_hi", F.max(spot).over(by_run))
        .withColumn("multi", F.max(F.col("p").bitwiseAND(F.lit(4))).over(by_run).cast("boolean") | (F.col("_lo") != F.col("_hi")))
        .withColumn("_differ", F.min(seg).over(by_anchor) != F.max(seg).over(by_anchor))
        .withColumn("_first", ~known & (spot == F.col("_lo")))
        .withColumn("n", F.count_if("_first").over(by_anchor))
    )
    rows = rows.withColumn("span", ~F.col("_first") if keep_first else F.col("multi")).withColumn("branch", F.col("_first") & F.col("_differ"))
    size = F.shiftright(F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)), 4)
    nw = F.when(known, size).otherwise(size.bitwiseAND(F.lit((1 << AHEAD) - 1))).alias("nw")
    return rows.where("span OR branch").select("pk", "d", "w", nw, F.shiftright(size, AHEAD).alias("ahead"), "span", "branch", "multi", "n")


def expand(base: DataFrame, runs: DataFrame, find: Callable, schema: str) -> DataFrame:
    """``find`` over documents joined with their runs, the one consumer of ``compared_runs``."""
    per = runs.groupBy("d").agg(F.collect_list(F.struct("w", "nw", "ahead", "pk", "n", "span", "branch", "multi")).alias("runs"))
    return base.join(per, "d").select("d", "t", "runs").mapInArrow(find, schema)


def per_run(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple]:
    """For each piece of a batch of ``expand``: whole spans (d, w, nw), and for the branches the piece's symbols
    (``Part``), document ids, where runs start, and the runs' columns."""
    ids = batch.column("d").to_numpy(zero_copy_only=False)
    data, off = K.column(batch.column("t"))
    lists = batch.column("runs")
    loff, flat = lists.offsets.to_numpy(), lists.values
    field = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("w", "nw", "ahead", "pk", "n", "span", "branch", "multi")}
    for i, j in K.chunks(off):
        cols = {f: x[loff[i] : loff[j]] for f, x in field.items()}
        doc = np.repeat(np.arange(j - i), np.diff(loff[i : j + 1]))
        whole, branch = cols["span"].astype(bool), cols["branch"].astype(bool)
        spans = _merged(ids[doc[whole] + i], cols["w"][whole], cols["nw"][whole])
        if branch.any():
            part = unit.part(data[off[i] : off[j]], off[i : j + 1] - off[i])
        else:
            part = Part(np.zeros(0, np.uint8), np.zeros(j - i + 1, np.int64), data[:0], None)
        cols, doc = {f: x[branch] for f, x in cols.items()}, doc[branch]
        yield spans, part, ids[doc + i], part.bounds[doc] + cols["w"], cols


def covered(base: DataFrame, spans: DataFrame, unit: Unit, finish: Callable, schema: str) -> DataFrame:
    """``finish(symbols, bounds, gone, data, offsets)`` over every document, ``gone`` marking covered symbols.

    ``spans``: (d, w, nw), windows w to w + nw - 1. ``finish`` returns a dict of result columns; d comes first.
    """
    per = spans.groupBy("d").agg(F.collect_list(F.struct("w", "nw")).alias("spans"))
    rows = base.join(per, "d", "left").select("d", "t", "spans")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy(zero_copy_only=False)
            data, off = K.column(batch.column("t"))
            lists = batch.column("spans")
            loff, w, nw = lists.offsets.to_numpy(), lists.values.field("w").to_numpy(zero_copy_only=False), lists.values.field("nw").to_numpy(zero_copy_only=False)
            for i, j in K.chunks(off):
                part, poff = data[off[i] : off[j]], off[i : j + 1] - off[i]
                sym, ends, bounds = K.words(part, poff) if unit.words else (part, None, poff)
                edge = np.zeros(len(sym) + 1, np.int32)
                at = np.repeat(bounds[:-1], np.diff(loff[i : j + 1])) + w[loff[i] : loff[j]]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + nw[loff[i] : loff[j]] + unit.length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                yield pa.record_batch({"d": ids[i:j]} | finish(part, poff, sym, ends, bounds, gone))

    return rows.mapInArrow(find, schema)
