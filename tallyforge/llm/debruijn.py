"""Substring dedup over a compacted de Bruijn graph of words: drop words covered by a window that occurs elsewhere.

Edges are windows of k words, nodes the k - 1 words that two edges share. Edges under one minimizer follow each
other without a branch wherever all runs of the anchor agree (``repeats``): such stretches are compacted at once. The
edges of the others are met by a digest of their words in Spark. The repeated ones form the graph: nodes get
their degrees, a node with one edge in and one out joins the two, and pointer jumping over these joins gives every edge
the path it lies on and its place there. Source coordinates (document, start) of the edges are then grouped
by path and by where the path would begin; only edges that follow each other in the source become a span. Every occurrence goes,
the first included.

Null texts have no words. Repeated rows (same id and text) count once and their result is repeated. Texts with fewer
words than the window lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm import repeats as R
from tallyforge.runtime import sized, table

WORDS = 35
GRAM = 12
EDGE = ["e1", "e2"]


def _edges(unit: R.Unit):
    """Edges of branches: (digest e1, e2, nodes u and v, d, w, p), p the kind and, for spans, how many edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            for (sd, sw, sn), part, d, at, c in R.per_run(batch, unit):
                if len(sd):
                    yield _spans(sd, sw, sn)
                if not len(d):
                    continue
                rep = c["nw"].astype(np.int64)
                i = np.repeat(np.arange(len(at)), rep)
                step = np.arange(len(i)) - np.repeat(np.cumsum(rep) - rep, rep)
                start = at[i] + step
                node = K.Prefix(part.sym)
                u, v = node.of(start, start + unit.length - 1), node.of(start + 1, start + unit.length)
                e1, e2 = part.digests(start, start + unit.length)
                for o, x in zip(out, (e1, e2, R._signed(u), R._signed(v), d[i], c["w"][i] + step, c["multi"][i].astype(bool)), strict=True):
                    o.append(x)
            if not out[0] or not sum(map(len, out[0])):
                continue
            e1, e2, u, v, d, w, known = map(np.concatenate, out)
            order = np.lexsort((w, d, e2, e1))
            e1, e2, u, v, d, w, known = (x[order] for x in (e1, e2, u, v, d, w, known))
            new = np.ones(len(e1), bool)
            new[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
            head = np.flatnonzero(new)
            # Two starts of an edge in one batch: both recur, and one marker tells the others.
            differ = np.zeros(len(e1), bool)
            differ[1:] = ~new[1:] & ((d[1:] != d[:-1]) | (w[1:] != w[:-1]))
            several = np.logical_or.reduceat(differ | known, head)
            hit = several[np.cumsum(new) - 1]
            mark = head[several]
            yield _spans(*R._merged(d[hit], w[hit], np.ones(int(hit.sum()), np.int64)))
            yield _rows(e1[~hit], e2[~hit], u[~hit], v[~hit], d[~hit], w[~hit], np.full(int((~hit).sum()), R.OPEN))
            yield _rows(e1[mark], e2[mark], u[mark], v[mark], np.full(len(mark), R.NO_ID), np.zeros(len(mark), np.int64), np.full(len(mark), R.MARK))

    return run


def _rows(e1, e2, u, v, d, w, p) -> pa.RecordBatch:
    return pa.record_batch({"e1": e1, "e2": e2, "u": u, "v": v, "d": d, "w": w, "p": np.asarray(p, np.int64)})


def _spans(d: np.ndarray, w: np.ndarray, nw: np.ndarray) -> pa.RecordBatch:
    """Settled spans, dealt out evenly."""
    zero = np.zeros(len(d), np.int64)
    return _rows(R._signed(R._scramble(np.ones(len(d), np.uint64), d, w)), zero, zero, zero, d, w, nw * 4 + R.KNOWN)


def compacted(edges: DataFrame) -> DataFrame:
    """(e1, e2, path, place) of distinct edges (e1, e2, u, v): the nonbranching path of an edge, and its place on it.

    A node with one edge in and one out joins them. Every edge then knows the one before it; pointer jumping
    doubles the distance until the first edge of the path is reached, and edges that have reached it leave the rounds. The edges of a ring have no first one
    and stay paths of their own."""
    numbered = table(edges.select(F.monotonically_increasing_id().alias("e"), *EDGE, "u", "v"), "graph-edges")
    into = numbered.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"), F.min("e").alias("before"))
    out = numbered.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"), F.min("e").alias("e"))
    joints = into.join(out, "node").where("n_in = 1 AND n_out = 1 AND e <> before")
    going = table(joints.select("e", F.col("before").alias("up"), F.lit(1).cast("long").alias("hops")), "graph-joints")
    # Settled edges point at the first one of their path.
    settled: list[DataFrame] = []
    reach, count = 1, going.count()
    while reach <= 2 * count:
        held = functools.reduce(DataFrame.unionByName, settled, going.withColumn("_done", F.lit(False)))
        far = held.select(F.col("e").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), "_done")
        met = going.join(far, "up", "left")
        step = table(met.select("e", F.coalesce("_up", "up").alias("up"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("_done", F.lit(True)).alias("_done")), "graph-jumps")
        settled.append(step.where("_done"))
        going = step.where("NOT _done").drop("_done")
        reach *= 2
        if going.isEmpty():
            break
    done = functools.reduce(DataFrame.unionByName, settled).select("e", "up", "hops") if settled else going
    return numbered.join(done, "e", "left").select(*EDGE, F.coalesce("up", "e").alias("path"), F.coalesce("hops", F.lit(0)).alias("place"))


def _finish(data, off, start, end, bounds, gone):
    total = np.concatenate(([0], np.cumsum(gone)))
    n = np.diff(bounds)
    removed = total[bounds[1:]] - total[bounds[:-1]]
    # Kept words and one space after each; the last space of every document is cut.
    keep = np.flatnonzero(~gone)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, start[keep], 1)
    np.add.at(inside, end[keep], -1)
    out, at = K.joined_words(np.where(np.cumsum(inside[:-1]) > 0, data, 0x20).astype(np.uint8), start[keep], end[keep])
    left = np.concatenate(([0], np.cumsum(n - removed)))
    whole, cut = out.tobytes(), at[left]
    return {
        "n_words": n, "n_removed": removed,
        "kept_sha256": pa.array([hashlib.sha256(whole[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
    }


def repeated_windows(base: DataFrame, unit: R.Unit) -> DataFrame:
    """(d, w, nw): windows w to w + nw - 1 of document d also start elsewhere."""
    runs = R.compared_runs(base, R.recurring_runs(base, unit), unit, keep_first=False)
    edges = R.expand(base, runs, _edges(unit), "e1 long, e2 long, u long, v long, d long, w long, p long")
    by, spot = W.partitionBy(*EDGE), F.struct("d", "w")
    met = edges.withColumn("kind", F.col("p").bitwiseAND(F.lit(3))).withColumn("_two", F.min(spot).over(by) != F.max(spot).over(by))
    met = table(met.where((F.col("kind") == R.KNOWN) | F.col("_two")), "repeated-edges")
    known = met.where(F.col("kind") == R.KNOWN).select("d", "w", F.shiftright("p", 2).alias("nw"))
    graph = met.where(F.col("kind") != R.KNOWN)
    paths = table(compacted(graph.groupBy(*EDGE).agg(F.first("u").alias("u"), F.first("v").alias("v"))), "graph-paths")
    found = graph.where(F.col("kind") == R.OPEN).select(*EDGE, "d", "w").join(sized(paths), EDGE)
    found = found.select("path", "d", "w", (F.col("w") - F.col("place")).alias("begin"))
    # Edges of a path are one span only as far as they follow each other in the source.
    by = W.partitionBy("path", "d", "begin").orderBy("w")
    island = found.withColumn("island", F.col("w") - F.dense_rank().over(by))
    spans = island.groupBy("path", "d", "begin", "island").agg(F.min("w").alias("w"), (F.max("w") - F.min("w") + 1).alias("nw"))
    return known.unionByName(spans.select("d", "w", "nw"))


def dedup(docs: DataFrame, k: int = WORDS, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    unit = R.Unit(k, gram, words=True)
    base, names = R.texts(docs, key, text)
    done = R.covered(base, repeated_windows(base, unit), unit, _finish, "d long, n_words long, n_removed long, kept_sha256 string")
    return R.named(done, names, "d").withColumnRenamed("d", key)
