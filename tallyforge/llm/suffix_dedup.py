"""Suffix-array dedup: remove every byte covered by a 100-byte string that also starts earlier.

Candidate stretches come from ``repeats``; within an anchor, the stretches that differ are put one behind the
other and their suffixes ordered by Lyndon-prefix groups (``lyndon``), so that equal windows are neighbours.
An anchor with many differing stretches is split by a longer one: its windows are dealt by where the anchor lies in
them, and told apart by all bytes that such windows have in common, so that equal windows stay together.
The earliest start in document and position order keeps its bytes.

Null texts are empty. Repeated rows (same id and text) count once and their result is repeated. Texts shorter than the
window lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm import repeats as R
from tallyforge.llm.lyndon import repeated_windows
from tallyforge.runtime import table

LENGTH = 100
GRAM = 32
#: Runs of one anchor up to which they are ordered as one text; those of more are first split by longer anchors.
LANE_RUNS = 32
#: Bytes of text ordered at a time.
LANE_BATCH = 1 << 20


def _order(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("seg").nbytes
            if size >= LANE_BATCH:
                full, rest = _split(pa.Table.from_batches(held))
                if full is not None:
                    yield from _lanes(full, length)
                held = rest.to_batches()
                size = sum(b.column("seg").nbytes for b in held)
        if held:
            yield from _lanes(pa.Table.from_batches(held), length)

    return run


def _split(rows: pa.Table) -> tuple[pa.Table | None, pa.Table]:
    """Rows up to the last change of key, and the rest: a lane is never cut."""
    key = rows.column("pk").to_numpy()
    cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
    return (rows.slice(0, cut).combine_chunks() if cut else None), rows.slice(cut)


def _once(key: np.ndarray, d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its (key, d, w): a repeated row brings each of its starts again."""
    order = np.lexsort((w, d, key))
    key, d, w = key[order], d[order], w[order]
    out = np.ones(len(key), bool)
    out[order[1:]] = (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    return out


def _lanes(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    batch = rows.to_batches()
    if not batch:
        return
    batch = batch[0]
    data, off = K.column(batch.column("seg"))
    key, d, w, nw = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pk", "d", "w", "nw"))
    bare = np.diff(off) == 0
    if bare.any():
        yield pa.record_batch({"d": d[bare], "w": w[bare], "nw": nw[bare]})
    k = np.flatnonzero(~bare)
    k = k[_once(key[k], d[k], w[k])]
    if not len(k):
        return
    size, off = np.diff(off)[k], off[:-1][k]
    key, d, w, nw = key[k], d[k], w[k], nw[k]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n_runs = np.diff(np.append(head, len(key)))
    lane = np.repeat(np.arange(len(head)), n_runs)
    several = n_runs[lane] > 1
    if not several.any():
        return
    # A separator symbol after each run keeps windows apart.
    pick = np.flatnonzero(several)
    lens = size[pick]
    begin = np.concatenate(([0], np.cumsum(lens + 1)))
    sym = np.ones(begin[-1], np.uint16)
    inside = np.arange(lens.sum()) + np.repeat(np.arange(len(pick)), lens)
    source = np.arange(lens.sum()) + np.repeat(off[pick] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    sym[inside] = data[source].astype(np.uint16) + 2
    lane_of = lane[pick]
    change = np.flatnonzero(np.concatenate(([True], lane_of[1:] != lane_of[:-1])))
    starts = np.append(begin[:-1][change], begin[-1])
    cnt = nw[pick].astype(np.int64)
    run = np.repeat(np.arange(len(pick)), cnt)
    ahead = np.arange(cnt.sum()) - np.repeat(np.concatenate(([0], np.cumsum(cnt)[:-1])), cnt)
    at = begin[:-1][run] + ahead
    found, group = repeated_windows(sym, starts, at, length)
    which = np.searchsorted(at, found)
    rd, rw = d[pick][run[which]], w[pick][run[which]] + ahead[which]
    order = np.lexsort((rw, rd, group))
    g, rd, rw = group[order], rd[order], rw[order]
    later = np.zeros(len(g), bool)
    later[1:] = g[1:] == g[:-1]
    if later.any():
        yield pa.record_batch({"d": rd[later], "w": rw[later], "nw": np.ones(int(later.sum()), np.int64)})


def _split_runs(unit: R.Unit, part: R.Part, d: np.ndarray, at: np.ndarray, c: dict) -> tuple[np.ndarray, ...]:
    """(key, d, w, nw, at) of the runs, those of crowded anchors cut where their windows get another longer anchor."""
    offsets = unit.length - unit.gram + 1
    parts = np.where(c["n"] > LANE_RUNS, 2 ** np.ceil(np.log2(np.maximum(c["n"], 1) / LANE_RUNS)), 1).astype(np.int64).clip(1, offsets)
    rep = c["nw"].astype(np.int64)
    run = np.repeat(np.arange(len(at)), rep)
    step = np.arange(len(run)) - np.repeat(np.cumsum(rep) - rep, rep)
    place = (c["ahead"][run] - step) * parts[run] // offsets
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1])
    k = np.flatnonzero(new)
    run, step, place, nw = run[k], step[k], place[k], np.diff(np.append(k, len(new)))
    key = R._signed(c["pk"][run]).copy()
    longer = np.flatnonzero(parts[run] > 1)
    if len(longer):
        r, p = run[longer], parts[run[longer]]
        anchor = at[r] + c["ahead"][r]
        low, high = -(-place[longer] * offsets // p), -(-(place[longer] + 1) * offsets // p) - 1
        common = K.Prefix(part.sym).of(anchor - low, anchor - high + unit.length)
        key[longer] = R._signed(K.mix(common ^ K.mix(place[longer].astype(np.uint64))))
    return key, d[run], c["w"][run] + step, nw, at[run] + step


def _stretches(unit: R.Unit):
    """Each run's bytes by (longer) anchor. Of equal stretches of a crowded anchor in a batch, all but the first are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (sd, sw, sn), part, d, at, c in R.per_run(batch, unit):
                if len(sd):
                    yield _spans(sd, sw, sn)
                if not len(d):
                    continue
                key, d, w, nw, at = _split_runs(unit, part, d, at, c)
                end = at + nw + unit.length - 1
                order = np.lexsort((w, d, key))
                key, d, w, nw, at, end = (x[order] for x in (key, d, w, nw, at, end))
                s1, s2 = part.digests(at, end)
                order = np.lexsort((w, d, s2, s1, key))
                same = np.zeros(len(order), bool)
                o, q = order[1:], order[:-1]
                same[1:] = (key[o] == key[q]) & (s1[o] == s1[q]) & (s2[o] == s2[q])
                if same.any():
                    k = order[same]
                    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))[same]]
                    k = k[(d[k] != d[first]) | (w[k] != w[first])]  # not the run of a repeated row
                    yield _spans(*R._merged(d[k], w[k], nw[k]))
                k = np.sort(order[~same])
                size = end[k] - at[k]
                off = np.concatenate(([0], np.cumsum(size)))
                source = np.arange(off[-1]) + np.repeat(at[k] - off[:-1], size)
                yield _rows(key[k], d[k], w[k], nw[k], off, part.sym[source].tobytes())

    return run


def _spans(d: np.ndarray, w: np.ndarray, nw: np.ndarray) -> pa.RecordBatch:
    """Spans that are settled: rows without bytes, dealt out evenly."""
    return _rows(R._signed(R._scramble(np.zeros(len(d), np.uint64), d, w)), d, w, nw, np.zeros(len(d) + 1, np.int64), b"")


def _rows(key, d, w, nw, off, seg: bytes) -> pa.RecordBatch:
    binary = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(seg)])
    return pa.record_batch({"pk": key, "d": d, "w": w, "nw": np.asarray(nw).astype(np.int64), "seg": binary})


def _finish(data, off, sym, ends, bounds, gone):
    n = np.diff(off)
    total = np.concatenate(([0], np.cumsum(gone)))
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = off[(off > 0) & (off < len(gone))]
    first[inner] = gone[inner]
    spans = np.concatenate(([0], np.cumsum(first)))
    kept = data[~gone]
    at = off - total[off]
    whole = kept.tobytes()
    return {
        "n_bytes": n, "n_removed": total[off[1:]] - total[off[:-1]], "n_spans": spans[off[1:]] - spans[off[:-1]],
        "kept_sha256": pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
    }


def later_windows(base: DataFrame, unit: R.Unit) -> DataFrame:
    """(d, w, nw): windows w to w + nw - 1 of document d start earlier elsewhere."""
    # Each step's result is far smaller than what it shuffles, so it is written and the shuffle files go.
    starts = table(R.recurring_runs(base, unit), "recurring")
    runs = table(R.compared_runs(base, starts, unit, keep_first=True), "compared")
    rows = R.expand(base, runs, _stretches(unit), "pk long, d long, w long, nw long, seg binary")
    return rows.repartition("pk").sortWithinPartitions("pk").mapInArrow(_order(unit.length), "d long, w long, nw long")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    unit = R.Unit(length, gram, words=False)
    base, names = R.texts(docs, key, text)
    done = R.covered(base, later_windows(base, unit), unit, _finish, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return R.named(done, names, "d").withColumnRenamed("d", key)
