"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors of a label are one vector with a count. Cells come from spherical k-means fitted on a sample: as many
as the largest label needs for about ``CELL_SIZE`` vectors each, and ``PER_CELL`` sampled vectors a cell, at most ``SAMPLE`` in all. Past
that cells grow, and are compared in more blocks. A vector lives in the cell of its best centre and
visits every cell where a vector within the limit could live: unit vectors with cosine >= c differ by at most
r = sqrt(2 - 2c), so a partner's cell has a centre whose bisecting plane with the best one is within r. No
link is lost. Cells are compared in blocks of members and visitors; blocks emit a count a vector and one label
a vector, never pairs.

Null labels, and vectors that are null, empty, zero or hold null or non-finite numbers, link with nothing;
vectors of different sizes are not compared; centres
are fitted for the ``SIZES`` sizes with most vectors, and each further size is one cell a label, compared in blocks. Repeated ids are one row each. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.components import connected_components
from tallyforge.runtime import table

LIMIT = 0.98
SAMPLE = 65_536
PER_CELL = 16
CELL_SIZE = 1500
LEAST_CELLS = 4
SIZES = 64
BLOCK = 1024
#: Scores held at a time while vectors look for their cells.
SCORES = 1 << 21


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    step = max(1, SCORES // len(centres))
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + step] @ centres.T).argmax(1) for i in range(0, len(sample), step)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def _unit(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    return unit_rows(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is scaled by a power of two near its largest number first, which is exact, so that no square over- or underflows."""
    _, power = np.frexp(np.abs(x).max(1, initial=0, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near_cells(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): each row's cell, and those within reach of it."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
    out: list[tuple] = []
    step = max(1, SCORES // len(c))
    for i in range(0, len(x), step):
        score = x[i : i + step] @ c.T
        home = score.argmax(1)
        near = score[np.arange(len(score)), home][:, None] - score <= reach * apart[home] + 1e-9
        near[np.arange(len(score)), home] = True
        r, cell = np.nonzero(near)
        out.append((r + i, cell, cell == home[r]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _visits(centres: dict[int, np.ndarray], limit: float):
    reach = float(np.sqrt(max(0.0, 2 - 2 * limit))) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                part = batch.take(pa.array(rows))
                x = _unit(part.column("v"))
                # A length without centres is a single cell.
                c = centres.get(int(dim), np.eye(1, int(dim)))
                r, cell, home = _near_cells(x, c, reach)
                take = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [take.column("u"), take.column("label"), pa.array(np.full(len(r), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home), take.column("m"), take.column("v")],
                    names=["u", "label", "dim", "cell", "member", "m", "v"],
                )

    return run


def _block_links(limit: float):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        members, visitors = right.combine_chunks(), left.combine_chunks()
        empty = pa.table({"u": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label_to": pa.array([], pa.int64())})
        if not members.num_rows or not visitors.num_rows:
            return empty
        mu, vu = members.column("to_u").to_numpy(), visitors.column("u").to_numpy()
        x, y = _unit(visitors.column("v").combine_chunks()), _unit(members.column("to_v").combine_chunks())
        near = (x @ y.T >= limit) & (vu[:, None] != mu[None, :])
        links = near @ members.column("to_m").to_numpy()
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return empty
        near = near[np.ix_(rows, cols)]
        # Least label over each connected part of the block.
        nodes = np.union1d(vu[rows], mu[cols])
        lab, ri, ci = nodes.copy(), np.searchsorted(nodes, vu[rows]), np.searchsorted(nodes, mu[cols])
        big = np.iinfo(np.int64).max
        while True:
            old = lab.copy()
            np.minimum.at(lab, ri, np.where(near, lab[ci][None, :], big).min(1))
            np.minimum.at(lab, ci, np.where(near, lab[ri][:, None], big).min(0))
            if (old == lab).all():
                break
        u = np.concatenate((vu[rows], nodes))
        return pa.table({"u": u, "links": np.concatenate((links[rows], np.zeros(len(nodes), np.int64))).astype(np.int64), "label_to": np.concatenate((vu[rows], lab))})

    return run


def near_dedup(rows: DataFrame, limit: float = LIMIT, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE, cell_size: int = CELL_SIZE, block: int = BLOCK) -> DataFrame:
    """A row a vector: key, n_links, component_id (least key reachable), kept (the representative of its group)."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(label).isNotNull() & F.col(key).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"), fine.alias("fine"))
    good = base.where("fine").select("id", "label", "v")
    # Equal vectors are one, known by its least id; the others link to it and to each other.
    unique = table(good.groupBy("label", "v").agg(F.min("id").alias("u"), F.count("*").alias("m")), "vectors")
    same = good.join(unique.select("label", "v", "u", "m"), ["label", "v"]).select("id", "u", "m")
    centres: dict[int, np.ndarray] = {}
    of_size = unique.groupBy(F.size("v").alias("dim"), "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    for dim, most, n in of_size.where(F.col("most") > 1).orderBy(F.desc("n"), "dim").limit(SIZES).collect():
        cells = min(max(LEAST_CELLS, -(-most // cell_size)), max(1, sample // PER_CELL))
        some = unique.where(F.size("v") == dim)
        some = some.orderBy(F.xxhash64("u", "label")).limit(cells * PER_CELL) if n > cells * PER_CELL else some
        x = np.stack([np.asarray(a, dtype=float) for a in some.select("v").toPandas()["v"]])
        centres[dim] = fit_centres(unit_rows(x), cells)
    visits = unique.mapInArrow(_visits(centres, limit), "u long, label string, dim int, cell int, member boolean, m long, v array<double>")
    at = ["label", "dim", "cell"]
    visits = table(visits, "cells")
    counts = visits.groupBy(*at).agg(F.count_if("member").alias("members"), F.count("*").alias("visitors"))
    counts = table(counts.select(*at, F.ceil(F.col("members") / block).cast("int").alias("mb"), F.ceil(F.col("visitors") / block).cast("int").alias("vb")), "cell-counts")
    placed = visits.join(counts, at).where("mb > 0")
    deal = lambda n: F.pmod(F.xxhash64("u"), F.col(n)).cast("int")
    members = placed.where("member").withColumn("mi", deal("mb")).withColumn("vi", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select(*at, "mi", "vi", "u", "m", "v")
    visitors = placed.withColumn("vi", deal("vb")).withColumn("mi", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select(*at, "mi", "vi", "u", "v")
    members = members.toDF(*[f"to_{c}" for c in members.columns])
    by = [*at, "mi", "vi"]
    found = table(visitors.groupBy(*by).cogroup(members.groupBy(*[f"to_{c}" for c in by])).applyInArrow(_block_links(limit), "u long, links long, label_to long"), "links")
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("u <> label_to").select(F.col("u").alias("a"), F.col("label_to").alias("b")))
    of = same.join(links, "u", "left").join(groups.withColumnRenamed("node", "u"), "u", "left")
    of = of.select("id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "u").alias("component_id"))
    alone = base.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return of.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", key)
