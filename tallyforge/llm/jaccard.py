"""N-gram Jaccard join by set-relation skipping.

A document's set is its distinct word n-grams. Relations between sets spare work, none spares a link:

* Equal sets have one answer: they collapse to one representative, whose component all of them share.
* Index lists hold only the rarest grams of each set (a linking pair must share one of them), each with its position.
  Lists are dealt in blocks of neighbouring sizes and salts; a block whose sizes or positions rule a link out is
  skipped, and inside a block a 256-bit parity signature of each set (two sets differ in at least as many grams as
  their signatures in bits) rules out most pairs that do not link. Pairs of larger sets are tested once more by
  signatures as wide as two bits a gram.
* Each list has a leader. The sets of the list are compared with it once, and what a highly similar set has less
  and more than its leader is kept. The overlap of two sets with a leader in common is derived from these
  differences alone; only other pairs are compared as whole sets.
* Linked sets are one component; pairs inside a component are spared. After the leaders, each set outside its list's
  largest component is compared with its best candidate there, and at last every pair across components is.

Which grams are rare is known from counts in a table of fixed size over all documents. Links are decided on whole
sets of 64-bit gram hashes.

Null and empty texts have empty sets and link with nothing; fewer words than n make one gram. Repeated rows
share their id and set; rows of one id, or of none, with different texts are different documents. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.repeats import named, read, text_hash
from tallyforge.operators.components import connected_components
from tallyforge.runtime import sized, table

COUNTERS = 1 << 19
SLOTS = 64
SIGNATURE_BITS = 256
#: Entries of a list that stay together; a longer list is dealt out by salt.
HOMES = 4096
#: Pairs looked at in one array operation.
PAIRS = 1 << 20
#: With leaders, pairs this many hundredths under the limit are measured too: their differences serve later pairs.
NEAR = 10


def sets_of(data: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    for i, j in K.chunks(off):
        part = K.lower(data[off[i] : off[j]])
        start, end, bounds = K.words(part, off[i : j + 1] - off[i])
        word = K.word_hashes(part, start, end)
        gram = K.gram_hashes(word, n)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                g = np.sort(gram[a : b - n + 1])
                yield g[np.concatenate(([True], g[1:] != g[:-1]))] if len(g) > 1 else g
            elif b > a:
                yield K.gram_hashes(word[a:b], b - a)
            else:
                yield gram[:0]


def signature(s: np.ndarray, bits: int = SIGNATURE_BITS) -> bytes:
    """Parity of the number of grams in each of the signature's bits (a power of two); halves folded by xor are the signature of half as many bits."""
    at = ((s >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def wide(s: np.ndarray) -> bytes | None:
    """The size and the signature of a set too large for ``SIGNATURE_BITS``."""
    return len(s).to_bytes(8, "little") + signature(s, 1 << (2 * len(s) - 1).bit_length()) if len(s) > SIGNATURE_BITS else None


def apart(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Sizes of two sets with wide signatures, and the least number of grams in which they differ."""
    p, q = np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8)
    n = min(len(p), len(q))
    p, q = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (p, q))
    return int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little"), int(np.bitwise_count(p ^ q).sum())


def gram_counts(base: DataFrame, n: int) -> np.ndarray:
    """How many documents hold a gram of each counter: a table of fixed size, summed in parts by Spark."""
    width = COUNTERS // SLOTS

    def add_up(total: np.ndarray, held: list[np.ndarray]) -> None:
        if held:
            total += np.bincount((np.concatenate(held) >> np.uint64(20)).astype(np.int64) % COUNTERS, minlength=COUNTERS).astype(np.uint32)
            held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            data, off = K.column(batch.column("t"))
            held: list[np.ndarray] = []
            waiting = 0
            for s in sets_of(data, off, n):
                held.append(s)
                waiting += len(s)
                if waiting > COUNTERS:
                    add_up(total, held)
                    waiting = 0
            add_up(total, held)
        if total.any():
            yield pa.record_batch({"slot": np.arange(SLOTS, dtype=np.int32), "counts": pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(SLOTS)])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column("slot").to_pylist(), batch.column("counts"), strict=True):
                got = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
                total[slot] = total[slot] + got if slot in total else got
        if total:
            yield pa.record_batch({"slot": pa.array(list(total), pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()])})

    rows = base.mapInArrow(count, "slot int, counts binary").repartition("slot").mapInArrow(add, "slot int, counts binary")
    out = np.zeros(COUNTERS, np.uint64)
    for slot, counts in rows.collect():
        out[slot * width : (slot + 1) * width] = np.frombuffer(counts, np.uint64)
    return out


def prefixes(base: DataFrame, n: int, percent: int, counts) -> DataFrame:
    """(id, size, s1, s2, sig, wide, grams): set size, fingerprint, signatures and the grams of the index prefix, rarest first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        for batch in batches:
            data, off = K.column(batch.column("t"))
            size, s1, s2, sig, large, out = [], [], [], [], [], []
            for s in sets_of(data, off, n):
                m = len(s)
                size.append(m)
                s1.append(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                s2.append(K.mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
                sig.append(signature(s))
                large.append(wide(s))
                if m:
                    take = m - -(-percent * m // 100) + 1
                    order = np.lexsort((s, seen[(s >> np.uint64(20)).astype(np.int64) % COUNTERS]))[:take]
                    out.append(s[order])
                else:
                    out.append(s)
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            grams = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.record_batch({
                "id": batch.column("d"), "size": np.array(size, np.int64),
                "s1": np.array(s1, np.uint64).view(np.int64), "s2": np.array(s2, np.uint64).view(np.int64),
                "sig": pa.array(sig, pa.binary()), "wide": pa.array(large, pa.binary()), "grams": pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64))),
            })

    return base.mapInArrow(find, "id long, size long, s1 long, s2 long, sig binary, wide binary, grams array<long>")


def _need(na, nb, percent: int):
    """How many grams sets of these sizes must share to link."""
    return -(-percent * (na + nb) // (100 + percent))


def _may_link(na, pa_, nb, pb, percent: int):
    """Whether entries at positions pa_ and pb of sets of sizes na and nb can be the rarest common gram of a linking pair."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    need = _need(na, nb, percent)
    return (100 * low >= percent * high) & (pa_ <= na - need) & (pb <= nb - need)


#: What a round asks of a list: the leader's pairs, the best candidate of each visitor, or all pairs.
LEAD, BEST, ALL = "lead", "best", "all"


def _meet(percent: int, mode: str):
    """Candidate pairs (a, b, part_a, part_b, token) from rows sorted by (token, block, salt, role): homes (role 0), then visitors."""
    names = ("token", "block", "salt", "role", "id", "size", "pos", "part", "big", "more")

    def pairs(c: dict, sig: np.ndarray, v: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch | None:
        x = np.repeat(v, count)
        y = np.arange(len(x)) + np.repeat(first - (np.cumsum(count) - count), count)
        size, pos, part = c["size"], c["pos"], c["part"]
        ok = part[x] != part[y]
        if mode == ALL:
            ok &= c["big"][y] | (c["id"][x] < c["id"][y])
        x, y = x[ok], y[ok]
        # A list of two has no later pairs.
        least = np.where(c["more"][x] & (mode == LEAD), percent - NEAR, percent)
        ok = _may_link(size[x], pos[x], size[y], pos[y], least)
        x, y, least = x[ok], y[ok], least[ok]
        differ = np.bitwise_count(sig[x] ^ sig[y]).sum(1).astype(np.int64)
        both = size[x] + size[y]
        ok = differ <= both - 2 * _need(size[x], size[y], least)
        x, y, differ = x[ok], y[ok], differ[ok] / both[ok]
        if mode == BEST and len(x):
            order = np.lexsort((c["id"][y], differ, x))
            k = order[np.concatenate(([True], x[order][1:] != x[order][:-1]))]
            x, y = x[k], y[k]
        if not len(x):
            return None
        rows = np.stack((c["id"][x], c["id"][y], part[x], part[y], c["token"][x]))
        if mode != LEAD:
            rows = np.where(rows[0] > rows[1], rows[[1, 0, 3, 2, 4]], rows)
        if mode != BEST:
            rows = np.unique(rows[:4], axis=1)
            rows = np.concatenate((rows, np.zeros((1, rows.shape[1]), np.int64)))
        return pa.record_batch(dict(zip(("a", "b", "part_a", "part_b", "token"), rows, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[dict, np.ndarray] | None = None
        for batch in batches:
            c = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in names}
            sig = np.frombuffer(K.column(batch.column("sig"))[0].tobytes(), np.uint64).reshape(batch.num_rows, -1)
            if held:
                c, sig = {f: np.concatenate((held[0][f], c[f])) for f in names}, np.concatenate((held[1].reshape(-1, sig.shape[1]), sig))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (c["token"][1:] != c["token"][:-1]) | (c["block"][1:] != c["block"][:-1]) | (c["salt"][1:] != c["salt"][:-1])
            start = np.flatnonzero(new)
            homes = np.add.reduceat((c["role"] == 0).astype(np.int64), start)
            group = np.cumsum(new) - 1
            v = np.flatnonzero((c["role"] == 1) & (homes[group] > 0))
            first, count = start[group[v]], homes[group[v]]
            total, i = np.cumsum(count), 0
            while i < len(v):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
                if (out := pairs(c, sig, v[i:j], first[i:j], count[i:j])) is not None:
                    yield out
                i = j
            # The homes of the last group wait for visitors of the next batch.
            last = slice(start[-1], start[-1] + homes[-1])
            held = {f: x[last] for f, x in c.items()}, sig[last]

    return run


def _candidates(lists: DataFrame, percent: int, mode: str) -> DataFrame:
    """(a, b, part_a, part_b, token) from open lists (token, id, size, pos, sig, part, main, m): main is the leader's part
    or the largest component, m the length of the list. Everything outside main visits the list's other entries; with
    leaders, the leader does. A list of more than ``HOMES`` is dealt in blocks of like sizes, and visited in those near the visitor's."""
    salts = F.ceil(F.col("m") / HOMES).cast("int")
    # A little more than the ratio of sizes that can link, so that such sizes lie in blocks next to each other.
    block = F.floor(F.log("size") / float(-np.log(percent / 100) * 1.0001)).cast("int")
    long = F.col("salts") > 1
    at = lists.select("token", F.when(F.col("m") > HOMES, block).otherwise(0).alias("block"), (F.col("m") > 2).alias("more"), salts.alias("salts"), "id", "size", "pos", "part", (F.col("part") == F.col("main")).alias("big"), "sig")
    row = lambda role: [F.lit(role).alias("role"), "id", "size", "pos", "part", "big", "more", "sig"]
    homes = (at.where("NOT big") if mode == LEAD else at).select("token", "block", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), *row(0))
    visits = at.where("big" if mode == LEAD else "NOT big")
    visits = visits.withColumn("block", F.explode(F.when(long, F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).otherwise(F.array("block")))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    both = homes.unionByName(visits.select("token", "block", "salt", *row(1))).repartition("token", "block", "salt").sortWithinPartitions("token", "block", "salt", "role")
    return both.mapInArrow(_meet(percent, mode), "a long, b long, part_a long, part_b long, token long").distinct()


def _packed(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def _unpacked(raw) -> np.ndarray:
    return np.frombuffer(raw, "<u8") if len(raw) else np.zeros(0, "<u8")


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if len(p) > len(q):
        p, q = q, p
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0


def _links(both: int, na: int, nb: int, percent: int) -> bool:
    return 100 * both >= percent * (na + nb - both)


def _beside(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``pairs`` with the values x of a and y of b from ``rows`` (id, value)."""
    few = sized(pairs)
    x = rows.select(F.col("id").alias("a"), F.col(value).alias("x")).join(few, "a")
    y = rows.select(F.col("id").alias("b"), F.col(value).alias("y")).join(few.select("a", "b"), "b")
    return x.join(y, ["a", "b"])


def _implausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs of large sets that differ in too many grams by their wide signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                na, nb, differ = apart(x.as_py(), y.as_py())
                out.append(differ > na + nb - 2 * _need(na, nb, percent))
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    both = _beside(pairs.select("a", "b"), reps.where("wide IS NOT NULL"), "wide")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, part_a, part_b) compared as whole sets: linked, n (a's size), and what b has less and more than a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, n, minus, plus = [], [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                less, more = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
                linked.append(_links(len(p) - len(less), len(p), len(q), percent))
                n.append(len(p))
                minus.append(_packed(less))
                plus.append(_packed(more))
            out = batch.select(["a", "b", "part_a", "part_b"]).to_pydict()
            yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in out.items()} | {"linked": pa.array(linked, pa.bool_()), "n": pa.array(n, pa.int64()), "minus": pa.array(minus, pa.binary()), "plus": pa.array(plus, pa.binary())})

    both = _beside(pairs, sets, "grams").select("a", "b", "part_a", "part_b", "x", "y")
    return both.mapInArrow(run, "a long, b long, part_a long, part_b long, linked boolean, n long, minus binary, plus binary")


def derived(pairs: DataFrame, forms: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs whose sets have a leader in common, from their differences to it.

    ``forms``: (id, base, n, minus, plus), n the size of the base's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            cols = (batch.column(c) for c in ("n", "minus_a", "plus_a", "minus_b", "plus_b"))
            for n, *parts in zip(*cols, strict=True):
                ma, pa_, mb, pb = (_unpacked(p.as_buffer()) for p in parts)
                n = n.as_py()
                # Grams of the base that both have, and grams beyond it that both have.
                both = n - len(ma) - len(mb) + _shared(ma, mb) + _shared(pa_, pb)
                linked.append(_links(both, n - len(ma) + len(pa_), n - len(mb) + len(pb), percent))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})

    few = sized(pairs.select("a", "b"))
    form = lambda c: forms.select(F.col("id").alias(c), "base", *([F.col("n")] if c == "a" else []), F.col("minus").alias(f"minus_{c}"), F.col("plus").alias(f"plus_{c}"))
    both = form("a").join(few, "a").join(form("b").join(few, "b"), ["a", "b", "base"]).select("a", "b", "n", "minus_a", "plus_a", "minus_b", "plus_b")
    return both.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


class _Search:
    """The index of documents (d, t), and links between its sets."""

    def __init__(self, base: DataFrame, n: int, percent: int):
        self.base, self.n, self.percent = base, n, percent
        counts = base.sparkSession.sparkContext.broadcast(gram_counts(base, n))
        self.found = table(prefixes(base, n, percent, counts), "gram-prefixes")
        reps = self.found.where("size > 0").groupBy("s1", "s2", "size").agg(F.min("id").alias("id"), F.first("grams").alias("grams"), F.first("sig").alias("sig"), F.first("wide").alias("wide"))
        self.reps = table(reps, "gram-sets")
        entries = self.reps.select("id", "size", F.posexplode("grams").alias("pos", "token"))
        # Counting first leaves a common gram one row a task, so no list is gathered to learn its length.
        shared = entries.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token")
        lists = entries.join(sized(table(shared, "gram-tokens")), "token", "left_semi").join(self.reps.select("id", "sig"), "id")
        self.lists = table(lists.select("token", "id", "size", F.col("pos").cast("long").alias("pos"), "sig"), "gram-lists")
        self.forms: DataFrame | None = None
        self.repeats = not self.found.groupBy("id").count().where("count > 1").isEmpty()

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(id, grams) of the sets that occur in ``pairs``, from their texts."""
        n = self.n

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = K.column(batch.column("t"))
                yield pa.record_batch({"id": batch.column("d"), "grams": pa.array([_packed(s) for s in sets_of(data, off, n)], pa.binary())})

        wanted = table(pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct(), "gram-wanted")
        once = self.base.join(sized(wanted), "d", "left_semi").select("d", "t")
        whole = once.mapInArrow(gather, "id long, grams binary")
        return table(whole.groupBy("id").agg(F.first("grams").alias("grams")) if self.repeats else whole, "gram-whole")

    def open(self, at: DataFrame, mode: str) -> DataFrame:
        """The entries of lists (with part) that hold several components, with main and m."""
        if mode == LEAD:
            stats = at.groupBy("token").agg(F.min_by("id", F.xxhash64("id")).alias("main"), F.count("*").alias("m"))
        else:
            parts = at.groupBy("token", "part").agg(F.count("*").alias("_m"))
            stats = parts.groupBy("token").agg(F.max_by("part", F.struct("_m", "part")).alias("main"), F.sum("_m").alias("m"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
        return table(at.drop("main", "m").join(sized(table(stats, "gram-stats")), "token"), "gram-open")

    def lead(self, at: DataFrame) -> DataFrame:
        """Links of sets to the leaders of their lists; their forms (differences to leaders) are kept."""
        near = table(_candidates(at, self.percent, LEAD).drop("token"), "gram-pairs")
        near = self.plausible(near, self.percent - NEAR)
        got = table(measured(near, self.sets(near), self.percent), "gram-answers")
        own = got.select(F.col("a").alias("id"), F.col("a").alias("base"), "n").distinct()
        nothing = F.lit(b"").alias("minus"), F.lit(b"").alias("plus")
        self.forms = got.select(F.col("b").alias("id"), F.col("a").alias("base"), "n", "minus", "plus").unionByName(own.select("*", *nothing))
        return got.where("linked").select("a", "b", "part_a", "part_b")

    def plausible(self, pairs: DataFrame, percent: int) -> DataFrame:
        return table(pairs.join(sized(table(_implausible(pairs, self.reps, percent), "gram-implausible")), ["a", "b"], "left_anti"), "gram-pairs")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` that link: by forms where both sets have one to the same leader, else as whole sets."""
        pairs = self.plausible(pairs, self.percent)
        short = table(derived(pairs, self.forms, self.percent), "gram-derived")
        rest = table(pairs.join(short, ["a", "b"], "left_anti"), "gram-rest")
        linked = pairs.join(short.where("linked").select("a", "b"), ["a", "b"], "left_semi")
        if rest.isEmpty():
            return linked
        whole = measured(rest, self.sets(rest), self.percent).where("linked").select("a", "b", "part_a", "part_b")
        return linked.unionByName(whole)


def components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, n_shingles (set size), component_id (least key reachable by links, null before others)."""
    base, names = read(docs, key, text)
    out = _groups(base, n, percent)
    return named(out, names, "id", "component_id").select(F.col("id").alias(key), "n_shingles", "component_id")


def _groups(base: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n_shingles, component_id) of documents (d, t)."""
    search = _Search(base, n, percent)
    steps: list[DataFrame] = []
    at = search.open(search.lists.withColumn("part", F.col("id")), LEAD)

    def join(links: DataFrame) -> bool:
        """Links across components join the components' names; whether there are any."""
        nonlocal at
        links = table(links.select("part_a", "part_b").distinct(), "gram-links")
        if links.isEmpty():
            return False
        steps.append(table(connected_components(links, "part_a", "part_b"), "gram-components"))
        at = at.join(steps[-1].toDF("part", "_to"), "part", "left").withColumn("part", F.coalesce("_to", "part")).drop("_to")
        return True

    gained = join(search.lead(at))
    for mode in (BEST, BEST, ALL):
        if mode == BEST and not gained:
            continue
        # A list of two is settled by its leader.
        at = search.open(at.where("m > 2"), mode)
        found = table(_candidates(at, percent, mode), "gram-pairs")
        if found.isEmpty():
            break  # a list with a candidate across components has a best one: the later rounds would find none either
        if mode == BEST:
            at = at.join(sized(table(found.select("token").distinct(), "gram-tokens")), "token", "left_semi")
        across = found.drop("token").distinct()
        gained = join(search.verified(across))
    member = search.found.select("id", "size", "s1", "s2").join(search.reps.select("s1", "s2", "size", F.col("id").alias("rep")), ["s1", "s2", "size"], "left")
    member = member.select("id", "size", F.coalesce("rep", "id").alias("rep"))
    for step in steps:
        member = member.join(step.toDF("rep", "_to"), "rep", "left").withColumn("rep", F.coalesce("_to", "rep")).drop("_to")
    return member.select("id", F.col("size").alias("n_shingles"), F.col("rep").alias("component_id"))


def joined(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: a row a document (key, n_shingles, n_links, component_id), and the linked pairs (a, b) of
    representatives, each the least id of the documents with its set.

    n_links counts the other documents within the limit, equal sets included. All candidates are verified, those inside
    a component too, so a group of m differing near copies costs about m * m / 2 pairs; most are derived from differences."""
    base, names = read(docs, key, text)
    search = _Search(base, n, percent)
    alone = search.lists.withColumn("part", F.col("id"))
    search.lead(search.open(alone, LEAD))
    # Each set is a component of its own, so that no candidate is spared.
    candidates = table(_candidates(search.open(alone, ALL), percent, ALL).drop("token"), "gram-pairs")
    pairs = table(search.verified(candidates).select("a", "b"), "gram-links")
    same = ["s1", "s2", "size"]
    member = search.found.select("id", *same)
    equal = table(member.where("size > 0").distinct().groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("m")), "gram-equals")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(equal.select(F.col("rep").alias("b"), "m"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("m").alias("links"))
    out = member.join(equal, same, "left").join(links, "rep", "left").join(connected_components(pairs).withColumnRenamed("node", "rep"), "rep", "left")
    n_links = F.coalesce(F.col("m") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))
    out = out.select("id", F.col("size").alias("n_shingles"), n_links.alias("n_links"), F.coalesce("component", "rep", "id").alias("component_id"))
    return named(out, names, "id", "component_id").withColumnRenamed("id", key), named(pairs, names, "a", "b")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group: the one with the least id.

    Of rows with the same id and text one stays. Documents without an id are told apart by their texts."""
    base, names = read(docs)
    gone = _groups(base, n, percent).where("id <> component_id").select("id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("key"), text_hash().alias("hash"))
    if names is None:
        gone = table(named(gone, None, "id").select(F.col("id").alias("gone")), "gram-gone")
        left = rows.join(sized(gone), F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    else:
        gone = table(names.join(gone, F.col("d") == F.col("id"), "left_semi").select(F.col("key").alias("gone"), F.col("hash").alias("gone_hash")), "gram-gone")
        left = rows.join(sized(gone), F.col("key").eqNullSafe(F.col("gone")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["key", "hash"])
    return left.select("row.*")
