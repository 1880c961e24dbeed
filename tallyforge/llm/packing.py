"""Best-fit packing: a configuration linear program over the length histogram.

Documents longer than a sequence are cut into full pieces, the shorter rest first. Only the histogram of piece
lengths (at most one number a length) comes to the driver. There the fractional packing is found by
multiplicative weights: prices on lengths, a knapsack dynamic program that finds the best-paying sequence at
those prices, prices lowered on what it holds. Rounding takes whole numbers of each sequence found and puts
what is left by best fit, lengths in descending order. Pieces then take their places in Spark by their rank
among pieces of equal length.

Null texts are empty: one piece with the end token alone. Repeated rows are separate pieces (told apart by
rank). An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.runtime import sized, table

CAPACITY = 1024
END_ID = 2
#: Rounds of price updates; the histogram bounds their cost, not the number of documents.
ROUNDS = 400
#: Pieces of one length that are ranked together, about; a longer list is ranked in parts.
RANK_PART = 50_000
#: Word pieces whose ids a task remembers (about 250 bytes each).
CACHE = 200_000


def piece_schema(key: str) -> str:
    return f"{key} long, piece int, start long, length long, ids_crc32 long"


_GAP_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")
_encoders: dict[tuple, Encoder] = {}


class Encoder(dict):
    """Little-endian ids of texts, remembering the parts between spaces.

    A space before anything but white space starts a token in this pre-tokenizer, so texts are cut there and
    each distinct part is encoded once. With ``ranks_path`` (the same vocabulary as ranks) new parts are
    encoded by the faster library of the two; the ids are the same. Texts with other spacing, or with a
    special token's string, are encoded as a whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.part = lambda s: self.whole.encode(s, add_special_tokens=False).ids
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.part = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.part(" " + part)).tobytes()
        self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _GAP_BEFORE_SPACE.search(text) or any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > CACHE:
            self.clear()
        head, *parts = text.split(" ")
        return array("I", self.part(head)).tobytes() + b"".join(map(self.__getitem__, parts))


def encoder(tokenizer_path: str, ranks_path: str | None) -> Encoder:
    """One a worker process, kept between tasks."""
    key = (tokenizer_path, ranks_path)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and one end id, cut if longer than ``capacity``."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, ranks_path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, t in zip(keys, texts, strict=True):
                ids = coder.ids(t) + end
                n = len(ids) // 4
                head = n % capacity or capacity
                if n <= capacity:
                    head = n
                bounds = [0, *range(head, n + 1, capacity)]
                out.extend((k, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(cut, piece_schema(key))


def best_sequence(price: np.ndarray, stock: np.ndarray, capacity: int) -> list[int]:
    """The lengths of the sequence of at most ``capacity`` that pays most: a knapsack over lengths in stock."""
    lengths = np.flatnonzero(stock > 0)
    pay = price[lengths]
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value[c], last[c] = value[c - 1], 0
        k = np.searchsorted(lengths, c, "right")
        if k:
            got = value[c - lengths[:k]] + pay[:k]
            i = int(got.argmax())
            if got[i] > value[c]:
                value[c], last[c] = got[i], lengths[i]
    out, c = [], capacity
    while c:
        if last[c]:
            out.append(int(last[c]))
            c -= last[c]
        else:
            c -= 1
    return sorted(out, reverse=True)


def fractional(stock: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """Sequences and how many of each (fractions), together holding the whole stock, by multiplicative weights."""
    lengths = np.arange(capacity + 1, dtype=float)
    covered, used = np.zeros(capacity + 1), defaultdict(float)
    own = stock > 0
    goal = np.where(own, stock, 1.0)
    log_price = np.where(own, np.log(np.maximum(lengths, 1)), -np.inf)
    per_round = max(1.0, float((stock * lengths).sum()) / capacity) / rounds
    for _ in range(rounds):
        price = np.where(own, np.exp(log_price - log_price[own].max()), 0.0)
        found = best_sequence(price, stock, capacity)
        if not found:
            break
        held = np.bincount(found, minlength=capacity + 1)
        used[tuple(found)] += per_round
        covered += held * per_round
        # A length falls in price as it gets ahead of its share of the stock.
        log_price = np.where(own, np.log(np.maximum(lengths, 1)) - 6.0 * (covered / goal - (covered[own] / goal[own]).mean()), -np.inf)
    return sorted(used.items(), key=lambda x: (-x[1], x[0]))


def plan(stock: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences holding the stock exactly: ``stock[n]`` pieces of length n."""
    left = stock.astype(np.int64).copy()
    out: dict[tuple[int, ...], int] = defaultdict(int)
    if left[capacity]:
        out[(capacity,)] += int(left[capacity])
        left[capacity] = 0
    if left.sum() > 0:
        for seq, amount in fractional(left.astype(float), capacity, rounds):
            held = np.bincount(seq, minlength=capacity + 1)
            n = min(int(amount), *(int(left[x] // held[x]) for x in set(seq)))
            if n > 0 and sum(seq) * 50 >= capacity * 49:
                out[seq] += n
                left -= held * n
    # What is left: groups of equal sequences, filled with the longest pieces that fit, longest first.
    while left.any():
        room, seq, n = capacity, [], None
        avail = left.copy()
        while True:
            fit = np.flatnonzero(avail[: room + 1])
            if not len(fit):
                break
            x = int(fit[-1])
            seq.append(x)
            avail[x] -= 1
            room -= x
        held = np.bincount(seq, minlength=capacity + 1)
        n = min(int(left[x] // held[x]) for x in set(seq))
        out[tuple(seq)] += n
        left -= held * n
    return list(out.items())


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): places by rank among pieces of a length."""
    rows, rank, sequence = [], defaultdict(int), 0
    for seq, n in plan_:
        at = 0
        for x in seq:
            rows.append((x, rank[x], n, sequence, at))
            rank[x] += n
            at += x
        sequence += n
    return rows


def pack(pieces_: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces_`` (with a length column) and sequence_id and offset."""
    spark = pieces_.sparkSession
    own = pieces_.columns
    held = table(pieces_, "pieces")
    part = F.pmod(F.xxhash64(*own), F.lit(held.count() // RANK_PART + 1)).cast("int")
    held = held.withColumn("_part", part)
    counts = held.groupBy("length", "_part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = table(counts, "piece-counts")
    stock = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        stock[row["length"]] = row["n"]
    places = spark.createDataFrame(slots(plan(stock, capacity, rounds)), "length long, first long, n long, sequence long, offset long")
    ranked = held.withColumn("_r", F.row_number().over(W.partitionBy("length", "_part").orderBy(*own)) - 1)
    ranked = ranked.join(sized(counts.select("length", "_part", "_before")), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_r"))
    # Few places a length hold most ranks: an equi-join on length, then the range that holds the rank.
    steps = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("_places"))
    at = ranked.join(sized(steps, capacity), "length")
    # The last place that starts at or before the rank, by bisection over the sorted places.
    bisect = F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.struct(F.lit(0).alias("lo"), F.size("_places").alias("hi")), _halve)
    spot = F.get(F.col("_places"), bisect["lo"])
    at = at.withColumn("_spot", spot)
    return at.select(*own, (F.col("_spot.sequence") + F.col("_rank") - F.col("_spot.first")).alias("sequence_id"), F.col("_spot.offset").alias("offset"))


def _halve(acc, _):
    mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
    below = F.get(F.col("_places"), mid)["first"] <= F.col("_rank")
    done = acc["hi"] - acc["lo"] <= 1
    return F.struct(
        F.when(~done & below, mid).otherwise(acc["lo"]).alias("lo"),
        F.when(~done & ~below, mid).otherwise(acc["hi"]).alias("hi"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, ranks_path, key, capacity=capacity), capacity)
