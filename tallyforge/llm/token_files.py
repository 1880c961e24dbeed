"""Token ids in files: canonical length-limited Huffman codes of ids from global counts, read back by table look-up.

Texts are cut where a space stands between two characters that are no white space, since a token of the byte-level
pre-tokenizer begins there; each distinct part of some megabytes is encoded once. The ids go to a table; their counts
(at most one row an id of the vocabulary) come to the driver, which makes the code lengths: the code book. Documents
are then dealt by range of id and sorted, and each task writes segments.

A segment: a header (magic, partition, index, documents, marks, ids, payload bytes, checksum of the book), the
documents' ids, null flags, numbers of token ids and payload bytes, the marks, the payload, a checksum, a line end. A
document's payload begins at a byte; a mark is the bit, from there, at which each ``EVERY``-th id begins, so that blocks
are read independently, all blocks of a segment side by side. Segments are written by Spark's text writer,
``SEGMENTS_PER_FILE`` a file, and read as binary files. The order of documents is that of partition, index and place;
what stands before a segment follows from the sizes of partitions, then of segments inside each.

Null texts are empty and hold the end id alone. Null ids come first. Rows of equal id are ordered by their ids' hash;
rows that repeat everything are interchangeable, and a random number written with them spreads them over tasks. No rows give no rows.
"""

from __future__ import annotations

import base64
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.huffman import Coder, Reader, _marks, code_lengths
from tallyforge.llm.kernels import chunks, column
from tallyforge.runtime import new_path, sized, table

END_ID = 2
EVERY = 512
MAGIC = b"TOKENS1\n"
#: Ids of a segment, about (a longer document is a segment of its own), segments of a file, ids of a partition.
SEGMENT_IDS = 1 << 20
SEGMENTS_PER_FILE = 64
PARTITION_IDS = 1 << 25
#: Bytes of text whose distinct parts are encoded together.
TEXT_BYTES = 1 << 23

_HEADER = struct.Struct("<8sIIIIQQI")
_blank = np.zeros(256, bool)
_blank[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of characters among which some are white space.
_two, _three = 0xC2, (0xE1, 0xE2, 0xE3)
_doubtful = _blank.copy()
_doubtful[[_two, *_three]] = True


def _ends_solid(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no white space (places are at least 1)."""
    back = lambda k: data[np.maximum(end - k, 0)]
    return ~_blank[back(1)] & ~((back(1) >= 0x80) & ((back(2) == _two) | np.isin(back(3), _three)))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin: at every text that has bytes, and at spaces between characters that are surely no white space."""
    p = np.flatnonzero(data == 0x20)
    p = p[(p > 0) & (p < len(data) - 1)]
    clear = _ends_solid(data, p) & ~_doubtful[data[p + 1]]
    out = np.zeros(len(data) + 1, bool)
    out[p[clear]] = True
    out[np.maximum(offsets[1:] - 1, 0)] = False
    out[offsets] = True
    return np.flatnonzero(out[:-1])


class Encoder:
    """Ids of texts. Each distinct part of some texts is encoded once; with ``ranks_path`` (the same vocabulary as ranks) parts
    that no neighbour can change are encoded in one call, and token lengths tell them apart again."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.joined = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            self.size[list(ranks.values())] = list(map(len, ranks))
            self.joined = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one part after the other, and how many each has."""
        data, off = column(parts)
        alone = np.ones(len(parts), bool)
        ids, n = np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        if self.joined and len(parts):
            size = np.diff(off)
            first, second = data[np.minimum(off[:-1], len(data) - 1)], data[np.minimum(off[:-1] + 1, len(data) - 1)]
            alone = (size < 2) | (first != 0x20) | _doubtful[second] | ~_ends_solid(data, off[1:])
            if any(s.encode() in data.tobytes() for s in self.special):
                alone |= np.array([any(s in part for s in self.special) for part in parts.to_pylist()])
            some = parts.filter(pa.array(~alone))
            raw, at = column(some)
            found = self.joined.encode_to_numpy(raw.tobytes().decode(), disallowed_special=()).astype(np.uint32)
            begin = np.cumsum(self.size[found]) - self.size[found]
            head = np.searchsorted(begin, at[:-1])
            if (begin[head] != at[:-1]).any():
                raise ValueError("a token crosses two parts")
            ids, n[~alone] = found, np.diff(np.append(head, len(found)))
        rest = [self.whole.encode(s, add_special_tokens=False).ids for s in parts.filter(pa.array(alone)).to_pylist()]
        own = np.array([i for r in rest for i in r], np.uint32)
        n[alone] = np.fromiter(map(len, rest), np.int64, len(rest))
        # Both kinds in the order of parts.
        place = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        for mask, values in ((~alone, ids), (alone, own)):
            k = n[mask]
            out[np.arange(int(k.sum())) + np.repeat(place[mask] - (np.cumsum(k) - k), k)] = values
        return out, n

    def texts(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind, and where each text's ids begin (and the end)."""
        at = cuts(data, offsets)
        bounds = np.append(at, len(data))
        coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        known, size = self.parts(coded.dictionary)
        known, size = np.append(known, np.uint32(end)), np.append(size, 1)
        first = np.cumsum(size) - size
        before = np.searchsorted(at, offsets)
        which = np.insert(coded.indices.to_numpy(), before[1:], len(size) - 1)
        n = size[which]
        to = np.cumsum(n)
        ids = known[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(first[which] - to + n, n)]
        ends = to[before[1:] + np.arange(len(offsets) - 1)]
        return ids, np.concatenate(([0], ends))


_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    """One a worker process, kept between tasks."""
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encoded(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, key: str = "doc_id", text: str = "text", end: int = END_ID) -> DataFrame:
    """(id, salt, wide, ids): each document's ids with the end id, two bytes each (four if ``wide``), and a random number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, random = _encoder(tokenizer_path, ranks_path), np.random.default_rng()
        for batch in batches:
            data, offsets = column(batch.column(1))
            for i, j in chunks(offsets, TEXT_BYTES):
                ids, at = coder.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                wide = bool(ids.max(initial=0) >> 16)
                ids = ids.astype("<u4" if wide else "<u2")
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ids.itemsize * at), pa.py_buffer(ids)])
                salt = random.integers(np.iinfo(np.int64).min, np.iinfo(np.int64).max, j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(salt), pa.array(np.full(j - i, wide)), held.cast(pa.binary())], names=["id", "salt", "wide", "ids"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).mapInArrow(run, "id long, salt long, wide boolean, ids binary")


def unpacked(wide: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows and where each row's begin (and the end)."""
    data, offsets = column(ids)
    large = wide.to_numpy(zero_copy_only=False)
    if large.all():
        return data.view("<u4"), offsets // 4
    if not large.any():
        return data.view("<u2").astype("<u4"), offsets // 2
    rows = [data[a:b].view("<u4" if x else "<u2") for a, b, x in zip(offsets, offsets[1:], large, strict=False)]
    return np.concatenate(rows).astype("<u4"), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def id_counts(coded: DataFrame) -> np.ndarray:
    """How often each id occurs; at most one row an id comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(unpacked(batch.column(0), batch.column(1))[0])
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["id", "n"])

    rows = coded.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def segment(coder: Coder, book: int, partition: int, index: int, keys: pa.Array, ids: np.ndarray, at: np.ndarray) -> bytes:
    packed, begin, marks = coder.pack(ids, at, EVERY)
    parts = [
        _HEADER.pack(MAGIC, partition, index, len(keys), len(marks), len(ids), len(packed), book),
        keys.fill_null(0).to_numpy().astype("<i8").tobytes(), keys.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(),
        np.diff(at).astype("<u4").tobytes(), np.diff(begin).astype("<u8").tobytes(), marks.astype("<u8").tobytes(), packed.tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def _segments(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, book, partition, index = Coder(lengths), zlib.crc32(lengths.tobytes()), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, bounds = unpacked(batch.column(1), batch.column(2))
            for i, j in chunks(bounds, SEGMENT_IDS):
                at = bounds[i : j + 1]
                made = segment(coder, book, partition, index, batch.column(0).slice(i, j - i), ids[at[0] : at[-1]], at - at[0])
                yield pa.record_batch([pa.array([made], pa.binary())], names=["value"])
                index += 1

    return run


def write(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END_ID) -> str:
    """Write the ids of all documents in ascending order of ``key``; the folder's path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    coded = table(encoded(docs, tokenizer_path, ranks_path, key, text, end), "token-ids", "zstd")
    counts = id_counts(coded)
    lengths = code_lengths(counts)
    raw = lambda df: df.select(F.col("value").cast("string").alias("value"))
    raw(spark.createDataFrame([(bytearray(zlib.compress(lengths.tobytes())),)], "value binary")).coalesce(1).write.text(f"{path}/book")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PARTITION_IDS + 1)
    order = [F.col("id").asc_nulls_first(), F.xxhash64("ids"), F.col("salt")]
    dealt = coded.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "wide", "ids")
    raw(dealt.mapInArrow(_segments(lengths), "value binary")).write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(f"{path}/segments")
    return path


def parsed(data: bytes, reader: Reader, book: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(partition, index, documents' ids, null flags, numbers of ids, ids) of each segment in a file's bytes."""
    at = 0
    while at < len(data):
        magic, partition, index, docs, n_marks, n_ids, size, own = _HEADER.unpack_from(data, at)
        end = at + _HEADER.size + 21 * docs + 8 * n_marks + size
        if magic != MAGIC or own != book or struct.unpack_from("<I", data, end)[0] != zlib.crc32(memoryview(data)[at:end]):
            raise ValueError(f"segment {partition}/{index} is damaged or of another code book")
        at += _HEADER.size
        cols = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", docs), ("<u8", n_marks), ("u1", size)):
            cols.append(np.frombuffer(data, kind, n, at))
            at += cols[-1].nbytes
        keys, null, n, sizes, marks, payload = cols
        n = n.astype(np.int64)
        begin = 8 * (np.cumsum(sizes) - sizes).astype(np.int64)
        # Blocks: each document's first, then those at its marks.
        blocks = np.maximum(1, -(-n // EVERY))
        bit = np.repeat(begin, blocks)
        head = np.cumsum(blocks) - blocks
        later = np.ones(len(bit), bool)
        later[head] = False
        bit[later] += marks.astype(np.int64)
        count = np.full(len(bit), EVERY, np.int64)
        count[head + blocks - 1] = n - EVERY * (blocks - 1)
        ids = reader.read(payload, bit, count)
        if len(ids) != n_ids:
            raise ValueError(f"segment {partition}/{index} holds {len(ids)} ids, not {n_ids}")
        yield partition, index, keys, null, n, ids
        at = end + 5


def read(spark: SparkSession, path: str, key: str = "doc_id", digest: bool = False, end: int = END_ID) -> DataFrame:
    """(key, start, n_tokens, ids) of every document in the files of ``path``; with ``digest``, ids_crc32 instead of ids.
    A document whose last id is not the end id is an error."""
    packed = spark.read.format("binaryFile").load(f"{path}/book").select("content").collect()
    lengths = np.frombuffer(zlib.decompress(max((bytes(r["content"]) for r in packed), key=len)), np.uint8)
    book = zlib.crc32(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lengths)
        for batch in batches:
            for data in batch.column(0):
                for partition, index, keys, null, n, ids in parsed(data.as_buffer().to_pybytes(), reader, book):
                    at = np.concatenate(([0], np.cumsum(n)))
                    if (ids[at[1:] - 1] != end).any():
                        raise ValueError(f"segment {partition}/{index}: a document does not end with {end}")
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    if digest:
                        own = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
                    else:
                        own = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    full = lambda x: pa.array(np.full(len(n), x, np.int64))
                    yield pa.record_batch([pa.array(keys, mask=null.astype(bool)), full(partition), full(index), full(len(ids)), pa.array(at[:-1]), pa.array(n), own], names=["id", "p", "i", "held", "at", "n_tokens", "own"])

    found = spark.read.format("binaryFile").load(f"{path}/segments").select("content").mapInArrow(run, f"id long, p long, i long, held long, at long, n_tokens long, own {'long' if digest else 'array<int>'}")
    found = table(found, "tokens-read")
    # One row a segment, then one row a partition.
    segments = table(found.groupBy("p", "i").agg(F.first("held").alias("held")), "token-segments")
    ahead = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("p").agg(F.sum("held").alias("held")).withColumn("_p", ahead(W.orderBy("p"))).select("p", "_p")
    base = segments.join(parts, "p").select("p", "i", (F.col("_p") + ahead(W.partitionBy("p").orderBy("i"))).alias("_base"))
    of = found.join(sized(table(base, "token-bases")), ["p", "i"])
    return of.select(F.col("id").alias(key), (F.col("_base") + F.col("at")).alias("start"), "n_tokens", F.col("own").alias("ids_crc32" if digest else "ids"))
