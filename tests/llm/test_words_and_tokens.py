"""Spelling variants, importance resampling and token files against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import huffman, resampling, spelling, sql, token_files
from tallyforge.llm.crc import crc32

public_tokenizers = pytest.importorskip("public_tokenizers")
# Extra columns clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, word string, n long, id string, key string, m long, salt string, rank string, score double"


def low(text):
    return re.sub("[A-Z]", lambda x: x[0].lower(), text or "")


def spread(rows):
    return [(i, t, "w", 1, "i", "k", 2, "s", "r", 0.5) for i, t in rows]


def texts(seed=5):
    rng = random.Random(seed)
    base = ["station", "stationen", "straße", "Quality", "aaaaaaa", "aaaaaaaa", "reader", "leader", "lesser", "letter", "better"]
    edit = lambda w: (lambda i: rng.choice([w[:i] + w[i + 1 :], w[:i] + "é" + w[i + 1 :], w[:i] + "x" + w[i:]]))(rng.randrange(len(w)))
    say = lambda n: " ".join(edit(rng.choice(base)) if rng.random() < 0.2 else rng.choice(base) for _ in range(n))
    rows = [(i, say(60)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "×÷×÷×÷ÀÿÀÿÀÿ ×÷×÷×÷"), (103, "word" * 3000 + " " + "word" * 3000 + "s"), (103, "station " * 30), (None, "Station, stations! stations; stations: stations-stations")]
    rows += [(i, "word" * 3000 + " " + "word" * 3000 + "s  <|endoftext|> \n x  y 　z don't  ") for i in range(104, 110)]
    return rows + [(7, rows[7][1])] * 2


def plain_variants(rows, slip=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", low(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    form, out = {}, set()
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("slip", [199, 7])
def test_variants(spark, slip):
    rows = texts()
    got = spelling.variants(spark.createDataFrame(spread(rows), SCHEMA).repartition(5), slip=slip)
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain_variants(rows, slip)
    assert any(r["form"] for r in got.collect())


def test_variants_of_nothing_and_chains(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "aabbcc " * 5 + "aabbcd " * 25 + "aabbdd " * 125 + "aabddd " * 625)]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(spread(rows), SCHEMA), slip=10**9).collect()}
    assert set(got.values()) == {"aabddd"} and len(got) == 4
    found = spelling.variants(spark.createDataFrame(spread(rows), SCHEMA), slip=10**9)
    changed = spelling.normalized(spark.createDataFrame(spread(rows), SCHEMA), found)
    assert {(r["doc_id"], r["word"], r["n"]) for r in changed.collect()} == {(1, "aabbcc", 5), (1, "aabbcd", 25), (1, "aabbdd", 125)}


def test_deletion_keys_agree_with_strings():
    words = ["aab", "ab", "ba", "abc", "aßc", "é" * 9, "q"]
    points, at = spelling._points(pa.array(words))
    key, word, place = spelling.deletion_keys(points, at)
    strings = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(word, place, strict=True)]
    by = {}
    for k, s in zip(key.tolist(), strings, strict=True):
        assert by.setdefault(s, k) == k
    assert len(set(by.values())) == len(by)


def test_keys_that_agree_by_chance_are_told_apart(spark, monkeypatch):
    true = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda points, at: (lambda k, w, p: (k * np.uint64(0), w, p))(*true(points, at)))
    words = spark.createDataFrame([(1, "station", 50), (2, "stations", 7), (3, "reader", 9), (4, "leader", 5)], "wid long, word string, n long").coalesce(1)
    # All keys are equal, as in the worst collision: strings still decide.
    import tallyforge.llm.spelling as own

    batches = list(own._met(own._keyed(iter([pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["station", "stations", "reader", "leader"])], names=["wid", "word"])]))))
    assert sum(b.num_rows for b in batches) == 7 + 8 + 6 + 6 + 4
    got = {r["word"]: (r["n_near"], r["best"]["word"]) for r in own.near_words(words).collect()}
    assert got == {"station": (1, "stations"), "stations": (1, "station"), "reader": (1, "leader"), "leader": (1, "reader")}


def test_runs_of_keys_across_batches():
    key, wid = [1, 1, 2, 2, 2, 3, 4, 4], [5, 6, 7, 7, 8, 9, 3, 3]
    for size in range(1, 9):
        parts = [pa.record_batch([pa.array(key[i : i + size]), pa.array(wid[i : i + size]), pa.array([0] * len(key[i : i + size]), pa.int32())], names=["key", "wid", "place"]) for i in range(0, 8, size)]
        got = [tuple(r.values())[:2] for b in spelling._met(iter(parts)) for r in b.to_pylist()]
        assert got == [(1, 5), (1, 6), (2, 7), (2, 7), (2, 8)]


def test_crc32_of_many():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2500) for _ in range(300)])
    end = start + np.array([rng.choice([0, 1, 7, 47, 48, 49, 400]) for _ in start])
    before = np.array([zlib.crc32(str(i).encode()) for i in range(300)], np.uint32)
    want = [zlib.crc32(data[a:b], int(c)) for a, b, c in zip(start, end, before, strict=True)]
    assert crc32(np.frombuffer(data, np.uint8), start, end, before).tolist() == want
    assert len(crc32(np.zeros(0, np.uint8), start[:0], end[:0])) == 0


def plain_resampling(rows, target, buckets=10_000):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]], len(w)

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[0])
    for x in target:
        t.update(features(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t_size + 0.0) / ((s[b] + 1) * (s_size + 0.0)))) for t_size, s_size in [(sum(s.values()) + buckets, sum(t.values()) + buckets)] for b in set(s) | set(t)}
    out, able = [], []
    for i, x in rows:
        f, n = features(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        row = (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        (able if n >= 20 else out).append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = 25 * len(able) // 100
    return Counter([(*r, None) for r in out] + [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)])


@pytest.mark.parametrize("hot,together", [(10_000, 65_536), (3, 2)])
def test_resampling(spark, monkeypatch, hot, together):
    monkeypatch.setattr(resampling, "HOT", hot)
    monkeypatch.setattr(resampling, "TOGETHER", together)
    rows = texts() + [(i, "the same reader reads a better letter " * 4) for i in range(200, 240)] + [(300, "one hot row that repeats itself " * 5)] * 30
    target = ["Better letter readers", None, "station straße 12 12"]
    docs = spark.createDataFrame(spread(rows), SCHEMA).repartition(4)
    got = resampling.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_resampling(rows, target)


def test_resampling_of_nothing_and_drawn_rows(spark):
    empty, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(empty, bench).collect() == []
    docs = spark.createDataFrame(spread([(i, f"text {i} " * 30) for i in range(40)]), SCHEMA)
    assert Counter(tuple(r) for r in resampling.resample(docs, bench).collect()) == plain_resampling([(i, f"text {i} " * 30) for i in range(40)], [])
    drawn = resampling.draw(docs, bench)
    assert drawn.columns == docs.columns and drawn.count() == 10
    four = resampling.resample(docs, bench, buckets=100_000).count()
    assert four == 40


def test_code_lengths():
    def least(counts):
        import heapq

        heap, total = sorted(c for c in counts if c), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        return total

    rng = np.random.default_rng(2)
    for n in (2, 3, 9, 200):
        counts = rng.integers(0, 500, n)
        lengths = huffman.code_lengths(counts)
        assert (lengths * counts).sum() == least(counts.tolist()) and ((lengths > 0) == (counts > 0)).all()
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    for limit in (5, 12, 29):
        lengths = huffman.code_lengths(np.array(fib), limit)
        assert lengths.max() <= limit and abs(sum(2.0 ** -int(x) for x in lengths) - 1) < 1e-9
    assert huffman.code_lengths(np.array([0, 9])).tolist() == [0, 1] and huffman.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    codes, lengths = huffman.codes(np.array([2, 1, 3, 3], np.uint8)), [2, 1, 3, 3]
    assert [f"{c:0{n}b}" for c, n in zip(codes.tolist(), lengths, strict=True)] == ["10", "0", "110", "111"]


def test_segments_and_damage():
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.2, 20_000) % 70_000).astype(np.uint32)
    at = np.array([0, 1, 513, 513 + 1024, 9000, 20_000])
    lengths = huffman.code_lengths(np.bincount(ids))
    coder, reader = huffman.Coder(lengths), huffman.Reader(lengths)
    keys = pa.array([3, None, 5, 6, 7], pa.int64())
    data = b"".join(token_files.segment(coder, 9, 1, i, keys, ids, at) + b"\n" for i in range(2))
    for i, (p, index, own, null, n, got) in enumerate(token_files.parsed(data, reader, 9)):
        assert (p, index) == (1, i) and (got == ids).all() and n.tolist() == np.diff(at).tolist()
        assert own.tolist() == [3, 0, 5, 6, 7] and null.tolist() == [0, 1, 0, 0, 0]
    bad = bytearray(data)
    bad[len(bad) // 4] ^= 1
    with pytest.raises(ValueError):
        list(token_files.parsed(bytes(bad), reader, 9))
    with pytest.raises(ValueError):
        list(token_files.parsed(data, reader, 8))


def test_wide_and_narrow_ids():
    rows = [np.array([1, 2], "<u2"), np.array([70_000, 3], "<u4")]
    for pick in ([0], [1], [0, 1], [1, 0], []):
        ids, at = token_files.unpacked(pa.array([bool(i) for i in pick], pa.bool_()), pa.array([rows[i].tobytes() for i in pick], pa.binary()))
        assert ids.tolist() == [x for i in pick for x in rows[i].tolist()] and at.tolist() == [2 * i for i in range(len(pick) + 1)]


@pytest.mark.parametrize("ranks", [True, False])
def test_token_files(spark, monkeypatch, ranks):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SEGMENTS_PER_FILE", 2)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    odd = [" ", "  ", "\n", "\t ", "a", "Ω", " ", " ", "　", " ", "\x1c", "\x85", "'s", "<|endoftext|>", "99", "é", "—", "日本", "​"]
    rows = texts() + [(1000 + i, "".join(rng.choice(odd) for _ in range(rng.randrange(40)))) for i in range(150)]
    docs = spark.createDataFrame(spread(rows), SCHEMA).repartition(4)
    path = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken") if ranks else None)
    listed = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in listed] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in listed] == np.cumsum([0] + [r["n_tokens"] for r in listed])[:-1].tolist()
    own = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in listed) == own
    digests = {(r["start"], r["ids_crc32"]) for r in token_files.read(spark, path, digest=True).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in listed}


def test_token_files_of_nothing(spark):
    path = token_files.write(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read(spark, path).collect() == []


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_importance_resampling"])
def test_sql(spark, tmp_path, name):
    from tallyforge.llm import queries

    rows = [(i, t) for i, t in texts(8) if i is not None and i not in (7, 103)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Better letter readers"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(sql.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
