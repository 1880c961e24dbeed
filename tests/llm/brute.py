"""Plain versions of the contract digests, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substring_dedup(docs, length=100):
    """op1: {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}; ids are distinct."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def quality(text):
    """op2: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if wins[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def shingles(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard(docs, k=4, num=85):
    """op3: {doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t, k) for i, t in docs}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = Counter()
    for ids in lists.values():
        ids.sort()
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    edges = [p for p, c in common.items() if 100 * c >= num * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    r = roots(sets, edges)
    return {i: (len(s), r[i]) for i, s in sets.items()}


def window_dedup(docs, k=35):
    """op9: {doc_id: (n_words, n_removed, kept_sha256)}"""
    texts = {i: WORD.findall(t or "") for i, t in docs}
    n = Counter(tuple(w[s : s + k]) for w in texts.values() for s in range(len(w) - k + 1))
    out = {}
    for i, w in texts.items():
        gone = set()
        for s in range(len(w) - k + 1):
            if n[tuple(w[s : s + k])] > 1:
                gone.update(range(s, s + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), sha(kept.encode()))
    return out


ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """op8: n_assign, n_access, n_hex, base_sha256."""
    t = text or ""
    found = [("assign", m) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1].start(), order.index(x[0])))
    n = Counter(k for k, _ in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found).encode())


def cosine(rows, least=0.98):
    """op5: {vec_id: (n_links, component_id, kept)}"""
    import numpy as np

    by = defaultdict(list)
    for i, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append((i, np.array(v, dtype=float)))
    links, edges = Counter(), []
    for own in by.values():
        m = np.stack([v for _, v in own])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= least), strict=True):
            if a < b:
                edges.append((own[a][0], own[b][0]))
                links.update(edges[-1])
    r = roots([i for i, _, _ in rows], edges)
    return {i: (links[i], r[i], r[i] == i) for i, _, _ in rows}


IDENT = re.compile(r"""(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}|(?ai:client_?id|access_?id|user_?name|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""")
ENDPOINT = re.compile(r"""(?:https?|s3|postgres|mysql|mongodb|redis)://[^\x20\x09-\x0D"'<>]{4,}""")


def secret_spans(text, scope=200):
    """op8: base spans in order, then the linked ones: (start, rank, end, kind)."""
    t = text or ""
    kinds = ["assign", "access", "hex", "ident", "key", "endpoint"]
    found = [("assign", m) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    found += [("ident", m) for m in IDENT.finditer(t)]
    found += [("key", m) for m in re.finditer("[A-Za-z0-9+/_=-]+", t) if len(m[0]) >= 24 and all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    found += [("endpoint", m) for m in ENDPOINT.finditer(t)]
    spans = sorted((m.start(), kinds.index(k), m.end(), k) for k, m in found)
    near = lambda s, own: any(k in own and abs(a - s) <= scope for a, _, _, k in spans)
    needs = {"ident": [("assign", "hex", "key")], "key": [("access", "ident")], "endpoint": [("access", "ident"), ("assign", "hex", "key")]}
    linked = [x for x in spans if x[3] in needs and all(near(x[0], own) for own in needs[x[3]])]
    return [x for x in spans if x[1] < 3] + linked
