"""Array helpers that run inside tasks: Arrow texts to words, rolling hashes and minimizer anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = {"b": np.ones(1, U), "i": np.ones(1, U)}
#: Positions take the low bits of an anchor's sort key, so a piece has fewer symbols than this.
POSITION_BITS = 24
PIECE = 1 << 23

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["b"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("b", _BASE), ("i", _BASE_INV)):
            p = np.full(size, base, U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[key] = p
    return _powers["b"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    bufs, n = array.buffers(), len(array)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and n else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(offsets: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Prefix:
    """Hashes of any stretch of an array of symbols, from one running sum."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        p, _ = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum((symbols.astype(U) + U(1)) * p[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed with the length, so that stretches of different lengths differ."""
        _, inv = powers(self.n + 1)
        return mix((self.sums[end] - self.sums[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        _, inv = powers(self.n + 1)
        return mix((self.sums[k:] - self.sums[:-k]) * inv[: self.n - k + 1])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and, for each document, the number of words before it."""
    solid = ~_space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on (zeros behind the end), as one number each."""
    padded = np.concatenate((data, np.zeros(15 - len(data) % 8, np.uint8)))
    out = np.empty(len(padded) - 7, U)
    for i in range(8):
        part = padded[i : i + (len(padded) - i) // 8 * 8].view("<u8")
        out[i::8] = part[: len(out[i::8])]
    return out


#: Words longer than this are hashed by BLAKE2b, the others eight bytes at a time.
_LONG_WORD = 64
_masks = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes. Nothing in it is linear, so no two patterned words are sure to collide."""
    size = end - start
    out = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + U(1))
    if not len(size):
        return out
    eights, at, live = _eights(data), start, None
    for k in range(0, _LONG_WORD, 8):
        live = np.flatnonzero((size > k) & (size <= _LONG_WORD)) if k else np.flatnonzero(size <= _LONG_WORD)
        if not len(live):
            break
        out[live] = mix(out[live] ^ mix((eights[at[live] + k] & _masks[np.minimum(size[live] - k, 8)]) + U(0xA0761D6478BD642F)))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes, mixed word by word."""
    m = max(0, len(word) - n + 1)
    out = np.full(m, n, U)
    for i in range(n):
        out = mix(out + word[i : m + i] * U(0x9E3779B97F4A7C15))
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit BLAKE2b digests of stretches of bytes, in two halves: equal digests stand for equal bytes."""
    raw = memoryview(np.ascontiguousarray(data))
    both = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    halves = np.frombuffer(both, np.int64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each with one space behind it, and where each word begins there (and the end)."""
    at = np.concatenate(([0], np.cumsum(end - start + 1)))
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = data[~_space[data]]
    return out, at


def lower(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, span = len(x) - w + 1, 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n]) if span < w else x[:n]


def anchors(symbols: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows (``length`` symbols of one document) that share their minimizer (a k-gram).

    Returns for each run: document, first window (from the document's start), windows, hash of the
    minimizer, and how far it lies behind the start of the first window. Which k-gram is a window's minimizer depends on the window alone (least hash, leftmost on
    ties), so equal windows lie in runs of equal hash. ``bounds``: where documents start, and the end.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(symbols), PIECE):
        hi = min(len(symbols), lo + PIECE + length - 1)
        if hi - lo < length:
            break
        part = Prefix(symbols[lo:hi])
        gram = part.grams(k)
        low = U((1 << POSITION_BITS) - 1)
        least = sliding_min((gram & ~low) | np.arange(len(gram), dtype=U), length - k + 1)
        edge = np.zeros(hi - lo + 2, np.int8)
        a, b = np.clip(bounds[:-1] - lo, 0, hi - lo), np.clip(bounds[1:] - lo - length + 1, 0, hi - lo)
        ok = b > a
        np.add.at(edge, a[ok], 1)
        np.add.at(edge, b[ok], -1)
        at = np.flatnonzero(np.cumsum(edge)[: len(least)])
        if not len(at):
            continue
        pos = (least[at] & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)
        run = np.flatnonzero(new)
        start = at[run] + lo
        doc = np.searchsorted(bounds, start, "right") - 1
        found.append((doc, start - bounds[doc], np.diff(np.append(run, len(at))), gram[pos[run]], pos[run] - at[run]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U), z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
