"""Canonical length-limited Huffman coding of arrays of numbers: code lengths, packing and table-driven reading."""

from __future__ import annotations

import numpy as np

from tallyforge.llm.kernels import U

#: Longest code, in bits, while the symbols fit; a window of this many bits is looked up at once.
LIMIT = 20
MOST = 25


def limit_for(symbols: int) -> int:
    bits = max(LIMIT, (max(symbols, 1) - 1).bit_length())
    if bits > MOST:
        raise ValueError(f"{symbols} symbols need codes of more than {MOST} bits")
    return bits


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """The code length of each symbol (0 if it does not occur): the least total under the limit, by package-merge."""
    used = np.flatnonzero(counts)
    limit = limit or limit_for(len(used))
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    level, single = weight, np.ones(len(weight), bool)
    own = [single]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weight, pairs))
        sort = np.argsort(both, kind="stable")
        level, single = both[sort], sort < len(weight)
        own.append(single)
    take, n = 2 * len(order) - 2, np.zeros(len(order), np.uint8)
    for flags in reversed(own):
        singles = int(flags[:take].sum())
        n[:singles] += 1
        take = 2 * (take - singles)
    out[order] = n
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: in order of length, then symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), U)
    if len(order):
        size = lengths[order].astype(np.int64)
        # A code is the sum of the shares of the code space that stand before it, cut to its length.
        share = np.left_shift(np.int64(1), MOST - size)
        out[order] = ((np.cumsum(share) - share) >> (MOST - size)).astype(U)
    return out


class Coder:
    """Packs symbols; the highest bit of a code comes first."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), codes(lengths)
        # Codes moved to the top of 64 bits.
        self.high = self.codes << (U(64) - np.maximum(self.lengths, 1).astype(U))

    def pack(self, symbols: np.ndarray, at: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, where each list of symbols begins in them and the end, marks): ``at`` says where lists begin in
        ``symbols``, and the end. A mark is the bit, from its list's beginning, of each ``every``-th symbol but the first."""
        size = self.lengths[symbols]
        done = np.concatenate(([0], np.cumsum(size)))
        n = np.diff(at)
        bits = done[at[1:]] - done[at[:-1]]
        begin = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
        bit = done[:-1] + np.repeat(8 * begin[:-1] - done[at[:-1]], n)
        word, off = bit >> 6, (bit & 63).astype(U)
        value = self.high[symbols]
        out = np.zeros(int(begin[-1]) // 8 + 2, U)
        if len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[first]] = np.bitwise_or.reduceat(value >> off, first)
            over = np.flatnonzero((bit & 63) + size > 64)
            out[word[over] + 1] |= value[over] << (U(64) - off[over])
        marked, base = _marks(n, every)
        marks = done[at[:-1][base] + marked] - done[at[:-1][base]]
        return out.astype(">u8").view(np.uint8)[: begin[-1]], begin, marks


def _marks(n: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``every``, 2 ``every``, ... below each n, and which n each is of."""
    each = np.maximum(0, (n - 1) // every)
    base = np.repeat(np.arange(len(n)), each)
    return (np.arange(len(base)) - np.repeat(np.cumsum(each) - each, each) + 1) * every, base


class Reader:
    """Reads blocks side by side: one table look-up a symbol, for all blocks at once."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=0)))
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.size = np.zeros(1 << self.bits, np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.left_shift(np.int64(1), self.bits - lengths[order].astype(np.int64))
        self.symbol[: span.sum()] = np.repeat(order, span)
        self.size[: span.sum()] = np.repeat(lengths[order], span)

    def read(self, data: np.ndarray, bit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The symbols of all blocks, one block after the other: each begins at its bit and holds ``count`` symbols."""
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        words = np.ndarray((len(data) + 1,), ">u4", padded.tobytes(), strides=(1,))
        out = np.empty(int(count.sum()), np.uint32)
        order = np.argsort(-count, kind="stable")
        at, to = bit[order].astype(np.int64), (np.cumsum(count) - count)[order]
        live = np.searchsorted(-count[order], -np.arange(int(count.max(initial=0))), "left")
        top, mask = 32 - self.bits, (1 << self.bits) - 1
        for k in live.tolist():
            now = at[:k]
            found = (words[now >> 3].astype(np.int64) >> (top - (now & 7))) & mask
            out[to[:k]] = self.symbol[found]
            to[:k] += 1
            now += self.size[found]
        if (at > 8 * len(data)).any() or (count.any() and not self.size.any()):
            raise ValueError("a block reads beyond its end")
        return out
