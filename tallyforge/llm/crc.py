"""CRC-32 of many byte strings at once."""

from __future__ import annotations

import zlib

import numpy as np


_POLYNOMIAL = np.uint32(0xEDB88320)
#: Strings longer than this are passed to zlib one by one.
_LONG = 48


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ _POLYNOMIAL, t >> np.uint32(1))
    return t


_table = _byte_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of each stretch of ``data`` (uint8), continued from ``before`` (CRC-32s of what stands in front of it)."""
    size = end - start
    state = np.zeros(len(size), np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(np.minimum(size, _LONG + 1).astype(np.int8), kind="stable")[::-1]
    ordered, at, now = size[order], start[order], ~state[order]
    n_long = int(np.searchsorted(-ordered, -_LONG, "left"))
    # Longest first: after k bytes those still at work are a prefix.
    live = np.searchsorted(-ordered, -np.arange(1, _LONG + 1), "right")
    for k in range(_LONG):
        a, b = n_long, int(live[k])
        if b <= a:
            break
        now[a:b] = _table[(now[a:b] ^ data[at[a:b] + k]) & np.uint32(0xFF)] ^ (now[a:b] >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~now
    raw = memoryview(np.ascontiguousarray(data))
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(raw[start[i] : end[i]], int(state[i]))
    return out


def of_bytes(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))



