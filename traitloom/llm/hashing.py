"""Vectorised 64-bit hashes of byte ranges and of words."""

from __future__ import annotations

import numpy as np

#: An odd base, so that powers can be undone modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:
        m = min(size, n - size)
        out[size : size + m] = out[:m] * np.uint64(pow(base, size, 1 << 64))
        size += m
    return out


class RangeHash:
    """Hashes of ranges of a byte array; equal bytes give equal hashes wherever they stand."""

    #: powers are kept between calls
    up = powers(BASE, 1 << 10)
    down = powers(INVERSE, 1 << 10)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(RangeHash.up) < n + 1:
            RangeHash.up, RangeHash.down = powers(BASE, n + 1), powers(INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        value = data.astype(np.uint64)
        value += np.uint64(1)
        value *= RangeHash.up[:n]
        np.cumsum(value, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = self.sums[stop] - self.sums[start]
        out *= RangeHash.down[start]
        out += (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)


def is_space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = is_space_table()


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate(([0], edge))
    if len(mask) and mask[-1]:
        edge = np.concatenate((edge, [len(mask)]))
    return edge[::2], edge[1::2]


def joined(texts: list[bytes], gap: bytes = b" ") -> tuple[bytes, np.ndarray]:
    """All texts, each followed by a gap, and their starts (with the end of all)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(gap)
    return gap.join(texts) + gap if texts else b"", np.concatenate(([0], np.cumsum(sizes)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words [^\\x20\\x09-\\x0D]+ of all texts in order, and where each text's begin (with the end)."""
    data, starts = joined(texts)
    a = np.frombuffer(data.lower(), np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    s, e = spans_of(~SPACE[a])
    return RangeHash(a).of(s, e), np.searchsorted(s, starts)
