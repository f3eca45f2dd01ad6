"""Content-defined anchors: any two equal strings of `size` bytes hold the same anchor at the same offset."""

from __future__ import annotations

import numpy as np

from .hashing import RangeHash

#: Bytes of an anchor's own gram.
GRAM = 40


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - w : width - w + len(h) - width + 1])


def anchor_runs(hashes: RangeHash, start: int, stop: int, size: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor position, anchor hash, first start, last start) over the text at start:stop of the hashed bytes.

    The starts of all strings of `size` bytes are cut into runs that share the anchor: the leftmost gram of least
    hash within the string.
    """
    n = stop - start
    width = size - gram + 1
    if n < size:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    at = np.arange(start, stop - gram + 1)
    h = hashes.of(at, at + gram)
    m = sliding_min(h, width)
    first = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(m) - 1]))
    windows = np.lib.stride_tricks.sliding_window_view(h, width)
    found = []
    while len(first):
        place = np.empty(len(first), np.int64)
        for i in range(0, len(first), 4096):
            s = first[i : i + 4096]
            place[i : i + 4096] = s + (windows[s] == m[s, None]).argmax(axis=1)
        found.append((place, first, np.minimum(last, place)))
        more = last > place  # the least hash occurs again to the right
        first, last = place[more] + 1, last[more]
    a, s, e = (np.concatenate([f[k] for f in found]) for k in range(3))
    return a + start, h[a], s + start, e + start
