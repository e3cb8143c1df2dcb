"""Hashed word shingles of many texts at once, by array operations on their bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    h = h ^ (h >> np.uint64(31))
    h = h * ODD[0]
    h = h ^ (h >> np.uint64(29))
    h = h * ODD[1]
    return h ^ (h >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of BASE and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        return self.up, self.down


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P, with sum of (byte + 1) * BASE ** place over all before i at P[i]."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of data[start:end], the same wherever it stands."""
    _, down = POWERS.upto(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def shingle_sets(texts: list[bytes], k: int = 4) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A text
    of fewer than k words has one shingle, all its words; one without words none.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = mixed(substring_hashes(prefix_hashes(data), start, end))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, bounds)
    out, lo = [], 0
    n = max(0, len(words) - k + 1)
    every = np.zeros(n, np.uint64)
    for i in range(k):
        every += words[i:i + n] * ODD[i]
    every = mixed(every)
    for hi in upto.tolist():
        if hi - lo >= k:
            out.append(np.unique(every[lo:hi - k + 1]))
        elif hi > lo:
            one = np.append(words[lo:hi] * ODD[:hi - lo], np.full(hi - lo, ODD[4])).sum(dtype=np.uint64)
            out.append(mixed(one.reshape(1)))
        else:
            out.append(np.zeros(0, np.uint64))
        lo = hi
    return out


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` / 64 words a set: bit h mod ``bits`` is the parity of the members there.

    Two rows differ in no more bits than the sets differ in members.
    """
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
        row[:] = np.packbits(odd, bitorder="little").view(np.uint64)
    return out
