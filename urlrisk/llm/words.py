"""Words of a text and hashes of runs of them, for all words at once."""

from __future__ import annotations

import numpy as np

from .common import Letters, code_points, mix64

STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3  # odd, so that its powers have inverses


class Hasher:
    """Hashes of the words of a text, all at once."""

    def __init__(self):
        self.word = Letters(str.isalnum)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, text: str) -> np.ndarray:
        codes = code_points(text.lower())
        if not len(codes):
            return np.empty(0, np.uint64)
        self._powers(len(codes))
        inside = np.r_[False, self.word(codes), False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[:len(codes)], out=sums[1:])
        return mix64((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def shingles(self, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of ``size`` words (sorted) and their counts; a shorter text is one shingle."""
        w = self.words(text)
        if not len(w):
            return w, np.empty(0, np.int64)
        n = min(size, len(w))
        total = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            total = mix64(total + STEP) + w[i:len(w) - n + 1 + i]
        return np.unique(mix64(total), return_counts=True)


def windows(w: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words (as many as fit), rolled on by powers of one base."""
    n = len(w) - size + 1
    if n < 1 or size < 1:
        return np.empty(0, np.uint64)
    out, power, step = np.zeros(n, np.uint64), w, 1
    base, at, left = BASE, 0, size
    while left:  # hashes of 1, 2, 4 ... words, put together for the bits of the size
        if left & 1:
            out = out * np.uint64(base) + power[at:at + n]
            at += step
        left >>= 1
        if left:
            power = power[:-step] * np.uint64(base) + power[step:]
            base, step = base * base & 0xFFFFFFFFFFFFFFFF, step * 2
    return mix64(out)
