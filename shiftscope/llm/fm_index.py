"""A compressed FM-index over integer sequences: suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: patterns that are searched side by side
LANES = 1 << 15


class WaveletMatrix:
    """Rank queries on a sequence of integers, one packed bit vector with block counts per level."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = (current >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, dtype=np.uint8)), bitorder="little").view(U)
            counts = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.words.append(packed)
            self.counts.append(counts)
            self.zeros.append(int(len(bits) - counts[-1]))
            one = bits.astype(bool)
            current = np.concatenate([current[~one], current[one]])
        # where each symbol's run begins on the last level
        self.begin = self._descend(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            below = (U(1) << (at & 63).astype(U)) - U(1)
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & below)
            bit = symbols >> (self.levels - 1 - k) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbols, at) - self.begin[symbols]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` values at least, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    reach = 1
    while reach < depth and n:
        following = np.zeros(n, dtype=np.int64)
        following[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = fresh
        reach *= 2
    return order


class FMIndex:
    """Counts the occurrences of patterns of up to ``depth`` symbols, each weighted by its place.

    ``text`` holds symbols 0 .. symbols-1; with suffixes sorted to ``depth`` the
    places of any shorter pattern are one run of the order, which is all that
    backward search needs.
    """

    def __init__(self, text: np.ndarray, symbols: int, weights: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        self.size = len(text)
        self.first = np.zeros(symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.first[1:])
        self.matrix = WaveletMatrix(text[order - 1], symbols)
        self.weight = np.zeros(self.size + 1, dtype=np.int64)
        np.cumsum(weights[order], out=self.weight[1:])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the patterns with one more symbol in front."""
        ranks = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.first[symbols]
        return base + ranks[: len(symbols)], base + ranks[len(symbols) :]

    def matching(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray, least_weight: int) -> np.ndarray:
        """Matching statistics: for each end (exclusive) in ``text`` the length, up to ``most``, of the longest run of symbols before it that occurs with at least ``least_weight``."""
        length = np.zeros(len(ends), dtype=np.int64)
        for i in range(0, len(ends), LANES):
            part = slice(i, i + LANES)
            length[part] = self._matching(text, ends[part], most[part], least_weight)
        return length

    def _matching(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray, least_weight: int) -> np.ndarray:
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), self.size, dtype=np.int64)
        length = np.zeros(len(ends), dtype=np.int64)
        live = np.flatnonzero(most > 0)
        while live.size:
            a, b = self.extend(text[ends[live] - 1 - length[live]], low[live], high[live])
            enough = self.weight[b] - self.weight[a] >= least_weight
            live, a, b = live[enough], a[enough], b[enough]
            low[live], high[live] = a, b
            length[live] += 1
            live = live[length[live] < most[live]]
        return length
