"""Changepoint search on one series (numpy): penalised optimal partitioning with a kernel cost, and cut helpers."""

from __future__ import annotations

import numpy as np

#: ends whose costs one matrix product gives
BLOCK = 64


def median_square_distance(x: np.ndarray) -> float:
    """Median of the positive squared distances over all pairs of rows; 1 if all rows are equal.

    Pairs are counted by the leading bits of their distance, block by block, so
    memory stays small at any length; then those of the median's own range are sorted.
    """
    n, norms = len(x), (x * x).sum(1)

    def blocks():
        for i in range(0, n, 256):
            d2 = norms[i : i + 256, None] + norms[None, i:] - 2 * x[i : i + 256] @ x[i:].T
            yield d2[np.arange(d2.shape[1])[None] > np.arange(d2.shape[0])[:, None]]

    floor = 1e-13 * max(1e-300, float(norms.max(initial=0)))
    counts = np.zeros(1 << 15, dtype=np.int64)
    for d2 in blocks():
        d2 = d2[d2 > floor]
        counts += np.bincount(d2.view(np.int64) >> 49, minlength=1 << 15)[: 1 << 15]
    total = int(counts.sum())
    if not total:
        return 1.0
    ahead = np.cumsum(counts)
    ranks = [(total - 1) // 2, total // 2]
    cells = np.searchsorted(ahead, ranks, side="right")
    held = np.sort(np.concatenate([d2[(d2 > floor) & np.isin(d2.view(np.int64) >> 49, cells)] for d2 in blocks()]))
    before = int(ahead[cells[0] - 1]) if cells[0] else 0
    between = int(counts[cells[0] + 1 : cells[1]].sum()) if cells[1] > cells[0] else 0  # empty cells only
    return float(held[[ranks[0] - before, ranks[1] - before - between]].mean())


def kernel_features(x: np.ndarray, width: float, error: float) -> np.ndarray:
    """Rows whose inner products are the Gaussian kernel values up to ``error``: a pivoted incomplete Cholesky factor."""
    n = len(x)
    left, columns = np.ones(n), []
    norms = (x * x).sum(1)
    while len(columns) < n and left[pivot := int(left.argmax())] > error:
        column = np.exp(-np.maximum(0, norms + norms[pivot] - 2 * x @ x[pivot]) / width)
        for done in columns:
            column = column - done * done[pivot]
        column = column / np.sqrt(left[pivot])
        columns.append(column)
        left = np.maximum(0, left - column**2)
        left[pivot] = 0
    return np.stack(columns, axis=1)


def pelt(x: np.ndarray, least: int, penalty: float = 3.0, jump: int = 1) -> list[int]:
    """Ends of the optimal segments under the RBF kernel cost, with pruned dynamic programming.

    A segment costs its length less the mean kernel value over its pairs times its
    length; the kernel's width is the median squared distance of the rows.  Costs come from
    prefix sums of features whose products are the kernel, so memory grows with the
    steps alone and series of any length are searched at their own steps.  A start is
    dropped once a later one is at least as good for all ends that both can have.
    """
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    n = len(x)
    x = x - x.mean(0)
    features = kernel_features(x, median_square_distance(x), 1e-4 / n)
    sums = np.zeros((n + 1, features.shape[1]))
    np.cumsum(features, axis=0, out=sums[1:])
    squares = (sums * sums).sum(1)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
    best[0] = 0.0
    starts, until = np.zeros(1, dtype=np.int64), np.full(1, n + 1)  # a start serves ends before ``until``
    ends = np.array([e for e in range(jump, n, jump) if e >= least] + [n])
    for i in range(0, len(ends), BLOCK):
        block = ends[i : i + BLOCK]
        starts, until = np.concatenate([starts, block]), np.concatenate([until, np.full(len(block), n + 1)])
        cross = sums[starts] @ sums[block].T
        for k, e in enumerate(block.tolist()):
            size = e - starts
            able = np.flatnonzero((until > e) & ((size >= least) | ((e == n) & (starts == 0))) & np.isfinite(best[starts]))
            if len(able):
                s = starts[able]
                cost = size[able] - (squares[e] + squares[s] - 2 * cross[able, k]) / size[able]
                value = best[s] + cost
                top = int(value.argmin())
                best[e], back[e] = value[top] + penalty, s[top]
                # with a cut at e every end that leaves a whole segment after it does at least as well
                beaten = able[value > best[e] + 1e-9]
                until[beaten] = np.minimum(until[beaten], e + least)
        kept = until > block[-1] + 1
        starts, until = starts[kept], until[kept]
    cuts, at = [], n
    while at > 0:
        cuts.append(at)
        at = int(back[at])
    return cuts[::-1]


def random_cuts(length: int, parts: int, least: int, rng: np.random.Generator) -> list[int]:
    """0, cuts and length with segments of at least ``least``: the slack is dealt out at random."""
    slack = length - parts * least
    if slack < 0:
        raise ValueError("too many parts for the length")
    extra = np.diff(np.concatenate([[0], np.sort(rng.integers(0, slack + 1, parts - 1)), [slack]]))
    return [0, *np.cumsum(extra + least).tolist()]


def random_sequence(symbols: int, length: int, rng: np.random.Generator) -> list[int]:
    """Symbols without immediate repeats, each used at least once."""
    if length < symbols:
        raise ValueError("sequence too short for its symbols")
    while True:
        out = [int(rng.integers(symbols))]
        while len(out) < length:
            out.append(int(rng.integers(symbols)))
            if symbols > 1 and out[-1] == out[-2]:
                out.pop()
        if len(set(out)) == symbols:
            return out


def equal_cuts(length: int, parts: int) -> list[int]:
    """0, cuts and length with segments of one size, the last one longer."""
    return [*(k * (length // parts) for k in range(parts)), length]
