"""Optimal partitioning against an unpruned dynamic program, and on long series."""

import time

import numpy as np
import pytest

from shiftscope.functions import changepoints as C


def brute(x, least, penalty, jump=1):
    """Best total cost over all segmentations, from the full kernel matrix."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    n = len(x)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    pairs = d2[np.triu_indices(n, 1)]
    k = np.exp(-d2 / (np.median(pairs[pairs > 0]) if (pairs > 0).any() else 1.0))
    cost = lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)
    best = {0: 0.0}
    ends = [e for e in range(jump, n, jump) if e >= least] + [n]
    for e in ends:
        options = [best[s] + cost(s, e) + penalty for s in best if s < e and (e - s >= least or (e == n and s == 0))]
        if options:
            best[e] = min(options)
    return best[n], lambda cuts: sum(cost(a, b) + penalty for a, b in zip([0, *cuts[:-1]], cuts, strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_equals_the_unpruned_search(seed):
    rng = np.random.default_rng(seed)
    n, width, least, jump = int(rng.integers(20, 160)), int(rng.integers(1, 4)), int(rng.integers(1, 12)), int(rng.integers(1, 3))
    levels = np.repeat(rng.normal(0, 3, (8, width)), 20, axis=0)[:n]
    x = levels + rng.normal(0, 1, (n, width)) if seed % 3 else np.round(levels)
    for penalty in (0.1, 0.5, 3.0):
        want, total = brute(x, least, penalty, jump)
        cuts = C.pelt(x, least, penalty, jump)
        assert cuts[-1] == n and total(cuts) == pytest.approx(want, abs=1e-4)
        assert all(b - a >= least for a, b in zip([0, *cuts[:-1]], cuts, strict=True)) or len(cuts) == 1


@pytest.mark.parametrize("width", [1, 3])
def test_median_distance(width):
    rng = np.random.default_rng(width)
    for x in (rng.normal(size=(501, width)), rng.integers(0, 3, (300, width)).astype(float), 1e6 + rng.normal(size=(400, width)), np.ones((5, width)), np.ones((1, width))):
        x = x - x.mean(0)
        d2 = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(len(x), 1)]
        d2 = d2[d2 > 1e-12]
        assert C.median_square_distance(x) == pytest.approx(np.median(d2) if len(d2) else 1.0, rel=1e-6)


def test_features_give_the_kernel():
    x = np.random.default_rng(0).normal(size=(300, 2))
    f = C.kernel_features(x, 1.7, 1e-9)
    assert np.abs(f @ f.T - np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 1.7)).max() < 1e-8 and f.shape[1] < 150


@pytest.mark.parametrize("n", [3_000, 30_000])
def test_a_short_regime_in_a_long_series(n):
    x = np.random.default_rng(1).normal(size=n)
    x[n // 2 : n // 2 + 8] += 30
    began = time.time()
    assert {n // 2, n // 2 + 8} <= set(C.pelt(x, 5))
    assert time.time() - began < 90


def test_edges():
    assert C.pelt(np.zeros(1), 1) == [1] and C.pelt(np.zeros(40), 5) == [40] and C.pelt(np.arange(3.0), 10) == [3]
