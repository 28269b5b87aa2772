"""Numeric routines in plain numpy: tails, information, assignment, small clustering."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(10_000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * scale)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_sf(x: float, dof: float) -> float:
    return 1.0 if dof <= 0 else gamma_q(dof / 2, x / 2)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def contingency(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    i, j = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    out = np.zeros((i.max(initial=-1) + 1, j.max(initial=-1) + 1))
    np.add.at(out, (i, j), 1)
    return out


def entropy_of(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log(p)).sum())


def mutual_information(table: np.ndarray) -> float:
    n = table.sum()
    outer = np.outer(table.sum(1), table.sum(0))
    some = table > 0
    return max(0.0, float((table[some] / n * np.log(n * table[some] / outer[some])).sum()))


def expected_mutual_information(table: np.ndarray) -> float:
    """Expectation of the MI under the hypergeometric model with both margins fixed."""
    n = int(table.sum())
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    total = 0.0
    for a in table.sum(1).astype(int):
        for b in table.sum(0).astype(int):
            k = np.arange(max(1, a + b - n), min(a, b) + 1)
            if len(k):
                weight = logs[a] + logs[b] + logs[n - a] + logs[n - b] - logs[n] - logs[k] - logs[a - k] - logs[b - k] - logs[n - a - b + k]
                total += float((k / n * np.log(n * k / (a * b)) * np.exp(weight)).sum())
    return total


def information_scores(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """MI, AMI, EMI and conditional entropies; two one-cluster labelings score (1, 1, 0, 0, 1) by definition."""
    table = contingency(a, b)
    if table.shape == (1, 1):
        return {"mi": 1.0, "ami": 1.0, "emi": 0.0, "h1": 0.0, "h2": 1.0}
    mi, emi = mutual_information(table), expected_mutual_information(table)
    ha, hb = entropy_of(table.sum(1)), entropy_of(table.sum(0))
    spread = (ha + hb) / 2 - emi
    spread = math.copysign(max(abs(spread), np.finfo(float).eps), spread or 1.0)
    return {"mi": mi, "ami": (mi - emi) / spread, "emi": emi, "h1": ha - mi, "h2": hb - mi}


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of rows to columns with the greatest total gain (shortest augmenting paths)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        best, via, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j]:
            used[j] = True
            row = match[j]
            slack = np.concatenate([[np.inf], cost[row - 1] - u[row] - v[1:]])
            closer = ~used & (slack < best)
            best[closer], via[closer] = slack[closer], j
            following = int(np.where(used, np.inf, best).argmin())
            step = best[following]
            u[match[used]] += step
            v[used] -= step
            best[~used] -= step
            j = following
        while j:
            match[j], j = match[via[j]], via[j]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def relabel_to(target: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels renamed so that they overlap the target's most; names without a match stay beyond the target's."""
    names, inverse = np.unique(labels, return_inverse=True)
    wanted = np.unique(target)
    pairs = dict(assign(contingency(labels, target)))
    spare = iter(range(int(wanted.max()) + 1, int(wanted.max()) + 1 + len(names)))
    return np.array([wanted[pairs[k]] if k in pairs else next(spare) for k in range(len(names))])[inverse]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    names = np.unique(labels)
    if len(names) < 2 or len(names) >= len(x):
        return -1.0
    means = np.stack([d[:, labels == c].sum(1) for c in names], axis=1)
    sizes = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(len(x))
    a = means[rows, own] / np.maximum(1, sizes[own] - 1)
    other = means / sizes
    other[rows, own] = np.inf
    b = other.min(1)
    return float(np.where(sizes[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())


def kmeans(x: np.ndarray, k: int, seed: int = 0, tries: int = 10) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several seeded starts."""
    rng, best = np.random.default_rng(seed), (np.zeros(len(x), dtype=int), np.inf)
    for _ in range(tries):
        centre = x[[rng.integers(len(x))]]
        for _ in range(k - 1):  # spread starts
            d = ((x[:, None] - centre[None]) ** 2).sum(-1).min(1)
            centre = np.vstack([centre, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(100):
            labels = ((x[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            moved = np.stack([x[labels == c].mean(0) if (labels == c).any() else centre[c] for c in range(k)])
            if np.allclose(moved, centre):
                break
            centre = moved
        inertia = float(((x - centre[labels]) ** 2).sum())
        if inertia < best[1]:
            best = (labels, inertia)
    return best


def cluster_weights(weights: np.ndarray, seed: int = 0) -> np.ndarray:
    """One-dimensional k-means with k chosen by silhouette over 2..n-1 (one cluster for equal weights)."""
    x = np.asarray(weights, dtype=float).reshape(-1, 1)
    if len(x) < 3 or np.ptp(x) < 1e-12:
        return np.zeros(len(x), dtype=int) if np.ptp(x) < 1e-12 else np.arange(len(x))
    options = [kmeans(x, k, seed)[0] for k in range(2, len(x))]
    return max(options, key=lambda labels: silhouette(x, labels))


def insignificant(gain: float, alpha: float = 0.05) -> bool:
    """No-hypercompression: a gain of g bits happens by chance with probability 2^-g at most."""
    return gain < 0 or (gain <= 100 and 2.0**-gain > alpha)


def components(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """Label of each of n items, in order of each component's first item."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    names: dict[int, int] = {}
    return [names.setdefault(root(i), len(names)) for i in range(n)]


def entropy_of_probabilities(p: np.ndarray, base: float = math.e) -> float:
    """Entropy of probabilities; zeros count nothing."""
    p = np.asarray(p, dtype=float)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum() / math.log(base))


def ami_or_nmi(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted mutual information, or the normalised one where its expectation cannot be formed."""
    try:
        return information_scores(a, b)["ami"]
    except (ValueError, ZeroDivisionError, FloatingPointError):
        t = contingency(a, b)
        h = math.sqrt(entropy_of(t.sum(1)) * entropy_of(t.sum(0)))
        return mutual_information(t) / h if h else 1.0


def cluster_points(x: np.ndarray, k_max: int = 10, seed: int = 0) -> np.ndarray:
    """k-means with k chosen by silhouette over 2..k_max; one cluster for fewer than three different points."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    different = len(np.unique(x, axis=0))
    if different < 3:
        return np.unique(x, axis=0, return_inverse=True)[1].ravel()
    options = [kmeans(x, k, seed)[0] for k in range(2, min(k_max, different - 1) + 1)]
    return max(options, key=lambda labels: silhouette(x, labels))
