"""Clusters of columns that share a linear latent cause, by generalised independent noise (numpy, one group of rows)."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

from shiftscope.functions.independence import kci
from shiftscope.functions.numerics import chi2_sf


def noise_of(x: np.ndarray, inner: list[int], outer: list[int]) -> np.ndarray:
    """The combination of the inner columns that is uncorrelated with all outer ones, as nearly as can be."""
    x = x - x.mean(0)
    _, _, right = np.linalg.svd((x[:, outer].T @ x[:, inner]) / len(x))
    return x[:, inner] @ right[-1]


def independent_noise(x: np.ndarray, inner: list[int], outer: list[int], alpha: float = 0.05) -> tuple[bool, float]:
    """Whether that combination is independent of every outer column; the p values are joined by Fisher's method."""
    e = noise_of(x, inner, outer)
    p = [max(1e-12, kci(e[:, None], x[:, [v]])[1]) for v in outer]
    joined = chi2_sf(-2 * sum(map(math.log, p)), 2 * len(p))
    return joined > alpha, joined


def latent_clusters(x: np.ndarray, alpha: float = 0.05, most: int = 3) -> list[list[int]]:
    """Disjoint clusters: sets of growing size whose noise is independent of the rest, joined where they overlap."""
    left, out = list(range(x.shape[1])), []
    for size in range(2, most + 1):
        found = [set(c) for c in combinations(left, size) if len(left) > size and independent_noise(x, list(c), [v for v in range(x.shape[1]) if v not in c], alpha)[0]]
        merged: list[set[int]] = []
        for c in found:
            touching = [m for m in merged if m & c]
            merged = [m for m in merged if not m & c] + [c.union(*touching)]
        out += [sorted(m) for m in merged]
        left = [v for v in left if not any(v in m for m in merged)]
    return sorted(out)


def latent_order(x: np.ndarray, clusters: list[list[int]], alpha: float = 0.05) -> list[int]:
    """Clusters with causes first: the next root is the one whose first column, set against the others' first, leaves noise most independent of its second."""
    left, out = list(range(len(clusters))), []
    while len(left) > 1:
        def evidence(k: int) -> float:
            return min(independent_noise(x, [clusters[k][0], clusters[m][0]], [clusters[k][1 % len(clusters[k])]], alpha)[1] for m in left if m != k)

        root = max(left, key=evidence)
        out.append(root)
        left.remove(root)
    return out + left
