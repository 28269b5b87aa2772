"""Information measures of continuous, mixed and soft labels on one group of rows (numpy)."""

from __future__ import annotations

import math

import numpy as np

from shiftscope.functions.independence import knn_cmi, rbf, thin
from shiftscope.functions.numerics import contingency, digamma, entropy_of, mutual_information


def knn_entropy(x: np.ndarray, k: int = 3, base: float = math.e, norm: str = "max") -> float:
    """Nearest-neighbour entropy with the maximum or Euclidean norm."""
    (x,) = thin(np.asarray(x, dtype=float).reshape(len(x), -1))
    n, d = x.shape
    gap = np.abs(x[:, None] - x[None])
    dist = gap.max(-1) if norm == "max" else np.sqrt((gap**2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    radius = np.maximum(1e-12, np.sort(dist, axis=1)[:, min(k, n - 1) - 1])
    ball = d * math.log(2) if norm == "max" else d / 2 * math.log(math.pi) - math.lgamma(d / 2 + 1)
    psi = digamma(np.array([n, k], dtype=float))
    return float((psi[0] - psi[1] + ball + d * np.log(radius).mean()) / math.log(base))


def knn_mutual_information(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, k: int = 3, base: float = math.e) -> float:
    return knn_cmi(x, y, z, k) / math.log(base)


def mixed_mutual_information(x: np.ndarray, labels: np.ndarray, k: int = 3, base: float = math.e) -> float:
    """Continuous x against discrete labels: H(x) less the labels' mean H(x | label); labels with too few rows count as no information."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    whole, inner = knn_entropy(x, k, base), 0.0
    for name in np.unique(labels):
        own = x[labels == name]
        inner += len(own) / len(x) * (knn_entropy(own, k, base) if len(own) > k + 1 else whole)
    return abs(whole - inner)


def sliced_mutual_information(x: np.ndarray, y: np.ndarray, slices: int = 50, k: int = 3, seed: int = 0) -> float:
    """Mean MI of random one-dimensional projections."""
    rng = np.random.default_rng(seed)
    x, y = (np.asarray(v, dtype=float).reshape(len(v), -1) for v in (x, y))
    total = 0.0
    for _ in range(slices):
        a, b = rng.normal(size=x.shape[1]), rng.normal(size=y.shape[1])
        total += knn_cmi(x @ (a / np.linalg.norm(a)), y @ (b / np.linalg.norm(b)), None, k)
    return total / slices


def kl_divergence(x: np.ndarray, y: np.ndarray, k: int = 1) -> float:
    """Nearest-neighbour estimate of the divergence of x's distribution from y's."""
    x, y = (np.asarray(v, dtype=float).reshape(len(v), -1) for v in (x, y))
    (x,), (y,) = thin(x), thin(y)
    inside = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(inside, np.inf)
    near, far = np.sort(inside, 1)[:, k - 1], np.sort(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), 1)[:, k - 1]
    return float(x.shape[1] * np.log(np.maximum(far, 1e-12) / np.maximum(near, 1e-12)).mean() + math.log(len(y) / max(1, len(x) - 1)))


def soft_mutual_information(p: np.ndarray, q: np.ndarray, eps: float = 1e-12) -> float:
    """MI of two matrices of posteriors through their mean outer product; two one-column ones score 1."""
    if p.shape[1] == q.shape[1] == 1:
        return 1.0
    joint = p.T @ q / len(p)
    outer = np.outer(joint.sum(1), joint.sum(0))
    return float((joint * np.log((joint + eps) / (outer + eps))).sum())


def posterior_entropy(p: np.ndarray, eps: float = 1e-12) -> float:
    return float(-(p * np.log(p + eps)).sum(1).mean())


def confidence(p: np.ndarray) -> float:
    return float(p.max(1).mean())


def noisy_labels(labels: np.ndarray, classes: int, sure: float) -> np.ndarray:
    """One-hot labels mixed with the uniform distribution."""
    return sure * np.eye(classes)[labels] + (1 - sure) / classes


def expected_soft_mutual_information(p: np.ndarray, q: np.ndarray, trials: int = 30, seed: int = 0) -> tuple[float, float]:
    """Mean and deviation of the soft MI of random labels as sure as the posteriors."""
    rng, n = np.random.default_rng(seed), len(p)
    draw = lambda m: noisy_labels(rng.integers(0, m.shape[1], n), m.shape[1], confidence(m))
    values = [soft_mutual_information(draw(p), draw(q)) for _ in range(trials)]
    return float(np.mean(values)), float(np.std(values))


def adjusted_soft_mutual_information(p: np.ndarray, q: np.ndarray, trials: int = 50, seed: int = 0) -> float:
    expected = expected_soft_mutual_information(p, q, trials, seed)[0]
    spread = max(posterior_entropy(p.mean(0, keepdims=True)), posterior_entropy(q.mean(0, keepdims=True))) - expected
    return (soft_mutual_information(p, q) - expected) / spread if spread > 0 else 0.0


def expected_mi_by_sampling(a: np.ndarray, b: np.ndarray, draws: int = 30, seed: int = 0) -> float:
    """Mean MI of uniform random labels with as many names."""
    rng = np.random.default_rng(seed)
    ka, kb = len(np.unique(a)), len(np.unique(b))
    return float(np.mean([mutual_information(contingency(rng.integers(0, ka, len(a)), rng.integers(0, kb, len(b)))) for _ in range(draws)]))


def total_correlation(*labels: np.ndarray) -> float:
    """Sum of the entropies less the joint entropy, in nats."""
    joint = np.unique(np.stack(labels, axis=1), axis=0, return_counts=True)[1]
    return sum(entropy_of(np.unique(x, return_counts=True)[1]) for x in labels) - entropy_of(joint)


def von_neumann_divergence(a: np.ndarray, b: np.ndarray) -> float:
    """tr(a log a - a log b - a + b) of positive semidefinite matrices."""

    def log(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh((m + m.T) / 2)
        return (v * np.log(np.maximum(w, 1e-12))) @ v.T

    return float(np.trace(a @ log(a) - a @ log(b) - a + b))


def correntropy(x: np.ndarray, width: float | None = None) -> np.ndarray:
    """Mean Gaussian kernel of the differences of each two columns."""
    x = np.asarray(x, dtype=float)
    width = width or max(1e-12, float(np.median(np.abs(x[:, :, None] - x[:, None, :]))) or 1.0)
    return np.exp(-((x[:, :, None] - x[:, None, :]) ** 2) / (2 * width * width)).mean(0)


def conditional_divergence(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> float:
    """Symmetric von Neumann divergence of the two groups' correntropy of (x, y), less that of x alone."""
    x, y = (np.asarray(v, dtype=float).reshape(len(v), -1) for v in (x, y))
    both = np.hstack([x, y])
    one = group > 0.5

    def part(m: np.ndarray) -> float:
        a, b = correntropy(m[one]), correntropy(m[~one])
        return von_neumann_divergence(a, b) + von_neumann_divergence(b, a)

    return 0.5 * (part(both) - (part(x) if x.shape[1] > 1 else 0.0))


def kernel_alignment(x: np.ndarray, y: np.ndarray) -> float:
    """Centred kernel alignment, 0 for independent columns of many rows."""
    x, y = thin(np.asarray(x, dtype=float).reshape(len(x), -1), np.asarray(y, dtype=float).reshape(len(y), -1))
    a, b = (k - k.mean(0) - k.mean(1)[:, None] + k.mean() for k in (rbf(x), rbf(y)))
    return float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))


def expected_ami_by_sampling(a: np.ndarray, b: np.ndarray, draws: int = 30, seed: int = 0) -> float:
    """MI adjusted by the sampled expectation: 0 for labels that agree as chance does, 1 for equal ones."""
    expected = expected_mi_by_sampling(a, b, draws, seed)
    spread = (entropy_of(np.unique(a, return_counts=True)[1]) + entropy_of(np.unique(b, return_counts=True)[1])) / 2 - expected
    return (mutual_information(contingency(a, b)) - expected) / spread if spread > 0 else 0.0


def residual_mutual_information(x: np.ndarray, y: np.ndarray, given_x: np.ndarray, given_y: np.ndarray, k: int = 3) -> float:
    """MI of what kernel processes leave of x given some columns and of y given others."""
    from shiftscope.functions.gaussian_process import KernelProcess

    left = [v if not g.size else v - KernelProcess().fit(g, v).predict(g)[0] for v, g in ((np.ravel(x), np.asarray(given_x)), (np.ravel(y), np.asarray(given_y)))]
    return knn_cmi(left[0][:, None], left[1][:, None], None, k)


def optimised_sliced_mi(x: np.ndarray, y: np.ndarray, slices: int = 20, steps: int = 30, k: int = 3, seed: int = 0, spread: float = 0.3) -> float:
    """Mean MI over directions that are improved by seeded local steps, kept apart by a minimal angle."""
    rng = np.random.default_rng(seed)
    x, y = (np.asarray(v, dtype=float).reshape(len(v), -1) for v in (x, y))
    unit = lambda v: v / np.linalg.norm(v)
    chosen: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(slices):
        a, b = unit(rng.normal(size=x.shape[1])), unit(rng.normal(size=y.shape[1]))
        value = knn_cmi(x @ a, y @ b, None, k)
        for _ in range(steps):
            c, d = unit(a + 0.3 * rng.normal(size=len(a))), unit(b + 0.3 * rng.normal(size=len(b)))
            if len(a) > 1 and any(abs(c @ u) > np.cos(spread) for u, _, _ in chosen):
                continue
            if (new := knn_cmi(x @ c, y @ d, None, k)) > value:
                a, b, value = c, d, new
        chosen.append((a, b, value))
        if x.shape[1] == y.shape[1] == 1:
            break
    return float(np.mean([v for _, _, v in chosen]))
