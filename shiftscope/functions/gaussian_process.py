"""Gaussian process regressions with description lengths, by exact kernels or by feature maps (numpy, one group of rows).

Exact kernels cost the cube of the rows.  Feature maps turn the process into a
ridge regression whose state is the cross products of features and target, so
states of blocks of rows add up: ``FeatureProcess.of_gram`` takes such a sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

import numpy as np

from shiftscope.functions.independence import squared_distances

#: fixed values: added to the kernel's diagonal, the noise of the likelihood, and the range of length scales
RIDGE, ALPHA, SCALES = 0.1, 1.5, (1e-2, 1e2)


def _logdet(m: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(m)
    return float(value) if sign > 0 and math.isfinite(value) else 0.0


class KernelProcess:
    """An RBF process; the length scale is the likeliest of a log-spaced grid, refined around the best."""

    def __init__(self, alpha: float = ALPHA, scales: tuple[float, float] = SCALES, steps: int = 25):
        self.alpha, self.scales, self.steps = alpha, scales, steps

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-squared_distances(a, b) / (2 * self.scale**2))

    def _evidence(self, scale: float) -> float:
        k = np.exp(-self._d2 / (2 * scale**2)) + self.alpha * np.eye(len(self.y))
        low = np.linalg.cholesky(k)
        a = np.linalg.solve(low, self._yn)
        return float(0.5 * a @ a + np.log(np.diag(low)).sum() + 0.5 * len(a) * math.log(2 * math.pi))

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelProcess:
        """Sets ``likelihood``, ``model``, ``penalty`` and ``bits`` (their sum), in nats."""
        self.x, self.y = np.asarray(x, dtype=float).reshape(len(y), -1), np.asarray(y, dtype=float).ravel()
        self.mean, self.spread = float(self.y.mean()), float(self.y.std()) or 1.0
        self._yn = (self.y - self.mean) / self.spread
        self._d2 = squared_distances(self.x)
        grid = np.geomspace(*self.scales, self.steps)
        best = min(grid, key=self._evidence)
        step = grid[1] / grid[0]
        self.scale = float(min(np.clip(best * step ** np.linspace(-1, 1, 9), *self.scales), key=self._evidence))
        self.likelihood = self._evidence(self.scale)
        k = self.kernel(self.x, self.x) + RIDGE * np.eye(len(self.y))
        whole = np.eye(len(k)) + k
        self.weights = np.linalg.solve(whole, self._yn)
        self.model = float(self.weights @ whole @ self.weights)
        self.penalty = 0.5 * _logdet(whole)
        self.low = np.linalg.cholesky(k)
        self.bits = self.likelihood + self.model + self.penalty
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance at other rows."""
        x = np.asarray(x, dtype=float).reshape(len(x), -1)
        cross = self.kernel(x, self.x)
        v = np.linalg.solve(self.low, cross.T)
        return self.spread * (cross @ self.weights) + self.mean, (self.kernel(x, x) - v.T @ v) * self.spread**2

    def test_bits(self, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Description length of other rows under this model, and its part for the residuals (unit variance), in nats."""
        residual = np.asarray(y, dtype=float).ravel() - self.predict(x)[0]
        loss = float((0.5 * math.log(2 * math.pi) + residual**2 / 2).sum())
        return abs(loss) + self.model + self.penalty, loss


# --- feature maps -----------------------------------------------------------


def spectral_density(kernel: str, gamma: float, nu: int = 2) -> Callable[[np.ndarray], np.ndarray]:
    """Density of a kernel's frequencies on a line, up to the quadrature's constant."""
    if kernel == "squared_exponential":
        return lambda w: np.exp(-(w**2) * gamma**2 / 2) * gamma / math.sqrt(2 * math.pi) * math.pi / 2
    if kernel == "laplace":
        return lambda w: gamma / 2 / ((gamma * w) ** 2 + 1)
    if kernel == "modified_matern":
        factor = {2: 1.0, 3: 4 / 3, 4: 8 / 5}[nu]
        return lambda w: gamma * factor / ((gamma * w) ** 2 + 1) ** nu
    raise ValueError(f"unknown kernel {kernel}")


def nodes_and_weights(kind: str, q: int, gamma: float = 1.0, scale: float = 1.0, kernel: str = "squared_exponential", nu: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and weights on a line.

    legendre and periodic: angles in (0, pi) mapped by cotangent, with the
    density and its Jacobian in the weights; hermite: the positive half of a
    rule twice as long; matern: a whole rule; lattice: multiples of one
    frequency with equal weights.
    """
    if kind == "hermite":
        if kernel != "squared_exponential":
            raise ValueError("the Hermite rule belongs to the squared exponential kernel")
        nodes, weights = np.polynomial.hermite.hermgauss(2 * q)
        return math.sqrt(2) * nodes[q:] / gamma, 2 * weights[q:] / math.sqrt(math.pi)
    if kind == "matern":
        if kernel not in ("modified_matern", "laplace"):
            raise ValueError("the Matern rule belongs to the Matern and Laplace kernels")
        nodes, weights = np.polynomial.hermite.hermgauss(q)
        return math.sqrt(2) * nodes / gamma, weights / math.sqrt(math.pi)
    if kind == "lattice":
        return math.sqrt(2) * np.arange(1, q + 1) / gamma, np.full(q, 1 / (2 * q))
    if kind == "periodic":
        angle, weights = np.arange(1, q + 1) * math.pi / (q + 1), np.full(q, scale * 2 / (q + 1))
    elif kind == "legendre":
        nodes, weights = np.polynomial.legendre.leggauss(2 * q)
        angle, weights = math.pi * (nodes[q:] + 1) / 2, 2 * weights[q:]
    else:
        raise ValueError(f"unknown rule {kind}")
    frequency = scale / np.tan(angle)
    return frequency, scale * weights / np.sin(angle) ** 2 * spectral_density(kernel, gamma, nu)(frequency)


class QuadratureFeatures:
    """Cosines and sines at the tensor grid of a rule: ``features`` of them, about, in ``columns`` dimensions."""

    def __init__(self, kind: str, columns: int, features: int = 100, **options):
        q = max(1, int(round((features // 2) ** (1 / columns), 9)))
        nodes, weights = nodes_and_weights(kind, q, **options)
        order = np.argsort(np.abs(nodes), kind="stable")  # plain functions first
        nodes, weights = nodes[order], weights[order]
        self.frequencies = np.array(list(product(nodes, repeat=columns))).T
        self.weights = np.sqrt(np.array([math.prod(w) for w in product(weights, repeat=columns)]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.asarray(x, dtype=float).reshape(len(x), -1) @ self.frequencies
        return np.hstack([np.cos(z) * self.weights, np.sin(z) * self.weights])


class KarhunenLoeveFeatures:
    """The leading eigenfunctions of the kernel exp(-d^2 / 2 length^2) for Gaussian inputs, times the roots of their eigenvalues.

    On a line these are Hermite functions whose eigenvalues fall geometrically, so few of them
    give the kernel where inputs of standard deviation ``spread`` lie; in several dimensions
    the products of largest eigenvalue are taken.
    """

    def __init__(self, columns: int, features: int = 16, length: float = 1.0, spread: float = 1.0):
        a, b = 1 / (4 * spread**2), 1 / (2 * length**2)
        self.a, self.c = a, math.sqrt(a * a + 2 * a * b)
        whole = a + b + self.c
        # a product's eigenvalue falls with the sum of its orders alone
        orders: list[tuple[int, ...]] = []
        total = 0
        while len(orders) < features:
            orders += sorted(o for o in product(range(total + 1), repeat=columns) if sum(o) == total)
            total += 1
        self.orders = np.array(orders[:features])
        self.roots = np.sqrt((2 * a / whole) ** (columns / 2) * (b / whole) ** self.orders.sum(1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float).reshape(len(x), -1)
        u, top = math.sqrt(2 * self.c) * x, int(self.orders.max())
        on_line = [(self.c / self.a) ** 0.25 * np.exp(-(self.c - self.a) * x * x)]
        for k in range(top):
            on_line.append(math.sqrt(2 / (k + 1)) * u * on_line[k] - (math.sqrt(k / (k + 1)) * on_line[k - 1] if k else 0))
        out = np.tile(self.roots, (len(x), 1))
        for j in range(x.shape[1]):
            out *= np.stack([on_line[k][:, j] for k in self.orders[:, j]], axis=1)
        return out


class RandomFeatures:
    """Seeded cosines of random frequencies for the kernel exp(-gamma d^2)."""

    def __init__(self, columns: int, features: int = 200, gamma: float = 1.0, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.frequencies = math.sqrt(2 * gamma) * rng.normal(size=(columns, features))
        self.offsets = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / len(self.offsets)) * np.cos(np.asarray(x, dtype=float).reshape(len(x), -1) @ self.frequencies + self.offsets)


class AdditiveFeatures:
    """A feature map of its own for each column, side by side."""

    def __init__(self, maps: list[Callable], scaling: list[float] | None = None):
        self.maps, self.scaling = maps, scaling or [1.0] * len(maps)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float).reshape(len(x), -1)
        return np.hstack([s * m(x[:, [i]]) for i, (m, s) in enumerate(zip(self.maps, self.scaling, strict=True))])


class FeatureProcess:
    """A process given by a feature map: weights, and description length in nats as that of the exact kernel."""

    def __init__(self, features: Callable):
        self.features = features

    def gram(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cross products of the features and the target (last), which add up over blocks of rows."""
        block = np.hstack([self.features(x), np.asarray(y, dtype=float).reshape(-1, 1)])
        return block.T @ block

    def fit(self, x: np.ndarray, y: np.ndarray) -> FeatureProcess:
        return self.of_gram(self.gram(x, y), len(y))

    def of_gram(self, g: np.ndarray, rows: int) -> FeatureProcess:
        k, b, yy = g[:-1, :-1], g[:-1, -1], float(g[-1, -1])
        ridged = k + RIDGE * np.eye(len(k))
        whole = np.eye(len(k)) + ridged
        self.weights = np.linalg.solve(whole, b)
        self.model = float(self.weights @ whole @ self.weights)
        # determinant and inverse of the rows' covariance by those of the features'
        small = np.eye(len(k)) + k
        self.penalty = 0.5 * _logdet(small)
        self.likelihood = 0.5 * (yy - b @ np.linalg.solve(small, b)) + self.penalty + rows / 2 * math.log(2 * math.pi)
        self.bits = self.likelihood + self.model + self.penalty
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def test_bits(self, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        residual = np.asarray(y, dtype=float).ravel() - self.predict(x)
        loss = float((0.5 * math.log(2 * math.pi) + residual**2 / 2).sum())
        return abs(loss) + self.model + self.penalty, loss


def cross_likelihood_same(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, alpha: float = 0.05) -> bool:
    """Whether two mechanisms are one: on either side the other's model codes the rows without a significant loss."""
    from shiftscope.functions.numerics import insignificant

    a, b = KernelProcess().fit(x1, y1), KernelProcess().fit(x2, y2)
    loss = lambda model, x, y: model.test_bits(x, y)[1] / math.log(2)
    return insignificant(abs(loss(a, x1, y1) - loss(b, x1, y1)), alpha) or insignificant(abs(loss(b, x2, y2) - loss(a, x2, y2)), alpha)
