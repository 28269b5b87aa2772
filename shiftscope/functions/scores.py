"""Description lengths, in bits, of a target given its parents, on one group of rows.

``gp_bits`` is the exact kernel score and costs the cube of the rows, so it
takes at most ``MOST`` seeded rows and scales the bits up; ``gram_bits`` needs
only the cross products of basis functions, which add up over any split of the
rows, and is what the distributed searches use.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

LN2 = math.log(2)
MOST = 400
#: fixed values of the search: starts (log length scale, log signal, log noise) and the least noise
STARTS = ((0.0, 0.0, -2.0), (1.0, 0.0, -1.0), (-1.0, 0.0, 0.0), (0.0, -2.0, 0.0), (0.0, 2.0, 2.0))
LEAST_NOISE = 1e-6


def null_bits(y: np.ndarray) -> float:
    """Bits under a Gaussian with fitted mean and variance."""
    return null_bits_of(len(y), float(np.var(y)))


def null_bits_of(n: int, var: float) -> float:
    return n / 2 * math.log2(2 * math.pi * math.e * max(1e-12, var)) + math.log2(max(2, n))


def gp_bits(x: np.ndarray, y: np.ndarray, restarts: int = 10, seed: int = 0, most: int = MOST) -> float:
    """Negative log marginal likelihood of a Gaussian process with an RBF kernel plus 1.5 ln n, in bits.

    Length scale, signal and noise are searched on the log scale: seeded starts
    in [-5, 5]^3, five fixed ones, then a 27-point refinement around the best.
    The target is standardised for the search, and its scale is added again, so
    that bits with and without parents compare.
    """
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    n = len(y)
    if x.shape[1] == 0:
        return null_bits(y)
    if n > most:
        keep = np.sort(np.random.default_rng(seed).choice(n, most, replace=False))
        return gp_bits(x[keep], y[keep], restarts, seed, most) * n / most
    return gp_bits_repeated(x, np.ones(n), y, np.zeros(n), restarts, seed)


def gp_bits_repeated(x: np.ndarray, count: np.ndarray, mean: np.ndarray, within: np.ndarray, restarts: int = 10, seed: int = 0) -> float:
    """``gp_bits`` of all rows from their count, mean target and squared deviations within each distinct input.

    Exact, since rows of equal input share the process' value: the cost is the cube of the distinct inputs.
    """
    n, m = float(count.sum()), len(count)
    x = np.asarray(x, dtype=float).reshape(m, -1)
    middle = count @ x / n
    x = (x - middle) / (np.sqrt(count @ (x - middle) ** 2 / n) + 1e-12)
    middle = count @ mean / n
    spread = math.sqrt((count @ (mean - middle) ** 2 + within.sum()) / n) + 1e-12
    y, inner = (mean - middle) / spread, float(within.sum()) / spread**2
    d2 = np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T)

    def nll(theta: np.ndarray) -> float:
        scale, signal, noise = np.exp(np.maximum(theta, (-np.inf, -np.inf, math.log(LEAST_NOISE))))
        k = signal * np.exp(-0.5 * d2 / scale**2)
        jitter = 1e-6
        for _ in range(6):
            try:
                low = np.linalg.cholesky(k + np.diag((noise + jitter) / count))
            except np.linalg.LinAlgError:
                jitter *= 10
                continue
            a = np.linalg.solve(low, y)
            same = 0.5 * inner / (noise + jitter) + 0.5 * (n - m) * math.log(2 * math.pi * (noise + jitter)) + 0.5 * np.log(count).sum()
            return float(0.5 * a @ a + np.log(np.diag(low)).sum() + 0.5 * m * math.log(2 * math.pi) + same)
        return math.inf

    rng = np.random.default_rng(seed)
    starts = [*rng.uniform(-5, 5, (restarts, 3)), *(np.array(t) for t in STARTS)]
    best = min(starts, key=nll)
    grid = [best + 0.75 * np.array([a, b, c]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    value = min(map(nll, grid))
    if not math.isfinite(value):
        return null_bits_of(int(n), spread**2)
    return (value + 1.5 * math.log(n)) / LN2 + n * math.log2(spread)


# --- mergeable scores --------------------------------------------------------


#: length scales (of standardised columns) that a process score searches, and features of each a column
LENGTHS, PROCESS_FEATURES = (0.4, 0.8, 1.6, 3.2), 14


def process_bits(g: np.ndarray) -> float:
    """``gp_bits`` from cross products: one, the features of each length scale side by side, and the target.

    Signal and noise are searched for each length scale on the sums, whatever the rows:
    a grid on the log scale and two refinements of it, all from one eigen-decomposition.
    """
    n = float(g[0, 0])
    mean = g[0, -1] / n
    spread = math.sqrt(max(0.0, g[-1, -1] / n - mean**2)) + 1e-12
    if len(g) == 2:
        return null_bits_of(int(n), spread**2)
    width, best = (len(g) - 2) // len(LENGTHS), math.inf
    for k in range(len(LENGTHS)):
        own = slice(1 + k * width, 1 + (k + 1) * width)
        values, vectors = np.linalg.eigh(g[own, own])
        values = np.maximum(0, values)
        inner = (vectors.T @ ((g[own, -1] - mean * g[0, own]) / spread)) ** 2
        centre, step = np.array([0.0, -1.0]), 2.0  # log signal, log noise
        for size in (4, 2, 2):
            axis = np.arange(-size, size + 1) * step
            signal, noise = (np.exp(np.maximum(c + axis, math.log(LEAST_NOISE) if i else -60)) for i, c in enumerate(centre))
            shrink = signal[:, None, None] / (noise[None, :, None] + signal[:, None, None] * values)
            fit = (n - (inner * shrink).sum(-1)) / noise
            loss = 0.5 * (fit + n * np.log(noise) + np.log1p(signal[:, None, None] * values / noise[None, :, None]).sum(-1) + n * math.log(2 * math.pi))
            i, j = np.unravel_index(int(loss.argmin()), loss.shape)
            centre, step = np.array([math.log(signal[i]), math.log(noise[j])]), step / 2.5
            best = min(best, float(loss[i, j]))
    return (best + 1.5 * math.log(n)) / LN2 + n * math.log2(spread)


class Basis:
    """Functions of the parents whose cross products with the target are enough for the score.

    kind: ``lin`` (1, x), ``cub`` (1, x, x^2, x^3), ``spline`` (truncated cubic
    powers at fixed knots of standardised columns), ``rff`` (seeded random
    Fourier features) or ``gp`` (eigenfunctions of Gaussian kernels of several
    length scales, for the evidence of a Gaussian process).  ``centre`` and
    ``scale`` standardise the columns; they come from one aggregate over the whole table.
    """

    def __init__(self, kind: str, centre: np.ndarray, scale: np.ndarray, features: int = 40, seed: int = 0):
        self.kind, self.centre, self.scale, self.features, self.seed = kind, centre, np.where(scale < 1e-12, 1, scale), features, seed

    @property
    def additive(self) -> bool:
        """Whether the functions of several parents are those of each, so that one matrix of all columns holds every candidate's."""
        return self.kind in ("lin", "cub", "spline")

    def bits(self, g: np.ndarray) -> float:
        """Bits of the mechanism that a matrix of cross products of these functions describes."""
        return process_bits(g) if self.kind == "gp" else gram_bits(g)

    def of_column(self, x: np.ndarray, column: int) -> np.ndarray:
        """Functions of one column (additive kinds)."""
        return self(x, (column,))[:, 1:]

    def __call__(self, x: np.ndarray, parents: tuple[int, ...]) -> np.ndarray:
        n = len(x)
        z = (x[:, list(parents)] - self.centre[list(parents)]) / self.scale[list(parents)]
        out = [np.ones((n, 1))]
        if not parents:
            return out[0]
        if self.kind == "lin":
            out += [z]
        elif self.kind == "cub":
            out += [z, z**2, z**3]
        elif self.kind == "spline":
            knots = np.linspace(-1.5, 1.5, 5)
            out += [z, z**2, z**3, *(np.maximum(0, z - k) ** 3 for k in knots)]
        elif self.kind == "rff":
            rng = np.random.default_rng((self.seed, len(parents)))
            w = rng.normal(size=(len(parents), self.features)) * rng.choice([0.5, 1.0, 2.0], self.features)
            out += [z, np.cos(z @ w + rng.uniform(0, 2 * math.pi, self.features))]
        elif self.kind == "gp":
            from shiftscope.functions.gaussian_process import KarhunenLoeveFeatures

            out += [KarhunenLoeveFeatures(len(parents), PROCESS_FEATURES * min(3, len(parents)), length)(z) for length in LENGTHS]
        else:
            raise ValueError(f"unknown basis {self.kind}")
        return np.hstack(out)


def gram(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross products of the features and the target (last)."""
    block = np.hstack([features, y[:, None]])
    return block.T @ block


def gram_bits(g: np.ndarray, ridge: float = 1e-3) -> float:
    """Bits of the ridge regression that a Gram matrix describes: n/2 log2(2 pi e var) + k/2 log2 n."""
    n = g[0, 0]
    a, b, c = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    a = a + ridge * n * np.diag([0.0, *np.ones(len(a) - 1)])
    w = np.linalg.lstsq(a, b, rcond=1e-10)[0]
    rss = max(1e-12 * n, float(c - 2 * w @ b + w @ g[:-1, :-1] @ w))
    return n / 2 * math.log2(2 * math.pi * math.e * rss / n) + (len(a) + 1) / 2 * math.log2(max(2.0, n))


def partition_contexts(grams: list[np.ndarray], alpha: float = 0.05, greedy: bool = False, bits: Callable[[np.ndarray], float] | None = None) -> tuple[float, list[int]]:
    """Best total bits over a partition of the contexts, and the contexts' labels.

    Two contexts are joined if one common mechanism costs at most -log2(alpha)
    bits more than two; the groups are the components of these pairs, or with
    ``greedy`` the result of merging the best pair of groups while that saves bits.
    """
    bits = bits or gram_bits
    own = [bits(g) for g in grams]
    if greedy:
        groups = [([i], g, b) for i, (g, b) in enumerate(zip(grams, own, strict=True))]
        while len(groups) > 1:
            best = max(
                ((a[2] + b[2] - bits(a[1] + b[1]), i, i + 1 + j) for i, a in enumerate(groups) for j, b in enumerate(groups[i + 1 :])),
                key=lambda t: t[0],
            )
            if best[0] <= 0:
                break
            _, i, j = best
            merged = (groups[i][0] + groups[j][0], groups[i][1] + groups[j][1], bits(groups[i][1] + groups[j][1]))
            groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]
        members = sorted(sorted(g[0]) for g in groups)
        labels = [next(k for k, m in enumerate(members) if c in m) for c in range(len(grams))]
        return sum(g[2] for g in groups), labels
    from shiftscope.functions.numerics import components

    limit = -math.log2(alpha)
    pairs = [(i, j) for i in range(len(grams)) for j in range(i + 1, len(grams)) if bits(grams[i] + grams[j]) - own[i] - own[j] <= limit]
    labels = components(len(grams), pairs)
    total = sum(bits(sum(g for g, l in zip(grams, labels, strict=True) if l == k)) for k in set(labels))
    return total, labels


# --- searched scores on one group of rows -----------------------------------------


def rff_bits(x: np.ndarray, y: np.ndarray, features: int = 300, restarts: int = 5, seed: int = 0) -> float:
    """Ridge regression on random Fourier features: the best of seeded length scales and noises, with its effective parameters as cost."""
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    if x.shape[1] == 0:
        return null_bits(y)
    n, rng = len(y), np.random.default_rng(seed)
    z = (x - x.mean(0)) / (x.std(0) + 1e-12)
    spread = float(y.std()) + 1e-12
    t = (y - y.mean()) / spread
    w, b = rng.normal(size=(x.shape[1], features)), rng.uniform(0, 2 * math.pi, features)
    best = math.inf
    for _ in range(restarts):
        scale, ridge = math.exp(rng.uniform(-1.5, 1.5)), math.exp(rng.uniform(-6, 0))
        f = math.sqrt(2 / features) * np.cos(z @ w / scale + b)
        values, vectors = np.linalg.eigh(f.T @ f)
        shrink = np.maximum(0, values) / (np.maximum(0, values) + ridge * n)
        inner = vectors.T @ (f.T @ t)
        fit = f @ (vectors @ (inner / (np.maximum(0, values) + ridge * n)))
        best = min(best, n / 2 * math.log2(2 * math.pi * math.e * max(1e-12, float(((t - fit) ** 2).mean()))) + (shrink.sum() + 2) / 2 * math.log2(max(2, n)))
    return best + n * math.log2(spread)


def gam_bits(x: np.ndarray, y: np.ndarray, knots: int = 10) -> float:
    """Additive penalised splines, one smoothing parameter by generalised cross-validation, effective parameters as cost."""
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    if x.shape[1] == 0:
        return null_bits(y)
    n = len(y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-12)
    places = [np.unique(np.quantile(z[:, j], np.linspace(0.05, 0.95, knots))) for j in range(z.shape[1])]
    f = np.hstack([np.ones((n, 1)), z, *(np.maximum(0, z[:, [j]] - p) ** 3 for j, p in enumerate(places))])
    penal = np.diag([0.0] * (1 + z.shape[1]) + [1.0] * (f.shape[1] - 1 - z.shape[1]))
    best = None
    for weight in np.geomspace(1e-4, 1e4, 17):
        solve = np.linalg.pinv(f.T @ f + weight * penal)
        used = float(np.trace(solve @ (f.T @ f)))
        rss = float(((y - f @ (solve @ (f.T @ y))) ** 2).sum())
        gcv = rss / n / max(1e-9, 1 - used / n) ** 2
        if best is None or gcv < best[0]:
            best = (gcv, rss, used)
    return n / 2 * math.log2(2 * math.pi * math.e * max(1e-12, best[1] / n)) + (best[2] + 1) / 2 * math.log2(max(2, n))


#: scores of one group of rows by name
SCORES = {"gp": gp_bits, "rff": rff_bits, "gam": gam_bits}


def score_of(kind: str, x: np.ndarray, y: np.ndarray) -> float:
    if kind not in SCORES:
        raise ValueError(f"unknown score {kind}")
    return SCORES[kind](x, y)
