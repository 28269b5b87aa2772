"""Two-sample and conditional independence tests on one group of rows (numpy).

Kernel tests cost the square of the rows or more; they take at most ``MOST``
rows, drawn by a seeded generator, which callers may raise.
"""

from __future__ import annotations

import math

import numpy as np

from shiftscope.functions.numerics import chi2_sf, digamma, gamma_q, normal_sf

MOST = 800


def thin(*blocks: np.ndarray, most: int = MOST, seed: int = 0) -> list[np.ndarray]:
    """The same seeded rows of every block."""
    n = len(blocks[0])
    if n <= most:
        return [np.asarray(b, dtype=float) for b in blocks]
    keep = np.sort(np.random.default_rng(seed).choice(n, most, replace=False))
    return [np.asarray(b, dtype=float)[keep] for b in blocks]


def squared_distances(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    y = x if y is None else y
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T)


def median_width(x: np.ndarray) -> float:
    d = np.sqrt(squared_distances(x))[np.triu_indices(len(x), 1)]
    d = d[d > 0]
    return float(np.median(d)) if len(d) else 1.0


def rbf(x: np.ndarray, y: np.ndarray | None = None, width: float | None = None) -> np.ndarray:
    width = median_width(x) if width is None else width
    return np.exp(-squared_distances(x, y) / (2 * width * width))


def centred(k: np.ndarray) -> np.ndarray:
    k = k - k.mean(0)
    return k - k.mean(1)[:, None]


def standard(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    x = x.reshape(len(x), -1)
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s < 1e-12, 1, s)


def fisher_z(corr: np.ndarray, n: int, x: int, y: int, z: tuple[int, ...] = ()) -> tuple[float, float]:
    """Statistic and two-sided p of the partial correlation, from the correlation matrix."""
    index = [x, y, *z]
    precision = np.linalg.pinv(corr[np.ix_(index, index)])
    r = -precision[0, 1] / math.sqrt(max(1e-300, precision[0, 0] * precision[1, 1]))
    r = min(max(r, -1 + 1e-12), 1 - 1e-12)
    stat = abs(0.5 * math.log((1 + r) / (1 - r))) * math.sqrt(max(1, n - len(z) - 3))
    return stat, 2 * normal_sf(stat)


def g_square(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None) -> tuple[float, float]:
    """G squared of discrete columns given the combinations of z; p is 1 with under ten rows per degree of freedom."""
    strata = np.zeros(len(x), dtype=int) if z is None or not z.size else np.unique(z.reshape(len(x), -1), axis=0, return_inverse=True)[1].ravel()
    i, j = np.unique(x, return_inverse=True)[1].ravel(), np.unique(y, return_inverse=True)[1].ravel()
    cube = np.zeros((i.max() + 1, j.max() + 1, strata.max() + 1))
    np.add.at(cube, (i, j, strata), 1)
    expected = cube.sum(1, keepdims=True) * cube.sum(0, keepdims=True) / np.maximum(1, cube.sum((0, 1), keepdims=True))
    some = cube > 0
    stat = float(2 * (cube[some] * np.log(cube[some] / expected[some])).sum())
    dof = (cube.shape[0] - 1) * (cube.shape[1] - 1) * cube.shape[2]
    return (stat, 1.0) if dof == 0 or len(x) < 10 * dof else (stat, chi2_sf(stat, dof))


def mmd(x: np.ndarray, y: np.ndarray, permutations: int = 200, seed: int = 0) -> tuple[float, float]:
    """Maximum mean discrepancy with a permutation p value."""
    x, y = (np.asarray(v, dtype=float).reshape(len(v), -1) for v in (x, y))
    (x,), (y,) = thin(x, most=MOST // 2, seed=seed), thin(y, most=MOST // 2, seed=seed)
    k = rbf(np.vstack([x, y]))
    group = np.repeat([1.0, -1.0], [len(x), len(y)])
    weight = lambda g: np.where(g > 0, 1 / len(x), -1 / len(y))
    stat = float(weight(group) @ k @ weight(group))
    rng = np.random.default_rng(seed)
    null = np.stack([weight(rng.permutation(group)) for _ in range(permutations)])
    return stat, (1 + int(((null @ k) * null).sum(1).__ge__(stat).sum())) / (1 + permutations)


def kci(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, ridge: float = 1e-3, seed: int = 0) -> tuple[float, float]:
    """Kernel conditional independence with the gamma approximation of the null."""
    x, y = standard(x), standard(y)
    if z is None or not np.asarray(z).size:
        x, y = thin(x, y, seed=seed)
        kx, ky = centred(rbf(x)), centred(rbf(y))
        n = len(x)
        mean = np.trace(kx) * np.trace(ky) / n
        var = 2 * (kx * kx).sum() * (ky * ky).sum() / n / n
    else:
        z = standard(z)
        x, y, z = thin(x, y, z, seed=seed)
        n = len(x)
        width = median_width(z)
        kz = centred(rbf(z, width=width))
        remove = ridge * n * np.linalg.inv(kz + ridge * n * np.eye(n))
        kx = remove @ centred(rbf(np.hstack([x, z / 2]))) @ remove
        ky = remove @ centred(rbf(y)) @ remove
        (lx, vx), (ly, vy) = np.linalg.eigh((kx + kx.T) / 2), np.linalg.eigh((ky + ky.T) / 2)
        px, py = (v[:, top] * np.sqrt(w[top]) for w, v in ((lx, vx), (ly, vy)) for top in [w > w.max() * 1e-5])
        px, py = px[:, -60:], py[:, -60:]
        w = (px[:, :, None] * py[:, None, :]).reshape(n, -1)
        gram = w @ w.T if w.shape[1] > n else w.T @ w
        mean, var = float(np.trace(gram)), 2 * float((gram * gram).sum())
    stat = float((kx * ky).sum())
    return stat, gamma_q(mean * mean / var, stat * mean / var)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (bias first) by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def kcd(x: np.ndarray, y: np.ndarray, group: np.ndarray, permutations: int = 1000, ridge: float = 1e-2, seed: int = 0) -> tuple[float, float]:
    """Kernel conditional discrepancy between y given x in two groups; the null redraws groups by their propensity given x."""
    x, y, group = thin(standard(x), standard(y), group, seed=seed)
    n = len(x)
    kx, ky = rbf(x), rbf(y)
    w = logistic(x, group)
    chance = 1 / (1 + np.exp(-np.clip(np.hstack([np.ones((n, 1)), x]) @ w, -30, 30)))
    # conditional mean embeddings by ridge regression on each group's rows; their squared distance at all rows
    # through a factor of ky, which has few columns above rounding
    values, vectors = np.linalg.eigh(ky)
    some = values > values.max() * 1e-14
    factor = vectors[:, some] * np.sqrt(values[some])

    def statistic(g: np.ndarray) -> float:
        parts = []
        for side in (g > 0.5, g <= 0.5):
            own = np.flatnonzero(side)
            if len(own) < 3:
                return 0.0
            parts.append(kx[:, own] @ np.linalg.solve(kx[np.ix_(own, own)] + ridge * len(own) * np.eye(len(own)), factor[own]))
        return float(((parts[0] - parts[1]) ** 2).sum() / n)

    stat = statistic(group)
    rng = np.random.default_rng(seed)
    above = sum(statistic((rng.random(n) < chance).astype(float)) >= stat for _ in range(permutations))
    return stat, (1 + above) / (1 + permutations)


def knn_cmi(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, k: int = 5) -> float:
    """Nearest-neighbour estimate of (conditional) mutual information in nats, with the maximum norm."""
    x, y = standard(x), standard(y)
    blocks = [x, y] if z is None else [x, y, standard(z)]
    blocks = thin(*blocks)
    dist = [np.abs(b[:, None] - b[None]).max(-1) for b in blocks]
    whole = np.maximum.reduce(dist)
    np.fill_diagonal(whole, np.inf)
    radius = np.sort(whole, axis=1)[:, k - 1][:, None]
    count = lambda *d: (np.maximum.reduce(d) < radius).sum(1)  # noqa: E731  itself included
    if z is None:
        return float(digamma(np.array([k]))[0] + digamma(np.array([len(x)]))[0] - (digamma(count(dist[0])) + digamma(count(dist[1]))).mean())
    return float(digamma(np.array([k]))[0] - (digamma(count(dist[0], dist[2])) + digamma(count(dist[1], dist[2])) - digamma(count(dist[2]))).mean())


def cmi_permutation(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, k: int = 5, shuffles: int = 100, seed: int = 0) -> tuple[float, float]:
    """p value of the nearest-neighbour CMI: x is exchanged among neighbours in z."""
    blocks = thin(standard(x), standard(y), *([] if z is None else [standard(z)]), most=300, seed=seed)
    x, y, z = blocks[0], blocks[1], blocks[2] if len(blocks) > 2 else None
    stat, rng = knn_cmi(x, y, z, k), np.random.default_rng(seed)
    near = None if z is None else np.argsort(np.abs(z[:, None] - z[None]).max(-1), axis=1)[:, : max(k, 5)]
    null = []
    for _ in range(shuffles):
        order = rng.permutation(len(x))
        if near is not None:  # each row takes a neighbour's x that is taken least
            taken, order = np.zeros(len(x), dtype=int), np.empty(len(x), dtype=int)
            for i in rng.permutation(len(x)):
                options = rng.permutation(near[i])
                order[i] = options[np.argmin(taken[options])]
                taken[order[i]] += 1
        null.append(knn_cmi(x[order], y, z, k))
    return stat, float((np.array(null) >= stat).mean())


def ks(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p."""
    both = np.sort(np.concatenate([a, b]))
    stat = float(np.abs(np.searchsorted(np.sort(a), both, side="right") / len(a) - np.searchsorted(np.sort(b), both, side="right") / len(b)).max())
    return stat, ks_p(stat, len(a), len(b))


def ks_p(stat: float, n: int, m: int) -> float:
    size = math.sqrt(n * m / (n + m))
    t = (size + 0.12 + 0.11 / size) * stat
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))))


def invariant_residuals(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> tuple[float, float]:
    """Pooled cubic regression; residuals of two groups compared by KS (distribution), p doubled at most to 1."""
    x = standard(x)
    basis = np.hstack([np.ones((len(x), 1)), x, x**2, x**3])
    residual = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
    a, b = residual[group > 0.5], residual[group <= 0.5]
    stat, p = ks(a, b)
    spread, q = ks(np.abs(a - np.median(a)), np.abs(b - np.median(b)))
    return max(stat, spread), min(1.0, 2 * min(p, q))


def linear_params(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> tuple[float, float]:
    """Likelihood-ratio test of one linear Gaussian mechanism against one per group."""

    def loss(a: np.ndarray, b: np.ndarray) -> float:
        f = np.hstack([np.ones((len(a), 1)), a])
        return len(a) * math.log(max(1e-12, float(((b - f @ np.linalg.lstsq(f, b, rcond=None)[0]) ** 2).mean())))

    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    one = group > 0.5
    stat = loss(x, y) - loss(x[one], y[one]) - loss(x[~one], y[~one])
    return stat, chi2_sf(max(0.0, stat), x.shape[1] + 2)


def linear_params_grams(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """``linear_params`` from each group's cross products of (1, x) and y (last)."""

    def loss(g: np.ndarray) -> float:
        w = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]
        return g[0, 0] * math.log(max(1e-12, float(g[-1, -1] - 2 * w @ g[:-1, -1] + w @ g[:-1, :-1] @ w) / g[0, 0]))

    stat = loss(a + b) - loss(a) - loss(b)
    return stat, chi2_sf(max(0.0, stat), len(a))


def classifier_two_sample(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, seed: int = 0) -> tuple[float, float]:
    """Classifier test of independence: rows against rows with x permuted (within neighbours of z)."""
    rng = np.random.default_rng(seed)
    x, y = standard(x), standard(y)
    rest = y if z is None else np.hstack([y, standard(z)])
    n = len(x)
    order = rng.permutation(n) if z is None else np.lexsort((rng.random(n), np.round(standard(z)[:, 0], 1)))
    swapped = x.copy()
    if z is None:
        swapped = x[order]
    else:
        swapped[order] = x[np.roll(order, 1)]
    real, fake = np.hstack([x, rest]), np.hstack([swapped, rest])
    cross = lambda m: np.hstack([m, (m[:, :, None] * m[:, None, :]).reshape(len(m), -1)])
    half = n // 2
    # both versions of a row fall on the same side of the split, so rows can't be recognised
    train, test = np.vstack([cross(real[:half]), cross(fake[:half])]), np.vstack([cross(real[half:]), cross(fake[half:])])
    w = logistic(train, np.repeat([1.0, 0.0], half), 1.0)
    guess = np.hstack([np.ones((len(test), 1)), test]) @ w > 0
    accuracy = float((guess == (np.arange(len(test)) < n - half)).mean())
    stat = (accuracy - 0.5) / math.sqrt(0.25 / len(test))
    return accuracy, normal_sf(stat)


PAIR_TESTS = {"kcd": kcd, "residuals": invariant_residuals, "linear": linear_params}


# --- classifiers and witnesses -------------------------------------------------------


def nearest_in(z: np.ndarray, k: int = 1) -> np.ndarray:
    """Numbers of the k nearest other rows of every row, nearest first."""
    d = squared_distances(np.asarray(z, dtype=float).reshape(len(z), -1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def shuffle_split(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, k: int = 1, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Halves for training and testing of real rows (label 1) and rows whose x is exchanged (label 0): among all rows, or with a near row in z."""
    rng = np.random.default_rng(seed)
    x, y = standard(x), standard(y)
    rest = y if z is None else np.hstack([y, standard(z)])
    order = rng.permutation(len(x))
    out = []
    for part in (order[: len(x) // 2], order[len(x) // 2 :]):
        if z is None:
            other = part[rng.permutation(len(part))]
        else:
            near = nearest_in(standard(z)[part], k)
            other = part[near[np.arange(len(part)), rng.integers(0, near.shape[1], len(part))]]
        out += [np.vstack([np.hstack([x[part], rest[part]]), np.hstack([x[other], rest[part]])]), np.repeat([1.0, 0.0], len(part))]
    return out[0], out[1], out[2], out[3]


def f_divergence(joint: np.ndarray, product: np.ndarray) -> float:
    """Lower bound of the divergence from scores (log density ratios) under the joint and the product distribution."""
    return float(np.mean(joint) - np.log(np.mean(np.exp(np.clip(product, -30, 30)))))


def classifier_cmi(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, shuffles: int = 50, seed: int = 0) -> tuple[float, float]:
    """(Conditional) mutual information by a classifier's density ratio on held-out rows, and its p value against exchanged x."""

    def estimate(x: np.ndarray, s: int) -> float:
        train, label, test, truth = shuffle_split(x, y, z, 5, s)
        cross = lambda m: np.hstack([m, (m[:, :, None] * m[:, None, :]).reshape(len(m), -1)])
        w = logistic(cross(train), label, 1.0)
        score = np.hstack([np.ones((len(test), 1)), cross(test)]) @ w
        return f_divergence(score[truth > 0.5], score[truth < 0.5])

    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    stat, rng, null = estimate(x, seed), np.random.default_rng(seed), []
    near = None if z is None else nearest_in(standard(z), 5)
    for s in range(shuffles):
        order = rng.permutation(len(x)) if near is None else near[np.arange(len(x)), rng.integers(0, near.shape[1], len(x))]
        null.append(estimate(x[order], seed + s + 1))
    return stat, float((1 + (np.array(null) >= stat).sum()) / (1 + shuffles))


def ridge_by_bound(k: np.ndarray, low: float = 1e-6, high: float = 1.0, steps: int = 60) -> float:
    """The regulariser that minimises a bound on a kernel regression's error (its variance and bias terms), by golden section on the log scale."""
    n = len(k)
    values = np.maximum(0, np.linalg.eigvalsh((k + k.T) / 2)) / n

    def bound(log_ridge: float) -> float:
        r = math.exp(log_ridge)
        return float((values / (values + r)).sum() / n + ((r / (values + r)) ** 2 * values).sum())

    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if bound(c) < bound(d) else (c, b)
    return math.exp((a + b) / 2)


def kcd_witness(x: np.ndarray, y: np.ndarray, group: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, ridge: float | None = None) -> np.ndarray:
    """Where two groups' conditional distributions differ: the difference of their embeddings, evaluated at pairs (x, y)."""
    x, y = (np.asarray(v, dtype=float).reshape(len(v), -1) for v in (x, y))
    at_x, at_y = (np.asarray(v, dtype=float).reshape(len(v), -1) for v in (at_x, at_y))
    wx, wy = median_width(x), median_width(y)
    parts = []
    for side in (group > 0.5, group <= 0.5):
        k = rbf(x[side], width=wx)
        r = ridge_by_bound(k) if ridge is None else ridge
        weights = np.linalg.solve(k + r * side.sum() * np.eye(side.sum()), rbf(x[side], at_x, wx))
        parts.append((weights * rbf(y[side], at_y, wy)).sum(0))
    return parts[0] - parts[1]


def kcd_tuned(x: np.ndarray, y: np.ndarray, group: np.ndarray, permutations: int = 200, seed: int = 0) -> tuple[float, float]:
    """Kernel conditional discrepancy whose regulariser has the best signal-to-noise ratio on one half; the other half gives statistic and p."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    train, test = order[: len(y) // 2], order[len(y) // 2 :]
    x = np.asarray(x, dtype=float).reshape(len(y), -1)

    def ratio(r: float) -> float:
        stat, _ = kcd(x[train], y[train], group[train], 0, r, seed)
        null = [kcd(x[train], y[train], rng.permutation(group[train]), 0, r, seed)[0] for _ in range(5)]
        return (stat - np.mean(null)) / (np.std(null) + 1e-9)

    best = max((1e-4, 1e-3, 1e-2, 1e-1), key=ratio)
    return kcd(x[test], y[test], group[test], permutations, best, seed)
