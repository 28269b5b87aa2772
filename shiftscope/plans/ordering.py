"""Order-based discovery: leaf scores from the Stein estimator, likelihood orders, pruning from cross products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from shiftscope.functions.numerics import chi2_sf
from shiftscope.functions.scores import Basis, gram_bits
from shiftscope.operators import scoring


def stein_diagonal(x: np.ndarray, eta: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Score and diagonal of the log density's Hessian at each row, by kernel ridge estimates."""
    n, d = x.shape
    diff = x[:, None, :] - x[None, :, :]
    d2 = (diff**2).sum(-1)
    width = np.median(np.sqrt(d2[d2 > 0])) if (d2 > 0).any() else 1.0
    k = np.exp(-d2 / (2 * width**2)) / width
    inverse = np.linalg.inv(k + eta * np.eye(n))
    first = -np.einsum("ijd,ij->id", diff, k) / width**2
    score = inverse @ first
    second = np.einsum("ijd,ij->id", -1 / width**2 + diff**2 / width**4, k)
    return score, -(score**2) + inverse @ second


def stein_order(x: np.ndarray, eta: float = 0.001) -> list[int]:
    """Leaves first removed: the column whose Hessian entry varies least is a leaf."""
    left, out = list(range(x.shape[1])), []
    while len(left) > 1:
        leaf = left[int(stein_diagonal(x[:, left], eta)[1].var(0).argmin())]
        out.append(leaf)
        left.remove(leaf)
    return [*left, *out[::-1]]


def likelihood_order(df: DataFrame, cols: list[str], kind: str = "spline") -> list[int]:
    """Greedy additive edges by gain in bits, kept acyclic; one pass over the rows with an additive basis."""
    n = len(cols)
    basis = Basis(kind, *scoring.column_stats(df, cols))
    whole = scoring.WholeGram(df, cols, [], basis) if basis.additive else None
    parents: dict[int, set[int]] = {j: set() for j in range(n)}
    cache: dict = {}

    def load(wanted):
        missing = sorted({(j, tuple(sorted(p))) for j, p in wanted} - set(cache))
        found = {c: whole.of(c) for c in missing} if whole else scoring.grams(df, cols, [], missing, basis)
        cache.update({c: gram_bits(g[()]) for c, g in found.items() if g})

    def above(v: int) -> set[int]:
        seen, stack = set(), [v]
        while stack:
            for p in parents[stack.pop()] - seen:
                seen.add(p)
                stack.append(p)
        return seen

    while True:
        options = [(j, i) for j in range(n) for i in range(n) if i != j and i not in parents[j] and j not in above(i)]
        load([(j, parents[j] | e) for j, i in options for e in (set(), {i})])
        gain, j, i = max(((cache[j, tuple(sorted(parents[j]))] - cache[j, tuple(sorted(parents[j] | {i}))], j, i) for j, i in options), default=(0, 0, 0))
        if gain <= 0:
            break
        parents[j].add(i)
    order: list[int] = []
    while len(order) < n:
        order.append(next(v for v in range(n) if v not in order and parents[v] <= set(order)))
    return order


def prune(df: DataFrame, cols: list[str], order: list[int], alpha: float = 0.001, kind: str = "spline") -> set[tuple[int, int]]:
    """Edges of the order's dense graph whose removal the likelihood-ratio test rejects; two passes over the rows."""
    basis = Basis(kind, *scoring.column_stats(df, cols))
    full = {v: tuple(sorted(order[:k])) for k, v in enumerate(order)}
    wanted = [(v, ps) for v, ps in full.items()] + [(v, tuple(p for p in ps if p != q)) for v, ps in full.items() for q in ps]
    tables = scoring.grams(df, cols, [], sorted(set(wanted)), basis)

    def loss(v: int, ps: tuple[int, ...]) -> tuple[float, int]:
        g = tables[v, ps][()]
        n, size = g[0, 0], len(g) - 1
        bits = gram_bits(g) - (size + 1) / 2 * math.log2(max(2.0, n))
        return 2 * bits * math.log(2), size

    out = set()
    for v, ps in full.items():
        for q in ps:
            (a, ka), (b, kb) = loss(v, tuple(p for p in ps if p != q)), loss(v, ps)
            if chi2_sf(max(0.0, a - b), kb - ka) < alpha:
                out.add((q, v))
    return out


def direct_lingam(x: np.ndarray) -> list[int]:
    """Order by independence of regression residuals, measured by differences of entropy approximations."""
    x = (x - x.mean(0)) / x.std(0)
    entropy = lambda u: (1 + math.log(2 * math.pi)) / 2 - 79.047 * (np.log(np.cosh(u)).mean() - 0.37457) ** 2 - 7.4129 * (u * np.exp(-u * u / 2)).mean() ** 2
    left, out = list(range(x.shape[1])), []
    while len(left) > 1:
        cost = []
        for i in left:
            total = 0.0
            for j in left:
                if i == j:
                    continue
                r = (x[:, i] * x[:, j]).mean()
                a, b = x[:, i] - r * x[:, j], x[:, j] - r * x[:, i]
                total += min(0.0, (entropy(x[:, j]) + entropy(a / a.std())) - (entropy(x[:, i]) + entropy(b / b.std()))) ** 2
            cost.append(total)
        first = left[int(np.argmin(cost))]
        out.append(first)
        left.remove(first)
        for j in left:
            x[:, j] -= (x[:, first] * x[:, j]).mean() * x[:, first]
            x[:, j] = (x[:, j] - x[:, j].mean()) / x[:, j].std()
    return [*out, *left]


def kernel_ridge_cv(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, width: float | None = None, folds: int = 5) -> np.ndarray:
    """Predictions of y from x at every row by the model of the other folds (rows are dealt in order)."""
    from shiftscope.functions.independence import median_width, rbf

    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    k = rbf(x, width=median_width(x) if width is None else width)
    out, fold = np.empty(len(y)), np.arange(len(y)) % folds
    for f in range(folds):
        test, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        mean = y[train].mean()
        out[test] = mean + k[np.ix_(test, train)] @ np.linalg.solve(k[np.ix_(train, train)] + ridge * len(train) * np.eye(len(train)), y[train] - mean)
    return out


def residual_order(x: np.ndarray, ridge: float = 0.01, eta: float = 0.001) -> list[int]:
    """Leaves first removed: a leaf's residual given all others predicts its own entry of the score best."""
    left, out = list(range(x.shape[1])), []
    while len(left) > 1:
        score, _ = stein_diagonal(x[:, left], eta)
        errors = []
        for k, v in enumerate(left):
            rest = [w for w in left if w != v]
            residual = x[:, v] - kernel_ridge_cv(x[:, rest], x[:, v], ridge)
            errors.append(float(((score[:, k] - kernel_ridge_cv(residual, score[:, k], ridge)) ** 2).mean() / max(1e-12, score[:, k].var())))
        leaf = left[int(np.argmin(errors))]
        out.append(leaf)
        left.remove(leaf)
    return [*left, *out[::-1]]


def stein_hessian(x: np.ndarray, column: int, eta: float = 0.001) -> np.ndarray:
    """One row of the log density's Hessian at each row of x, by kernel ridge estimates."""
    n = len(x)
    diff = x[:, None, :] - x[None, :, :]
    d2 = (diff**2).sum(-1)
    width = np.median(np.sqrt(d2[d2 > 0])) if (d2 > 0).any() else 1.0
    k = np.exp(-d2 / (2 * width**2)) / width
    inverse = np.linalg.inv(k + eta * np.eye(n))
    score = inverse @ (-np.einsum("ijd,ij->id", diff, k) / width**2)
    second = np.einsum("ijd,ij->id", diff * diff[:, :, [column]], k) / width**4
    second[:, column] -= k.sum(1) / width**2
    return -score * score[:, [column]] + inverse @ second


def hessian_candidates(x: np.ndarray, order: list[int], alpha: float = 0.05, eta: float = 0.001, least: int = 1) -> set[tuple[int, int]]:
    """Pairs of the order that may be edges: entries of the Hessian that differ from the smallest one's by a Welch test."""
    out = set()
    for k in range(len(order) - 1, 0, -1):
        leaf, before = order[k], order[:k]
        cols = [*before, leaf]
        entries = np.abs(stein_hessian(x[:, cols], k, eta))[:, :k]
        mean, var, n = entries.mean(0), entries.var(0, ddof=1), len(x)
        low = int(mean.argmin())
        rank = np.argsort(-mean)
        for place, j in enumerate(rank):
            gap = mean[j] - mean[low]
            z = gap / math.sqrt(max(1e-300, (var[j] + var[low]) / n))
            if place < least or 0.5 * math.erfc(z / math.sqrt(2)) < alpha / 2:
                out.add((before[int(j)], leaf))
    return out


def neighbours(df: DataFrame, cols: list[str], threshold: float = 1.0, most: int | None = None, trees: int = 50, seed: int = 0) -> set[tuple[int, int]]:
    """Candidate parents of every column: those whose importance in a random forest of all others is over ``threshold`` times the mean (at most ``most``)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    out = set()
    for j, y in enumerate(cols):
        rest = [c for c in cols if c != y]
        table = VectorAssembler(inputCols=rest, outputCol="_x").transform(df.select(*cols).dropna())
        forest = RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=5, featureSubsetStrategy="onethird", seed=seed).fit(table)
        weight = forest.featureImportances.toArray()
        good = [i for i in np.argsort(-weight) if weight[i] >= threshold * weight.mean()]
        out |= {(cols.index(rest[i]), j) for i in good[:most]}
    return out


def random_order(n: int, seed: int = 0) -> np.ndarray:
    """Scores that put the columns in a seeded random order."""
    return np.random.default_rng(seed).permutation(n).astype(float)


def signal_scores(corr: np.ndarray, edges: set[tuple[int, int]]) -> np.ndarray:
    """How much of each column's variance its true parents explain, 0 without parents."""
    out = np.zeros(len(corr))
    for v in range(len(corr)):
        ps = sorted(a for a, b in edges if b == v)
        if ps:
            out[v] = corr[v, ps] @ np.linalg.pinv(corr[np.ix_(ps, ps)]) @ corr[ps, v] / corr[v, v]
    return out


def ica_lingam(x: np.ndarray, seed: int = 0, threshold: float = 0.1) -> tuple[list[int], np.ndarray]:
    """Order and weights (from column to row) by independent components, rows permuted to a diagonal without zeros, then the order closest to triangular."""
    from shiftscope.functions.numerics import assign

    x = np.asarray(x, dtype=float) - np.mean(x, axis=0)
    n, d = x.shape
    values, vectors = np.linalg.eigh(x.T @ x / n)
    white = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
    z = x @ white
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(500):
        u = np.tanh(z @ w.T)
        new = u.T @ z / n - np.diag((1 - u**2).mean(0)) @ w
        left, _, right = np.linalg.svd(new)
        new = left @ right
        if np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-9:
            w = new
            break
        w = new
    unmix = w @ white
    rows = [0] * d
    for component, column in assign(-1 / np.maximum(1e-12, np.abs(unmix))):
        rows[column] = component
    unmix = unmix[rows]
    weights = np.eye(d) - unmix / np.diag(unmix)[:, None]
    order: list[int] = []
    while len(order) < d:  # the next column is the one that the others left explain least
        left_ = [v for v in range(d) if v not in order]
        order.append(min(left_, key=lambda v: float((weights[v, [u for u in left_ if u != v]] ** 2).sum())))
    place = {v: k for k, v in enumerate(order)}
    keep = np.array([[abs(weights[i, j]) > threshold and place[j] < place[i] for j in range(d)] for i in range(d)])
    return order, weights * keep


def additive_with_hidden(x: np.ndarray, alpha: float = 0.01, most: int = 3) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Edges, and pairs with a hidden common cause or path, of additive models.

    Among sets of growing size the column is found whose residual, given the
    others by kernel ridge, is independent of them; the others become its
    candidates.  A candidate stays a parent if the residuals without it depend on
    it; dependent residuals that no parent explains mark a hidden pair.
    """
    from itertools import combinations

    from shiftscope.functions.independence import kci, standard

    x = standard(x)
    d = x.shape[1]
    residual = lambda v, ps: x[:, v] - kernel_ridge_cv(x[:, sorted(ps)], x[:, v]) if ps else x[:, v]
    apart = lambda a, b: kci(a[:, None], b[:, None])[1] > alpha
    near = {(a, b) for a, b in combinations(range(d), 2) if not apart(x[:, a], x[:, b])}
    linked = lambda a, b: tuple(sorted((a, b))) in near
    parents: dict[int, set[int]] = {v: set() for v in range(d)}
    size, changed = 2, True
    while size <= most:
        changed = False
        for group in combinations(range(d), size):
            options = []
            for v in group:
                others = set(group) - {v}
                if any(not linked(v, o) or o in parents[v] or v in parents[o] for o in others):
                    continue
                r = residual(v, parents[v] | others)
                options.append((min(kci(r[:, None], residual(o, parents[o])[:, None])[1] for o in others), v, others))
            if options and (best := max(options, key=lambda o: o[0]))[0] > alpha:
                parents[best[1]] |= best[2]
                changed = True
        size = 2 if changed else size + 1
    for v in range(d):
        for p in sorted(parents[v]):
            if apart(residual(v, parents[v] - {p}), residual(p, parents[p])):
                parents[v].discard(p)
    edges = {(p, v) for v, ps in parents.items() for p in ps}
    hidden = {(a, b) for a, b in near if (a, b) not in edges and (b, a) not in edges and not apart(residual(a, parents[a]), residual(b, parents[b]))}
    return edges, hidden


def discover(df: DataFrame, cols: list[str], method: str = "score", alpha: float = 0.001, most: int = 400, seed: int = 0) -> set[tuple[int, int]]:
    """Edges by ``score`` (Stein), ``residual`` (its residual variant), ``das`` (Stein with Hessian candidates), ``lingam`` or ``ica`` on a bounded sample, or ``cam``; pruning sees all rows."""
    candidates = None
    if method == "cam":
        order = likelihood_order(df, cols)
    else:
        from pyspark.sql import functions as F

        x = scoring.sampled(df.select(*cols).withColumn("_g", F.lit(0)), ["_g"], most, seed).drop("_g").toPandas()[cols].to_numpy(dtype=float)
        z = (x - x.mean(0)) / x.std(0)
        orders = {"score": lambda: stein_order(z), "das": lambda: stein_order(z), "residual": lambda: residual_order(z), "lingam": lambda: direct_lingam(x), "ica": lambda: ica_lingam(z, seed)[0]}
        order = orders[method]()
        if method == "das":
            candidates = hessian_candidates(z, order)
    found = prune(df, cols, order, alpha)
    return found if candidates is None else found & candidates
