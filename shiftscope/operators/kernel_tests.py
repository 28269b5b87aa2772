"""Kernel tests over all rows of every group, by feature maps whose cross products add up.

Columns are scaled by the median distance of their group's rows and mapped to random
Fourier features of the Gaussian kernel, the same ones for every task.  Statistics
and the spectrum of their null distribution are sums over rows: two passes, each an
aggregate of small matrices per group.  The null is a weighted sum of chi squares,
approximated by a gamma distribution of its mean and variance.  ``functions.independence``
has the exact tests, of the square of the rows, on one array.

Rows with a null among the columns are left out; groups of fewer than ``LEAST`` rows, or
of one side alone, have statistic 0 and p 1.  Results are small: one per group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.numerics import gamma_q
from shiftscope.operators import scoring

#: features of tested columns, and of each conditioning column, whose kernel is the narrower one:
#: what a regression on the conditions leaves unfitted would pass for dependence
TESTED, GIVEN, WIDTH = 12, 40, 0.5
LEAST = 10
QUANTILES = 101
Results = dict[str, tuple[float, float]]


class FourierMap:
    """Features whose inner products approach the Gaussian kernel of width ``width`` (of columns scaled already)."""

    def __init__(self, columns: int, features: int, seed: int, width: float = 1.0):
        rng = np.random.default_rng((seed, columns, features))
        self.frequencies = rng.normal(size=(columns, features)) / width
        self.phases = rng.uniform(0, 2 * math.pi, features)

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)


def scaled(rows: DataFrame, by: str, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """``by``, ``keep`` and the columns less their group's mean, over the median distance of its rows; equal rows once, with their number ``_w``.

    The distance comes from ``QUANTILES`` quantiles of each group, whatever its size.
    """
    rows = rows.select(F.col(by).cast("string").alias(by), *keep, *(F.col(c).cast("double").alias(c) for c in cols)).dropna(subset=[*cols, *keep])
    points = F.array(*(F.lit(float(q)) for q in np.linspace(0, 1, QUANTILES)))
    table = []
    for r in rows.groupBy(by).agg(*(e for i, c in enumerate(cols) for e in (F.avg(c).alias(f"m{i}"), F.percentile_approx(c, points, 10_000).alias(f"q{i}")))).collect():
        values = []
        for i in range(len(cols)):
            q = np.array(r[f"q{i}"], dtype=float)
            apart = np.abs(q[:, None] - q[None])[np.triu_indices(len(q), 1)]
            apart = apart[apart > 0]
            values += [float(r[f"m{i}"]), float(np.median(apart)) if len(apart) else 1.0]
        table.append((r[by], *values))
    schema = ", ".join([f"_g string", *(f"_{n}{i} double" for i in range(len(cols)) for n in "ms")])
    stats = rows.sparkSession.createDataFrame(table, schema)  # one row per group, as many as there are results
    both = rows.join(F.broadcast(stats), F.col(by).eqNullSafe(F.col("_g")))
    level = both.select(by, *keep, *(((F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(c) for i, c in enumerate(cols)))
    return level.groupBy(by, *keep, *cols).agg(F.count(F.lit(1)).cast("double").alias("_w"))


def _weighted(block: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Functions of rows times the root of the rows' numbers, which stand last."""
    return block * np.sqrt(v[:, -1:])


def _p(stat: float, spectrum: np.ndarray) -> float:
    """Chance of as much under a weighted sum of chi squares, from the matrix whose eigenvalues are the weights."""
    mean, var = float(np.trace(spectrum)), 2 * float((spectrum * spectrum).sum())
    return 1.0 if mean <= 0 or var <= 0 else float(gamma_q(mean * mean / var, stat * mean / var))


def _ridge(block: np.ndarray, target: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge regression from cross products; the first function, one, has no penalty."""
    return np.linalg.solve(block + ridge * max(1.0, block[0, 0]) * np.diag([1e-9, *np.ones(len(block) - 1)]), target)


def kci(rows: DataFrame, by: str, x: list[str], y: list[str], z: list[str] = (), ridge: float = 1e-4, seed: int = 0) -> Results:
    """Independence of x and y given z per group: cross products of what regressions on z leave of the features."""
    cols = [*x, *y, *z]
    at_x, at_y, at_z = (list(map(cols.index, c)) for c in (x, y, z))
    fx, fy, fz = FourierMap(len(x) + len(z), TESTED, seed), FourierMap(len(y), TESTED, seed + 1), FourierMap(len(z), GIVEN * len(z), seed + 2, WIDTH)
    rows = scaled(rows, by, cols).persist()

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.ones((len(v), 1))
        given = np.hstack([one, fz(v[:, at_z])]) if z else one
        return given, np.hstack([fx(np.hstack([v[:, at_x], v[:, at_z] / 2])), fy(v[:, at_y])])

    def first(v: np.ndarray) -> list[np.ndarray]:
        block = _weighted(np.hstack(parts(v)), v)
        return [block.T @ block]

    wide = 1 + GIVEN * len(z)
    weights = {k[1]: _ridge(g[:wide, :wide], g[:wide, wide:], ridge) for k, g in scoring.summed(rows, [*cols, "_w"], [by], first).items()}

    def second(key: tuple, v: np.ndarray) -> list[np.ndarray]:
        given, tested = parts(v)
        left = tested - given @ weights[key[0]]
        product = (left[:, :TESTED, None] * left[:, None, TESTED:]).reshape(len(v), -1)
        block = _weighted(np.hstack([np.ones((len(v), 1)), product]), v)
        return [block.T @ block]

    out = {}
    for (_, group), g in scoring.summed(rows, [*cols, "_w"], [by], second, keyed=True).items():
        n = g[0, 0]
        stat = float(g[0, 1:] @ g[0, 1:]) / n
        out[group] = (stat, _p(stat, g[1:, 1:] / n)) if n >= LEAST else (0.0, 1.0)
    rows.unpersist()
    return out


def _sides(table: dict[tuple, np.ndarray]) -> dict[str, list[np.ndarray]]:
    """Matrices of sides 0 and 1 by group, of groups that have both."""
    found: dict[str, dict[str, np.ndarray]] = {}
    for (_, group, side), g in table.items():
        found.setdefault(group, {})[side] = g
    return {group: [s["0"], s["1"]] if len(s) == 2 and min(s["0"][0, 0], s["1"][0, 0]) >= LEAST else [] for group, s in found.items()}


def _with_sides(rows: DataFrame, by: str, cols: list[str], side: str) -> DataFrame:
    return scaled(rows.withColumn(side, F.col(side).cast("int")), by, cols, [side])


def mmd(rows: DataFrame, by: str, cols: list[str], side: str, seed: int = 0) -> Results:
    """Distance per group of the mean features of sides 0 and 1; one pass."""
    f = FourierMap(len(cols), GIVEN, seed)

    def block(v: np.ndarray) -> list[np.ndarray]:
        b = _weighted(np.hstack([np.ones((len(v), 1)), f(v[:, :-1])]), v)
        return [b.T @ b]

    out = {}
    for group, sides in _sides(scoring.summed(_with_sides(rows, by, cols, side), [*cols, "_w"], [by, side], block)).items():
        if not sides:
            out[group] = (0.0, 1.0)
            continue
        counts, means = [g[0, 0] for g in sides], [g[0, 1:] / g[0, 0] for g in sides]
        within = sum(g[1:, 1:] - n * np.outer(m, m) for g, n, m in zip(sides, counts, means, strict=True)) / sum(counts)
        stat = float((means[1] - means[0]) @ (means[1] - means[0]))
        out[group] = (stat, _p(stat, within * sum(1 / n for n in counts)))
    return out


def kcd(rows: DataFrame, by: str, x: list[str], y: list[str], side: str, ridge: float = 1e-4, seed: int = 0) -> Results:
    """Distance per group of the sides' conditional mean features of y given x, averaged over all rows.

    Both sides' regressions are told apart by the scores of the pooled one, whose
    variance allows for noise that depends on x and for sides that differ in x.
    """
    cols = [*x, *y]
    at_x, at_y = list(range(len(x))), list(range(len(x), len(cols)))
    given_size = GIVEN // 2 * len(x)
    fx, fy = FourierMap(len(x), given_size, seed, WIDTH), FourierMap(len(y), TESTED, seed + 1)
    rows = _with_sides(rows, by, cols, side).persist()
    wide = 1 + given_size

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.hstack([np.ones((len(v), 1)), fx(v[:, at_x])]), fy(v[:, at_y])

    def first(v: np.ndarray) -> list[np.ndarray]:
        block = _weighted(np.hstack(parts(v)), v)
        return [block.T @ block]

    sides = _sides(scoring.summed(rows, [*cols, "_w"], [by, side], first))
    weights = {k: _ridge(sum(s)[:wide, :wide], sum(s)[:wide, wide:], ridge) for k, s in sides.items() if s}

    def second(key: tuple, v: np.ndarray) -> list[np.ndarray]:
        if key[0] not in weights:
            return [np.zeros((wide * TESTED, wide * TESTED))]
        given, tested = parts(v)
        score = _weighted((given[:, :, None] * (tested - given @ weights[key[0]])[:, None, :]).reshape(len(v), -1), v)
        return [score.T @ score]

    spread = scoring.summed(rows, [*cols, "_w"], [by, side], second, keyed=True)
    rows.unpersist()
    out = {}
    for group, s in sides.items():
        if not s:
            out[group] = (0.0, 1.0)
            continue
        n = s[0][0, 0] + s[1][0, 0]
        values, vectors = np.linalg.eigh((s[0] + s[1])[:wide, :wide] / n)
        root = vectors * np.sqrt(np.maximum(0, values)) @ vectors.T
        apart, null = 0.0, 0.0
        for name, sign, g in (("0", -1, s[0]), ("1", 1, s[1])):
            inner = g[:wide, :wide]
            score = g[:wide, wide:] - inner @ weights[group]
            solve = root @ np.linalg.inv(inner + ridge * g[0, 0] * np.diag([1e-9, *np.ones(wide - 1)]))
            apart = apart + sign * solve @ score
            full = np.kron(solve, np.eye(TESTED))
            null = null + full @ spread[0, group, name] @ full.T
        stat = float((apart * apart).sum())
        out[group] = (stat, _p(stat, null))
    return out
