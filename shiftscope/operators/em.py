"""Mixtures fitted to all rows of a table: expectation and maximisation as one aggregate a round.

A round sends the parameters of all candidates (numbers of components) to the
rows; every task weighs its rows by their posteriors and sums, for each component,
the cross products of one, the functions of the parents and the target.  Those sums
are all that a regression or a Gaussian needs, so what returns to the driver is a
small matrix per component.  Candidates leave the rounds as they converge, and BIC
over all rows chooses among them.  Starts come from a bounded sample (``most`` rows);
the rounds see every row.

Rows with a null among the columns are left out.  Repeated rows count as often as they
occur.  Ties in BIC go to fewer components.  A table without rows has no mixture.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.numerics import kmeans
from shiftscope.operators import scoring

POWERS = {"lin": 1, "quad": 2, "cub": 3}
#: least variance of a component, as a share of the target's
FLOOR = 1e-4


def features(z: np.ndarray, kind: str) -> np.ndarray:
    """One, powers of the standardised parents (for regressions) or the columns themselves, and the target (last column)."""
    one = np.ones((len(z), 1))
    if kind == "gmm":
        return np.hstack([one, z])
    return np.hstack([one, *(z[:, :-1] ** p for p in range(1, POWERS[kind] + 1)), z[:, -1:]])


@dataclass
class Mixture:
    """Components of standardised columns: regressions (``weights``, ``spreads``) or Gaussians (means and covariances)."""

    kind: str
    centre: np.ndarray
    scale: np.ndarray
    shares: np.ndarray
    weights: np.ndarray
    spreads: np.ndarray
    log_likelihood: float = -math.inf
    n: int = 0

    @property
    def k(self) -> int:
        return len(self.shares)

    @property
    def bic(self) -> float:
        d = len(self.scale)
        own = d + d * (d + 1) / 2 if self.kind == "gmm" else self.weights.shape[1] + 1
        # the likelihood of the columns in their own units
        units = self.n * float(np.log(self.scale if self.kind == "gmm" else self.scale[-1:]).sum())
        return -2 * (self.log_likelihood - units) + (self.k * (own + 1) - 1) * math.log(max(2, self.n))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) / self.scale

    def log_parts(self, f: np.ndarray) -> np.ndarray:
        """Log of share times density of each row under each component."""
        out = np.empty((len(f), self.k))
        for j in range(self.k):
            if self.kind == "gmm":
                low = np.linalg.cholesky(self.spreads[j])
                a = np.linalg.solve(low, (f[:, 1:] - self.weights[j]).T)
                out[:, j] = -0.5 * (a * a).sum(0) - np.log(np.diag(low)).sum() - len(low) / 2 * math.log(2 * math.pi)
            else:
                r = f[:, -1] - f[:, :-1] @ self.weights[j]
                out[:, j] = -0.5 * (math.log(2 * math.pi * self.spreads[j]) + r * r / self.spreads[j])
        return out + np.log(self.shares)

    def lines(self) -> list[list[float]]:
        """Intercept and slopes of each component in the columns' own units (linear regressions)."""
        slopes = self.weights[:, 1:] * self.scale[-1] / self.scale[:-1]
        base = self.centre[-1] + self.scale[-1] * self.weights[:, 0] - slopes @ self.centre[:-1]
        return np.column_stack([base, slopes]).tolist()

    def posterior(self, f: np.ndarray) -> tuple[np.ndarray, float]:
        logs = self.log_parts(f)
        top = logs.max(1, keepdims=True)
        whole = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        return np.exp(logs - whole), float(whole.sum())

    def sums(self, x: np.ndarray, whole: bool = False) -> list[np.ndarray]:
        """The cross products that each component answers for (with ``whole``: of the rows that are likeliest its own), and the log likelihood."""
        f = features(self.standard(x), self.kind)
        post, value = self.posterior(f)
        if whole:
            post = np.eye(self.k)[post.argmax(1)]
        return [*((f * post[:, [j]]).T @ f for j in range(self.k)), np.array([[value]])]

    def step(self, sums: list[np.ndarray]) -> Mixture:
        """The components that the sums make best."""
        weight = np.array([max(1e-9, s[0, 0]) for s in sums])
        weights, spreads = [], []
        for s, n in zip(sums, weight, strict=True):
            if self.kind == "gmm":
                mean = s[0, 1:] / n
                weights.append(mean)
                spreads.append((s[1:, 1:] / n - np.outer(mean, mean)) + 1e-6 * np.eye(len(mean)))
            else:
                a, b = s[:-1, :-1] + 1e-8 * np.eye(len(s) - 1), s[:-1, -1]
                w = np.linalg.lstsq(a, b, rcond=None)[0]
                weights.append(w)
                spreads.append(max(FLOOR, float(s[-1, -1] - 2 * w @ b + w @ s[:-1, :-1] @ w) / n))
        return Mixture(self.kind, self.centre, self.scale, weight / weight.sum(), np.array(weights), np.array(spreads))


def _start(kind: str, centre: np.ndarray, scale: np.ndarray, x: np.ndarray, k: int, seed: int, starts: int) -> Mixture:
    """The best of several seeded runs on the sample."""
    rng, best = np.random.default_rng((seed, k)), None
    z = (x - centre) / scale
    f = features(z, kind)
    for s in range(starts if k > 1 else 1):
        post = np.eye(k)[kmeans(z, k, seed + s, 1)[0]] * 0.9 + 0.1 / k if kind == "gmm" else rng.dirichlet(np.ones(k) * 0.5, len(z))
        model = Mixture(kind, centre, scale, np.ones(k), np.zeros(0), np.zeros(0))
        last = -math.inf
        for _ in range(200):
            model = model.step([(f * post[:, [j]]).T @ f for j in range(k)])
            post, value = model.posterior(f)
            if value - last < 1e-6 * abs(value):
                break
            last = value
        if best is None or value > best[0]:
            best = (value, model)
    return best[1]


def fit(df: DataFrame, node: str, parents: list[str], kind: str = "lin", k_max: int = 5, seed: int = 42, rounds: int = 100, tolerance: float = 1e-6, most: int = 5000, starts: int = 4) -> list[Mixture]:
    """The converged mixture of every number of components, the best by BIC first."""
    kind = kind if parents else "gmm"
    cols = [*parents, node]
    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols))).dropna().persist()
    names = rows.columns
    n = rows.count()
    if not n:
        rows.unpersist()
        return []
    centre, scale = scoring.column_stats(rows, names)
    scale = np.where(scale < 1e-12, 1.0, scale)
    some = rows.sample(min(1.0, 1.2 * most / n), seed) if n > most else rows
    sample = some.limit(most).toPandas().to_numpy(dtype=float)  # at most ``most`` rows
    live = [_start(kind, centre, scale, sample, k, seed, starts) for k in range(1, k_max + 1) if k <= len(sample)]
    done: list[Mixture] = []
    for turn in range(rounds + 1):
        table = scoring.summed(rows, names, [], lambda x: [m for model in live for m in model.sums(x)])
        at, still = 0, []
        for model in live:
            sums = [table[at + j,] for j in range(model.k)]
            value = float(table[at + model.k,][0, 0])
            at += model.k + 1
            gain = value - getattr(model, "before", -math.inf)
            model.log_likelihood, model.n = value, n
            if turn == rounds or model.k == 1 and turn or gain < tolerance * abs(value):
                done.append(model)
            else:
                following = model.step(sums)
                following.before = value
                still.append(following)
        live = still
        if not live:
            break
    rows.unpersist()
    return sorted(done, key=lambda m: (m.bic, m.k))


def assigned(df: DataFrame, node: str, parents: list[str], model: Mixture) -> Mixture:
    """The components made of the rows that are likeliest their own, in one pass.

    Posteriors of a floored variance leave every component a trace of the others' rows;
    these traces add up with the table, counts of rows do not have them.
    """
    cols = [*parents, node]
    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)))
    table = scoring.summed(rows, rows.columns, [], lambda x: model.sums(x, True))
    found = model.step([table[j,] for j in range(model.k)])
    found.log_likelihood, found.n = float(table[model.k,][0, 0]), model.n
    return found


def labelled(df: DataFrame, keep: list[str], node: str, parents: list[str], model: Mixture) -> DataFrame:
    """``keep`` columns with label and posterior of every row; null where a column is null."""
    cols = [*parents, node]
    rows = df.select(*keep, *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)))
    names = [f"_c{i}" for i in range(len(cols))]
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: a few rows of numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            good = np.isfinite(x).all(1)
            post, _ = model.posterior(features(model.standard(x[good]), model.kind))
            labels, posts = np.full(len(x), None, dtype=object), np.full(len(x), None, dtype=object)
            labels[good] = post.argmax(1)
            for i, p in zip(np.flatnonzero(good), post, strict=True):
                posts[i] = p
            yield batch[keep].assign(label=pd.array(labels, dtype="Int32"), posterior=posts)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep), "label int", "posterior array<double>"])
    return rows.mapInPandas(run, schema)


def components(spark, model: Mixture | None) -> DataFrame:
    """(component, share, size, weights, spread, bic): components from the largest on, in the columns' own units of the target."""
    rows = []
    for rank, j in enumerate(np.argsort(-model.shares, kind="stable").tolist() if model else []):
        spread = math.sqrt(float(model.spreads[j])) * float(model.scale[-1]) if model.kind != "gmm" else math.sqrt(float(model.spreads[j][-1, -1])) * float(model.scale[-1])
        rows.append((rank, float(model.shares[j]), float(model.shares[j] * model.n), [float(w) for w in np.ravel(model.weights[j])], spread, float(model.bic)))
    return spark.createDataFrame(rows, "component int, share double, size double, weights array<double>, spread double, bic double")
