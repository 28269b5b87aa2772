"""Lagged graphs and regimes of multi-context time series, by turns.

The graph step scores lagged parents with one mechanism per group of (context,
regime) cells; the regime step finds changepoints of the residuals' likelihood,
then gives windows that no node's mechanism tells apart the same regime.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.changepoints import pelt
from shiftscope.functions.numerics import insignificant
from shiftscope.functions.scores import Basis, partition_contexts
from shiftscope.operators import regimes, scoring


@dataclass
class LaggedRegimes:
    """``series``: the context column, ``t`` the time step (from 0 in every context)."""

    nodes: list[str]
    series: str = "context"
    t: str = "t"
    max_lag: int = 1
    min_duration: int = 20
    kind: str = "lin"
    alpha: float = 0.05
    penalty: float = 3.0
    iterations: int = 10
    parents: dict[int, set[int]] = field(default_factory=dict)  # lagged column numbers
    windows: list[tuple[int, int, int]] = field(default_factory=list)  # begin, duration, regime

    def fit(self, df: DataFrame) -> LaggedRegimes:
        spark = df.sparkSession
        lagged = regimes.lag_features(df.select(self.series, self.t, *self.nodes), [self.series], self.t, {n: list(range(1, self.max_lag + 1)) for n in self.nodes})
        self.columns = [*self.nodes, *(f"{n}_lag{k}" for k in range(1, self.max_lag + 1) for n in self.nodes)]
        basis = Basis(self.kind, *scoring.column_stats(lagged, self.columns))
        length = int(df.agg(F.max(self.t)).first()[0]) + 1
        self.windows = [(0, length, 0)]
        seen: list[list[tuple[int, int]]] = []
        for _ in range(self.iterations):
            rows = self._with_regimes(lagged, spark)
            self._search(rows, basis)
            cuts = self._cuts(rows, basis, length)
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            self.windows = self._regimes(lagged, spark, basis, spans)
            found = [(b, d) for b, d, _ in self.windows]
            if found in seen:
                break
            seen.append(found)
        return self

    def _with_regimes(self, lagged: DataFrame, spark) -> DataFrame:
        table = spark.createDataFrame([(b, b + d, r, k) for k, (b, d, r) in enumerate(self.windows)], "t0 long, tn long, regime int, window int")
        # as many rows as windows: broadcast by construction
        return lagged.join(F.broadcast(table), (F.col(self.t) >= F.col("t0")) & (F.col(self.t) < F.col("tn")))

    def _score(self, table: dict[tuple, np.ndarray], basis: Basis) -> float:
        return partition_contexts([table[k] for k in sorted(table)], self.alpha, bits=basis.bits)[0]

    def _search(self, rows: DataFrame, basis: Basis) -> None:
        """Greedy forward edges over all lags, then backward elimination; lag-0 edges must stay acyclic."""
        n, by, cache = len(self.nodes), [self.series, "regime"], {}
        whole = scoring.WholeGram(rows, self.columns, by, basis) if basis.additive else None  # one pass for the whole search

        def load(wanted):
            missing = sorted({(j, tuple(sorted(p))) for j, p in wanted} - set(cache))
            found = {c: whole.of(c) for c in missing} if whole else scoring.grams(rows, self.columns, by, missing, basis)
            cache.update({c: self._score(g, basis) for c, g in found.items()})

        score = lambda j, p: cache[j, tuple(sorted(p))]
        parents: dict[int, set[int]] = {j: {n + j} if self.max_lag else set() for j in range(n)}

        def cyclic(i: int, j: int) -> bool:
            stack = [i]
            while stack:
                k = stack.pop()
                if k == j:
                    return True
                stack += [p for p in parents[k] if p < n]
            return False

        while True:
            options = [(j, i) for j in range(n) for i in range(len(self.columns)) if i != j and i not in parents[j] and not (i < n and cyclic(i, j))]
            load([(j, parents[j] | extra) for j, i in options for extra in (set(), {i})])
            gains = [(score(j, parents[j]) - score(j, parents[j] | {i}), j, i) for j, i in options]
            gain, j, i = max(gains, default=(0.0, 0, 0))
            if insignificant(gain, self.alpha):
                break
            parents[j].add(i)
        for j in range(n):
            while len(parents[j]) > 1:
                load([(j, parents[j] - extra) for extra in [set(), *({p} for p in parents[j])]])
                loss, p = min((score(j, parents[j] - {p}) - score(j, parents[j]), p) for p in parents[j])
                if not insignificant(loss, self.alpha):
                    break
                parents[j].remove(p)
        self.parents = parents

    def _cuts(self, rows: DataFrame, basis: Basis, length: int) -> list[int]:
        """Changepoints of the nodes' likelihood under the mechanisms of the first stretch."""
        first = rows.where(F.col(self.t) < max(2 * self.min_duration, len(self.columns) + 2))
        grams = scoring.grams(first, self.columns, [], [(j, tuple(sorted(p))) for j, p in self.parents.items()], basis)
        weights = {}
        for (j, p), table in grams.items():
            g = table[()]
            a = g[:-1, :-1] + 1e-3 * g[0, 0] * np.diag([0.0, *np.ones(len(g) - 2)])
            w = np.linalg.lstsq(a, g[:-1, -1], rcond=1e-10)[0]
            rss = max(1e-9, float(g[-1, -1] - 2 * w @ g[:-1, -1] + w @ g[:-1, :-1] @ w))
            weights[j] = (p, w, math.sqrt(rss / g[0, 0]))
        columns, t, n = self.columns, self.t, len(self.nodes)

        def residuals(batches):
            for batch in batches:
                x = batch[columns].to_numpy(dtype=float)
                out = pd.DataFrame({"t": batch[t].to_numpy()})
                for j, (p, w, s) in weights.items():
                    out[f"r{j}"] = np.abs(x[:, j] - basis(x, p) @ w) / s
                yield out

        schema = ", ".join(["t long", *(f"r{j} double" for j in range(n))])
        steps = rows.mapInPandas(residuals, schema).groupBy("t").agg(*(F.avg(f"r{j}").alias(f"r{j}") for j in range(n)))
        least, penalty = self.min_duration, self.penalty

        def search(table: pd.DataFrame) -> pd.DataFrame:
            table = table.sort_values("t")
            ends = pelt(np.log1p(table.drop(columns="t").to_numpy()), least, penalty)
            at = table["t"].to_numpy()
            return pd.DataFrame({"cut": [int(at[e]) for e in ends[:-1]]})

        # one row per time step, whatever the number of contexts
        found = steps.groupBy().applyInPandas(search, "cut long").collect()
        return [0, *sorted(r["cut"] for r in found), length]

    def _regimes(self, lagged: DataFrame, spark, basis: Basis, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Windows get one regime if every node's mechanism agrees; neighbours of one regime are joined."""
        self.windows = [(a, b - a, k) for k, (a, b) in enumerate(spans)]
        rows = self._with_regimes(lagged, spark)
        tables = scoring.grams(rows, self.columns, ["window"], [(j, tuple(sorted(p))) for j, p in self.parents.items()], basis)
        labels = []
        for table in tables.values():
            names = sorted(table, key=lambda k: int(k[0]))
            per = dict(zip((int(k[0]) for k in names), partition_contexts([table[k] for k in names], self.alpha, bits=basis.bits)[1], strict=True))
            labels.append([per.get(k, -1) for k in range(len(spans))])
        known: dict[tuple, int] = {}
        out: list[tuple[int, int, int]] = []
        for (a, b), key in zip(spans, zip(*labels, strict=True), strict=True):
            regime = known.setdefault(key, len(known))
            if out and out[-1][2] == regime:
                out[-1] = (out[-1][0], b - out[-1][0], regime)
            else:
                out.append((a, b - a, regime))
        return out

    def edges(self, spark) -> DataFrame:
        """(child, parent, lag)."""
        n = len(self.nodes)
        rows = [(self.nodes[j], self.nodes[p % n], p // n) for j, ps in sorted(self.parents.items()) for p in sorted(ps)]
        return spark.createDataFrame(rows, "child string, parent string, lag int")

    def partition(self, spark) -> DataFrame:
        return spark.createDataFrame(self.windows, "begin long, duration long, regime int")
