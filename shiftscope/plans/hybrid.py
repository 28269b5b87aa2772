"""Lagged graphs whose every mechanism has changepoints of its own.

One pass over the rows gives the cross products of all lagged columns for every
context and cell of a time grid.  A candidate (child, parents) is scored under its
best segmentation of the grid: a dynamic program over the cells, in which a segment's
bits are those of its contexts grouped by mechanism, from sums of the cells' matrices.
Edges are added while they save bits, then lags are exchanged and parents dropped, and
each child keeps the cuts of its final parents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.numerics import insignificant
from shiftscope.functions.scores import Basis, partition_contexts
from shiftscope.operators import regimes, scoring


@dataclass
class HybridLagged:
    """``grain``: steps of a grid cell, on whose borders cuts lie; ``min_duration``: least steps of a segment."""

    nodes: list[str]
    series: str = "context"
    t: str = "t"
    max_lag: int = 1
    grain: int = 20
    min_duration: int = 20
    kind: str = "lin"
    alpha: float = 0.05
    parents: dict[int, set[int]] = field(default_factory=dict)
    cuts: dict[int, list[int]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> HybridLagged:
        lagged = regimes.lag_features(df.select(self.series, self.t, *self.nodes), [self.series], self.t, {n: list(range(1, self.max_lag + 1)) for n in self.nodes})
        self.columns = [*self.nodes, *(f"{n}_lag{k}" for k in range(1, self.max_lag + 1) for n in self.nodes)]
        self._basis = Basis(self.kind, *scoring.column_stats(lagged, self.columns))
        if not self._basis.additive:
            raise ValueError("cells of a grid need an additive basis")
        rows = lagged.withColumn("_cell", F.floor(F.col(self.t) / self.grain))
        self._whole = scoring.WholeGram(rows, self.columns, [self.series, "_cell"], self._basis)
        self._names = sorted({k[0] for k in self._whole.tables})
        self._cells = max((int(k[1]) for k in self._whole.tables), default=-1) + 1
        self._length = int(df.agg(F.max(self.t)).first()[0] or 0) + 1
        self._found: dict[tuple[int, frozenset[int]], tuple[float, list[int]]] = {}
        self._search()
        return self

    def score(self, child: int, parents: set[int]) -> tuple[float, list[int]]:
        """Bits of the child under its best segmentation, and the cuts in steps."""
        key = (child, frozenset(parents))
        if key not in self._found:
            self._found[key] = self._segmented(child, tuple(sorted(parents)))
        return self._found[key]

    def _segmented(self, child: int, parents: tuple[int, ...]) -> tuple[float, list[int]]:
        table, m = self._whole.of((child, parents)), self._cells
        if not table:
            return 0.0, []
        size = next(iter(table.values())).shape[0]
        sums = np.zeros((len(self._names), m + 1, size, size))
        for (name, cell), g in table.items():
            sums[self._names.index(name), int(cell) + 1] = g
        sums = sums.cumsum(1)
        least = max(1, -(-self.min_duration // self.grain))
        best, back = [0.0] + [np.inf] * m, [0] * (m + 1)
        for b in range(1, m + 1):
            for a in range(b):
                if b - a < least and not (a == 0 and b == m):
                    continue
                parts = [g for g in sums[:, b] - sums[:, a] if g[0, 0] > 0.5]
                value = best[a] + (partition_contexts(parts, self.alpha, bits=self._basis.bits)[0] if parts else 0.0)
                if value < best[b]:
                    best[b], back[b] = value, a
        cuts, at = [], m
        while at > 0:
            at = back[at]
            cuts.append(at * self.grain)
        return best[m], sorted(c for c in cuts if c)

    def _cyclic(self, i: int, j: int) -> bool:
        """Whether j reaches i without a lag, so that an edge from i to j would close a cycle."""
        stack = [i]
        while stack:
            k = stack.pop()
            if k == j:
                return True
            stack += [p for p in self.parents[k] if p < len(self.nodes)]
        return False

    def _allowed(self, i: int, j: int) -> bool:
        return i != j and i not in self.parents[j] and not (i < len(self.nodes) and self._cyclic(i, j))

    def _search(self) -> None:
        n = len(self.nodes)
        self.parents = {j: set() for j in range(n)}
        bits = lambda j, ps: self.score(j, ps)[0]
        while True:
            options = [(bits(j, self.parents[j]) - bits(j, self.parents[j] | {i}), j, i) for j in range(n) for i in range(len(self.columns)) if self._allowed(i, j)]
            gain, j, i = max(options, default=(0.0, 0, 0))
            if insignificant(gain, self.alpha):
                break
            self.parents[j].add(i)
        for j in range(n):
            self._refine_lags(j)
            self._refine_parents(j)
        self.cuts = {j: self.score(j, self.parents[j])[1] for j in range(n)}

    def _refine_lags(self, j: int) -> None:
        """Exchange a parent's lag for another one while that saves bits."""
        n = len(self.nodes)
        while True:
            now, options = self.score(j, self.parents[j])[0], []
            for p in sorted(self.parents[j]):
                self.parents[j].remove(p)
                options += [(self.score(j, self.parents[j] | {q})[0], p, q) for q in range(p % n, len(self.columns), n) if q != p and self._allowed(q, j)]
                self.parents[j].add(p)
            value, p, q = min(options, default=(now, 0, 0))
            if value >= now - 1e-9:
                return
            self.parents[j] = self.parents[j] - {p} | {q}

    def _refine_parents(self, j: int) -> None:
        """Drop parents while the loss is insignificant."""
        while self.parents[j]:
            now = self.score(j, self.parents[j])[0]
            loss, p = min((self.score(j, self.parents[j] - {p})[0] - now, p) for p in self.parents[j])
            if not insignificant(loss, self.alpha):
                return
            self.parents[j].remove(p)

    def edges(self, spark) -> DataFrame:
        """(child, parent, lag)."""
        n = len(self.nodes)
        rows = [(self.nodes[j], self.nodes[p % n], p // n) for j, ps in sorted(self.parents.items()) for p in sorted(ps)]
        return spark.createDataFrame(rows, "child string, parent string, lag int")

    def segments(self, spark) -> DataFrame:
        """(child, begin, end, bits): the child's own segments, and its bits under them."""
        rows = []
        for j, cuts in self.cuts.items():
            marks = [0, *cuts, self._length]
            rows += [(self.nodes[j], int(a), int(b), float(self.score(j, self.parents[j])[0])) for a, b in zip(marks[:-1], marks[1:], strict=True)]
        return spark.createDataFrame(rows, "child string, begin long, end long, bits double")
