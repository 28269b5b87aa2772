"""Topological discovery over one or many contexts.

The order of the nodes grows from the sources: a source is the node that others
explain least compared with how it explains them.  With an additive basis all
scores come from one pass over the rows (see ``operators.scoring``); random
features take a pass per round.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from shiftscope.functions.numerics import insignificant
from shiftscope.functions.scores import Basis, partition_contexts
from shiftscope.operators import scoring
from shiftscope.operators.labels import intervention_targets


@dataclass
class Topological:
    """``kind``: the basis (lin, cub, spline, rff, gp).  ``context``: a column, or None for one population."""

    nodes: list[str]
    context: str | None = None
    kind: str = "spline"
    alpha: float = 0.05
    greedy_groups: bool = False
    threshold: float = 0.0
    exhaustive: bool = False  # the best of all parent subsets at the end, not one parent dropped at a time
    order: list[int] = field(default_factory=list)
    parents: dict[int, set[int]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Topological:
        by = [self.context] if self.context else []
        self._rows, self._by = df.select(*by, *self.nodes), by
        self._basis = Basis(self.kind, *scoring.column_stats(df, self.nodes))
        self._whole = scoring.WholeGram(self._rows, self.nodes, by, self._basis) if self._basis.additive else None
        return self.search()

    def search(self) -> Topological:
        self._grams: dict[scoring.Candidate, dict[tuple, np.ndarray]] = {}
        self.parents = {i: set() for i in range(len(self.nodes))}
        left = list(range(len(self.nodes)))
        self.order = []
        while left:
            source = self._next(left)
            left.remove(source)
            self.order.append(source)
            self._load([(j, self.parents[j] | extra) for j in left for extra in (set(), {source})])
            for j in left:
                if self.gain(j, source) > self.threshold and not insignificant(self.gain(j, source), self.alpha):
                    self.parents[j].add(source)
            self._refine(source)
        for node in self.order:
            self._subsets(node)
        return self

    def score(self, node: int, parents: set[int]) -> float:
        return self._partition(node, parents)[0]

    def gain(self, node: int, parent: int) -> float:
        return self.score(node, self.parents[node] - {parent}) - self.score(node, self.parents[node] | {parent})

    def _load(self, wanted: list[tuple[int, set[int]]]) -> None:
        missing = sorted({(n, tuple(sorted(p))) for n, p in wanted} - set(self._grams))
        if self._whole is not None:  # all scores come from the one pass that ``fit`` has made
            self._grams |= {c: self._whole.of(c) for c in missing}
        else:
            self._grams |= scoring.grams(self._rows, self.nodes, self._by, missing, self._basis)

    def _partition(self, node: int, parents: set[int]) -> tuple[float, dict[str, int]]:
        key = (node, tuple(sorted(parents)))
        if key not in self._grams:
            self._load([(node, parents)])
        table = self._grams[key]
        names = sorted(table)
        total, labels = partition_contexts([table[k] for k in names], self.alpha, self.greedy_groups, self._basis.bits)
        return total, {"" if not k else k[0]: label for k, label in zip(names, labels, strict=True)}

    def _next(self, left: list[int]) -> int:
        if len(left) == 1:
            return left[0]
        self._load([(j, self.parents[j] | extra) for j in left for extra in [set(), *({i} for i in left if i != j)]])
        gain = np.array([[self.gain(j, i) if i != j else 0.0 for j in left] for i in left])  # of i as a parent of j
        return left[int((gain.T - gain).max(axis=1, initial=-np.inf, where=~np.eye(len(left), dtype=bool)).argmin())]

    def _refine(self, node: int) -> None:
        """Drop parents while the score falls by less than a significant gain."""
        while len(self.parents[node]) > 1:
            self._load([(node, self.parents[node] - {p}) for p in self.parents[node]])
            gain, parent = min((self.gain(node, p), p) for p in self.parents[node])
            if gain > self.threshold and not insignificant(gain, self.alpha):
                return
            self.parents[node].remove(parent)

    def _subsets(self, node: int) -> None:
        """The smallest subset of the parents that is not significantly worse, one parent dropped at a time (or the one with the best score of all)."""
        if self.exhaustive:
            subsets = [set(s) for k in range(len(self.parents[node]) + 1) for s in combinations(sorted(self.parents[node]), k)]
            self._load([(node, s) for s in subsets])
            self.parents[node] = min(subsets, key=lambda s: (self.score(node, s), len(s)))
            return
        self._refine(node)
        if len(self.parents[node]) == 1:
            (p,) = self.parents[node]
            if insignificant(self.gain(node, p), self.alpha):
                self.parents[node] = set()

    def edges(self, spark) -> DataFrame:
        rows = [(0, self.nodes[p], self.nodes[n]) for n, ps in self.parents.items() for p in sorted(ps)]
        return spark.createDataFrame(rows, "graph int, src string, dst string")

    def changes(self, spark) -> DataFrame:
        """(node, context, label): contexts of a node with one label share its mechanism."""
        rows = [(self.nodes[n], c, label) for n in self.parents for c, label in sorted(self._partition(n, self.parents[n])[1].items())]
        return spark.createDataFrame(rows, "node string, context string, label int")

    def targets(self, spark) -> DataFrame:
        return intervention_targets(self.changes(spark))
