"""Which members of an equivalence class need the fewest mechanism changes between environments.

Distinct (node, parents) mechanisms are tested once each, in one job, and the
tests are joined back to every graph of the class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions import independence as ci
from shiftscope.functions.mixed_graph import MixedGraph
from shiftscope.functions.scores import Basis
from shiftscope.operators import scoring
from shiftscope.plans.constraint import oracle_test, pc

Mechanism = tuple[int, tuple[int, ...]]
MOST = 400


def mechanisms(dags: list[MixedGraph]) -> list[Mechanism]:
    """Distinct (node, parents) of all graphs."""
    return sorted({(v, tuple(sorted(g.parents(v)))) for g in dags for v in range(g.n)})


def pair_p_values(df: DataFrame, cols: list[str], context: str, wanted: list[Mechanism], test: str = "linear", most: int = MOST) -> DataFrame:
    """(node, parents, c1, c2, p[, p_variance]): is each mechanism the same in each pair of environments?

    ``linear`` sees all rows through cross products; ``params`` gives two p values,
    of coefficients and of the residuals' variance, from the same; ``kci``, ``kcd``
    and ``residuals`` see about ``most`` rows of each environment.
    """
    spark = df.sparkSession
    if test in ("linear", "params"):
        candidates = [(v, ps) for v, ps in wanted]
        basis = Basis("lin", *scoring.column_stats(df, cols))
        tables = scoring.grams(df, cols, [context], candidates, basis)
        out = []
        for v, ps in wanted:
            cells = {k[0]: g for k, g in tables[v, ps].items()}
            for a, b in combinations(sorted(cells), 2):
                found = ci.linear_params_grams(cells[a], cells[b])[1]
                mean, variance = (found, 1.0) if test == "linear" else parameter_p_values(cells[a], cells[b])
                out.append((v, list(ps), a, b, float(mean), float(variance)))
        return spark.createDataFrame(out, "node int, parents array<int>, c1 string, c2 string, p double, p_variance double")
    rows = scoring.sampled(df.select(F.col(context).cast("string").alias("_ctx"), *cols), ["_ctx"], most)
    names = [r["_ctx"] for r in rows.select("_ctx").distinct().orderBy("_ctx").collect()]  # one row per environment
    pairs = spark.createDataFrame([(a, b, c) for a, b in combinations(names, 2) for c in (a, b)], "_c1 string, _c2 string, _ctx string")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        side = (part["_ctx"] == key[1]).to_numpy().astype(float)
        x = part[cols].to_numpy(dtype=float)
        out = []
        for v, ps in wanted:
            y, given = x[:, v], x[:, list(ps)]
            if not ps:
                p = ci.mmd(y[side < 0.5], y[side > 0.5])[1]
            elif test == "kci":
                p = ci.kci(y, side, given)[1]
            else:
                p = ci.PAIR_TESTS[test](given, y, side)[1]
            out.append((v, list(ps), key[0], key[1], float(p), 1.0))
        return pd.DataFrame(out, columns=["node", "parents", "c1", "c2", "p", "p_variance"])

    return rows.join(F.broadcast(pairs), "_ctx").groupBy("_c1", "_c2").applyInPandas(run, "node int, parents array<int>, c1 string, c2 string, p double, p_variance double")


def parameter_p_values(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """p values of equal coefficients (given one variance each) and of equal residual variances, from two groups' cross products."""
    from shiftscope.functions.numerics import chi2_sf

    def fit(g: np.ndarray) -> tuple[np.ndarray, float]:
        w = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]
        return w, max(1e-12, float(g[-1, -1] - 2 * w @ g[:-1, -1] + w @ g[:-1, :-1] @ w) / g[0, 0])

    (wa, va), (wb, vb) = fit(a), fit(b)
    gap = wa - wb
    spread = va * np.linalg.pinv(a[:-1, :-1]) + vb * np.linalg.pinv(b[:-1, :-1])
    means = chi2_sf(max(0.0, float(gap @ np.linalg.pinv(spread) @ gap)), len(gap))
    z2 = (np.log(va) - np.log(vb)) ** 2 / (2 / a[0, 0] + 2 / b[0, 0])
    return means, chi2_sf(float(z2), 1)


def pooled_p_values(df: DataFrame, cols: list[str], context: str, wanted: list[Mechanism], test: str = "fisherz", most: int = MOST) -> dict[Mechanism, float]:
    """One p value per mechanism: is the node independent of the environment's number given its parents?"""
    names = [r[0] for r in df.select(context).distinct().orderBy(context).collect()]  # one row per environment
    number = F.create_map(*[F.lit(x) for i, v in enumerate(names) for x in (v, float(i))])[F.col(context)]
    rows = df.withColumn("_e", number)
    if test == "fisherz":
        corr, n = scoring.correlation(rows, [*cols, "_e"])
        return {(v, ps): ci.fisher_z(corr, n, len(cols), v, ps)[1] for v, ps in wanted}
    if test != "kci":
        raise ValueError(f"unknown pooled test {test}")
    x = scoring.sampled(rows.select("_e", *cols), ["_e"], most).toPandas()
    e, x = x["_e"].to_numpy(dtype=float), x[cols].to_numpy(dtype=float)
    return {(v, ps): ci.kci(e, x[:, v], x[:, list(ps)] if ps else None)[1] for v, ps in wanted}


class MinimalShifts:
    """The graphs of a class with the fewest changes; ``mode``: pairwise, pooled or params."""

    def __init__(self, graph: MixedGraph, mode: str = "pairwise", test: str = "linear", alpha: float = 0.05, scaled: bool = True):
        self.dags, self.mode, self.test = graph.members(), mode, test
        self.alpha = alpha / graph.n if scaled else alpha
        self.n = graph.n

    def fit(self, df: DataFrame, cols: list[str], context: str) -> MinimalShifts:
        wanted = mechanisms(self.dags)
        if self.mode == "pooled":
            found = {m: [p] for m, p in pooled_p_values(df, cols, context, wanted, "kci" if self.test == "kci" else "fisherz").items()}
        else:
            rows = pair_p_values(df, cols, context, wanted, "params" if self.mode == "params" else self.test).toPandas()
            found = {m: [] for m in wanted}
            for r in rows.itertuples():
                key = (int(r.node), tuple(int(v) for v in r.parents))
                found[key] += [r.p, r.p_variance] if self.mode == "params" else [r.p]
        self.p_values = found
        return self

    def _of(self, dag: MixedGraph) -> np.ndarray:
        return np.array([p for v in range(self.n) for p in self.p_values[v, tuple(sorted(dag.parents(v)))]])

    def scores(self, soft: bool = False) -> np.ndarray:
        """Changes of every graph: p values under the level, or the sum of 1 - p."""
        return np.array([float((1 - self._of(g)).sum()) if soft else float((self._of(g) <= self.alpha).sum()) for g in self.dags])

    def best(self, soft: bool = False) -> list[MixedGraph]:
        s = self.scores(soft)
        return [g for g, v in zip(self.dags, s, strict=True) if v <= s.min() + 1e-12]

    def graph(self, soft: bool = False) -> MixedGraph:
        """The union of the best graphs: arrows that all of them have, other edges undirected."""
        return union_of(self.best(soft))


def union_of(dags: list[MixedGraph]) -> MixedGraph:
    arrows = set().union(*(g.directed for g in dags))
    both = {tuple(sorted(e)) for e in arrows if e[::-1] in arrows}
    return MixedGraph(dags[0].n, {e for e in arrows if tuple(sorted(e)) not in both}, (), both)


def shift_table(df: DataFrame, cols: list[str], context: str, dags: list[MixedGraph], test: str = "linear") -> DataFrame:
    """(dag, node, c1, c2, p) for every graph, each mechanism tested once."""
    spark = df.sparkSession
    tests = pair_p_values(df, cols, context, mechanisms(dags), test)
    table = spark.createDataFrame([(k, v, sorted(g.parents(v))) for k, g in enumerate(dags) for v in range(g.n)], "dag int, node int, parents array<int>")
    return F.broadcast(table).join(tests, ["node", "parents"]).select("dag", "node", "c1", "c2", "p")


def average_precision(true: MixedGraph, p_values: np.ndarray) -> float:
    """Area under precision and recall of the best graphs' arrows over all p thresholds; p values by graph of the true class, then anything."""
    dags = true.cpdag().members()
    p = np.asarray(p_values, dtype=float).reshape(len(dags), -1)
    points = []
    for t in np.unique(p):
        changes = (p <= t).sum(1)
        found = union_of([g for g, c in zip(dags, changes, strict=True) if c == changes.min()]).directed
        tp, fp = len(found & true.directed), len({e[::-1] for e in found} & true.directed)
        points.append((tp / max(1, len(true.directed)), tp / (tp + fp) if tp + fp else 1.0))
    recall = precision = 0.0
    out = 0.0
    for recall_, precision in sorted(points, key=lambda q: q[0]):
        out += (recall_ - recall) * precision
        recall = recall_
    return out


# --- with the true graph ------------------------------------------------------


def augmented(true: MixedGraph, targets: set[int]) -> MixedGraph:
    """The true graph with an environment node that points to the targets."""
    return MixedGraph(true.n + 1, true.directed | {(true.n, v) for v in targets})


def oracle_class(true: MixedGraph, targets: list[set[int]]) -> MixedGraph:
    """What pooled data can tell: the class of the graph with one environment node for the union of the targets."""
    every = set().union(*targets) if targets else set()
    n = true.n
    found = pc(n + 1, oracle_test(augmented(true, every)), 0.5, {(v, n) for v in range(n)})
    return MixedGraph(n, {e for e in found.directed if n not in e}, (), {e for e in found.undirected if n not in e})


def oracle_pairwise_class(true: MixedGraph, targets: list[set[int]]) -> MixedGraph:
    """What pairs of environments can tell: arrows of any pair's class, each pair with the symmetric difference of its targets."""
    classes = [oracle_class(true, [a ^ b]) for a, b in combinations(targets, 2)] or [true.cpdag()]
    arrows = set().union(*(c.directed for c in classes))
    return MixedGraph(true.n, arrows, (), {e for e in true.skeleton() if e not in arrows and e[::-1] not in arrows})


def oracle_minimal(true: MixedGraph, targets: list[set[int]]) -> list[MixedGraph]:
    """The graphs of the class with the fewest nodes that the environment is not separated from given their parents, over all pairs."""
    dags = true.cpdag().members()
    views = [augmented(true, a ^ b) for a, b in combinations(targets, 2)]
    counts = [sum(not view.separated(true.n, v, g.parents(v)) for view in views for v in range(true.n)) for g in dags]
    return [g for g, c in zip(dags, counts, strict=True) if c == min(counts)]
