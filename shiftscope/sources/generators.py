"""Seeded generators: graphs on the driver, rows as Spark tables (each row from its own seed)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from shiftscope.functions.changepoints import random_cuts, random_sequence

FORMS = {
    "lin": lambda x: x, "quad": lambda x: x * x, "cub": lambda x: x**3, "exp": lambda x: np.exp(np.clip(x, -4, 3)), "log": lambda x: np.log1p(np.abs(x)) * np.sign(x),
    "sin": np.sin, "tanh": np.tanh, "sinc": np.sinc,
}


def random_dag(nodes: int, p: float, seed: int) -> set[tuple[int, int]]:
    """Edges along a random order, each with probability p."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(nodes)
    return {(int(order[i]), int(order[j])) for j in range(nodes) for i in range(j) if rng.random() < p}


def scale_free_dag(nodes: int, links: int, seed: int) -> set[tuple[int, int]]:
    """Preferential attachment, directed from old to new."""
    rng, ends, out = np.random.default_rng(seed), [0], set()
    for v in range(1, nodes):
        for u in {int(rng.choice(ends)) for _ in range(min(links, v))}:
            out.add((u, v))
            ends += [u, v]
    return out


def chain(nodes: int) -> set[tuple[int, int]]:
    return {(i, i + 1) for i in range(nodes - 1)}


def fan(nodes: int) -> set[tuple[int, int]]:
    return {(0, i) for i in range(1, nodes)}


def order_of(edges: set[tuple[int, int]], nodes: int) -> list[int]:
    out: list[int] = []
    while len(out) < nodes:
        out.append(next(v for v in range(nodes) if v not in out and all(a in out for a, b in edges if b == v)))
    return out


def mechanism_labels(nodes: int, contexts: int, shifts: int, seed: int) -> dict[int, list[int]]:
    """Per node a label for each context: 0 but for ``shifts`` contexts with labels of their own."""
    rng, out = np.random.default_rng((seed, 1)), {}
    for v in range(nodes):
        labels = [0] * contexts
        for k, c in enumerate(rng.choice(np.arange(1, contexts), min(shifts, contexts - 1), replace=False) if contexts > 1 else []):
            labels[int(c)] = k + 1
        out[v] = labels
    return out


def context_rows(spark: SparkSession, edges: set[tuple[int, int]], nodes: int, contexts: int, rows: int, seed: int, labels: dict[int, list[int]] | None = None, form: str = "lin", noise: float = 1.0, confounders: dict[int, tuple[list[int], list[int]]] = {}) -> DataFrame:
    """(context, row_id, x0..): weights redrawn per mechanism label; a confounder (nodes, labels by context) adds a shared shift.

    Rows are generated where they are, in blocks with seeds of their own.
    """
    labels = labels or {v: [0] * contexts for v in range(nodes)}
    order, parents = order_of(edges, nodes), {v: sorted(a for a, b in edges if b == v) for v in range(nodes)}
    f, block = FORMS[form], 1000

    def weight(v: int, p: int, label: int) -> float:
        rng = np.random.default_rng((seed, v, p, label))
        return float(rng.uniform(0.6, 2.0) * rng.choice([-1, 1]))

    def make(batches):
        for batch in batches:
            for c, b in zip(batch["context"], batch["block"], strict=True):
                n = min(block, rows - b * block)
                rng = np.random.default_rng((seed, 7, int(c), int(b)))
                x = np.zeros((n, nodes))
                hidden = {k: rng.normal(2.0 * zl[int(c)], 1, n) for k, (_, zl) in confounders.items()}
                for v in order:
                    label = labels[v][int(c)]
                    shift = 0.0 if parents[v] else float(np.random.default_rng((seed, v, label)).normal(0, 2)) * (label > 0)
                    x[:, v] = shift + noise * rng.normal(size=n) + sum(weight(v, p, label) * f(x[:, p]) for p in parents[v])
                    x[:, v] += sum(hidden[k] for k, (vs, _) in confounders.items() if v in vs)
                out = pd.DataFrame(x, columns=[f"x{i}" for i in range(nodes)])
                out.insert(0, "row_id", np.arange(n) + int(b) * block)
                out.insert(0, "context", int(c))
                yield out

    blocks = [(c, b) for c in range(contexts) for b in range(-(-rows // block))]
    schema = ", ".join(["context int", "row_id long", *(f"x{i} double" for i in range(nodes))])
    return spark.createDataFrame(blocks, "context int, block int").mapInPandas(make, schema)


def time_series(spark: SparkSession, links: set[tuple[int, int, int]], nodes: int, contexts: int, length: int, regimes: int, parts: int, least: int, seed: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """((context, t, x0..), true partition): links are (child, parent, lag); weights differ by regime."""
    rng = np.random.default_rng(seed)
    cuts, names = random_cuts(length, parts, least, rng), random_sequence(regimes, parts, rng)
    partition = [(a, b - a, r) for a, b, r in zip(cuts[:-1], cuts[1:], names, strict=True)]
    regime = np.repeat(names, np.diff(cuts))
    instant = order_of({(p, c) for c, p, k in links if k == 0 and p != c}, nodes)

    def weight(c: int, p: int, k: int, r: int) -> float:
        g = np.random.default_rng((seed, c, p, k, r))
        return float(g.uniform(0.3, 0.8) * g.choice([-1, 1])) if (c, k) != (p, 1) else 0.3

    def make(batches):
        for batch in batches:
            for c in batch["context"]:
                g = np.random.default_rng((seed, 5, int(c)))
                x = g.normal(size=(length, nodes))
                for t in range(length):
                    for v in instant:
                        x[t, v] += sum(weight(a, p, k, int(regime[t])) * x[t - k, p] for a, p, k in links if a == v and t >= k)
                out = pd.DataFrame(x, columns=[f"x{i}" for i in range(nodes)])
                out.insert(0, "t", np.arange(length))
                out.insert(0, "context", int(c))
                yield out

    schema = ", ".join(["context int", "t long", *(f"x{i} double" for i in range(nodes))])
    return spark.createDataFrame([(c,) for c in range(contexts)], "context int").mapInPandas(make, schema), partition


def mixed_rows(spark: SparkSession, rows: int, populations: int, seed: int, noise: float = 0.3) -> DataFrame:
    """(row_id, x0, x1, x2, label): x1 and x2 depend on x0 with slopes of a hidden population."""

    def make(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            g = [np.random.default_rng((seed, int(i))) for i in ids]
            label = np.array([r.integers(populations) for r in g])
            z = np.array([r.normal(size=3) for r in g]).reshape(-1, 3)
            slope = np.linspace(-2, 2, populations)[label]
            yield pd.DataFrame({"row_id": ids, "x0": z[:, 0], "x1": slope * z[:, 0] + noise * z[:, 1] + 2 * slope, "x2": -slope * z[:, 0] + noise * z[:, 2] - slope, "label": label})

    return spark.range(rows).mapInPandas(make, "row_id long, x0 double, x1 double, x2 double, label int")


# --- structures ---------------------------------------------------------------


def complete_dag(nodes: int) -> set[tuple[int, int]]:
    return {(i, j) for j in range(nodes) for i in range(j)}


def connected_dag(nodes: int, p: float, seed: int) -> set[tuple[int, int]]:
    """A ring of nearest neighbours whose edges are rewired with a chance that keeps it connected, directed along a random order."""
    rng = np.random.default_rng(seed)
    near = max(2, int(round(p * (nodes - 1))) // 2 * 2)
    place = rng.permutation(nodes)
    edges = set()
    for i in range(nodes):
        for k in range(1, near // 2 + 1):
            j = (i + k) % nodes
            if k > 1 and rng.random() < p:  # the ring itself stays
                j = int(rng.integers(nodes))
            if i != j:
                edges.add(tuple(sorted((int(i), int(j)))))
    return {(a, b) if place[a] < place[b] else (b, a) for a, b in edges}


def pair_structure(kind: str) -> set[tuple[int, int]]:
    """Two nodes: causal, anticausal or none."""
    return {"causal": {(0, 1)}, "anticausal": {(1, 0)}, "none": set()}[kind]


def confounded_sets(nodes: int, sets: int, seed: int, least: int = 2) -> list[list[int]]:
    """Disjoint random node sets of ``least`` or more nodes each."""
    rng = np.random.default_rng(seed)
    order, out, at = rng.permutation(nodes), [], 0
    for k in range(sets):
        room = nodes - at - least * (sets - k - 1)
        size = int(rng.integers(least, max(least, room) + 1))
        if at + size > nodes:
            raise ValueError("too many sets for the nodes")
        out.append(sorted(int(v) for v in order[at : at + size]))
        at += size
    return out


def shift_counts(nodes: int, most: int, seed: int, exact: bool = False) -> list[int]:
    """How many contexts shift each node: exactly ``most``, or up to it."""
    rng = np.random.default_rng((seed, 2))
    return [most if exact else int(rng.integers(0, most + 1)) for _ in range(nodes)]


def atomic_targets(nodes: int, contexts: int, seed: int) -> dict[int, list[int]]:
    """One target per context but the first, drawn without repeats while there are nodes left."""
    rng, out, pool = np.random.default_rng((seed, 3)), {0: []}, []
    for c in range(1, contexts):
        pool = pool or list(rng.permutation(nodes))
        out[c] = [int(pool.pop())]
    return out


def label_targets(structure: str, nodes: int, seed: int = 0, sets: int = 1) -> list[list[int]]:
    """Nodes that each hidden label shifts: x, y, both, independent (one label each), none, or random sets."""
    fixed = {"x": [[0]], "y": [[1]], "both": [[0, 1]], "independent": [[0], [1]], "none": []}
    return fixed[structure] if structure in fixed else confounded_sets(nodes, sets, seed)


def separated_coefficients(labels: list[int], seed: int) -> dict[int, float]:
    """Per label a coefficient, each at least 0.5 beyond the one before."""
    steps = np.random.default_rng(seed).uniform(0.5, 2.5, max(labels) + 1)
    return {k: float(v) for k, v in enumerate(np.cumsum(steps))}


def random_function(x: np.ndarray, seed: int, width: float = 1.0, features: int = 200) -> np.ndarray:
    """A draw of a smooth random function at these rows; the same seed gives the same function anywhere."""
    rng = np.random.default_rng((seed, 9))
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    w, b, a = rng.normal(size=(x.shape[1], features)) / width, rng.uniform(0, 2 * np.pi, features), rng.normal(size=features)
    return np.sqrt(2 / features) * np.cos(x @ w + b) @ a


def lagged_graph(nodes: int, edges: int, max_lag: int, seed: int, changed: int = 0, regimes: int = 1) -> tuple[set[tuple[int, int, int]], dict[int, set[tuple[int, int, int]]]]:
    """Links (child, parent, lag), instantaneous ones acyclic and each node on its own past, and the links whose weights each regime changes."""
    rng = np.random.default_rng((seed, 4))
    order = rng.permutation(nodes)
    rank = {int(v): k for k, v in enumerate(order)}
    options = [(c, p, k) for c in range(nodes) for p in range(nodes) for k in range(max_lag + 1) if c != p and (k or rank[p] < rank[c])]
    picked = {options[i] for i in rng.choice(len(options), min(edges, len(options)), replace=False)}
    moves = {r: {sorted(picked)[i] for i in rng.choice(len(picked), min(changed, len(picked)), replace=False)} for r in range(1, regimes)} if picked else {}
    return picked | {(v, v, 1) for v in range(nodes)}, moves


def links_of(links: set[tuple[int, int, int]], seed: int, form: str = "lin") -> dict[int, list[tuple[tuple[int, int], float, str]]]:
    """Links by child as ((parent, -lag), weight, form)."""
    out: dict[int, list] = {}
    for c, p, k in sorted(links):
        w = np.random.default_rng((seed, c, p, k)).uniform(0.3, 0.8)
        out.setdefault(c, []).append(((p, -k), float(w), form))
    return out


# --- rows ---------------------------------------------------------------------


def linear_model(nodes: int, seed: int, p: float = 0.5, low: float = 0.5, high: float = 2.0) -> np.ndarray:
    """Weights, lower triangular, [child, parent]; entries are zero with chance 1 - p and away from zero else."""
    rng = np.random.default_rng(seed)
    w = rng.uniform(low, high, (nodes, nodes)) * rng.choice([-1, 1], (nodes, nodes)) * (rng.random((nodes, nodes)) < p)
    return np.tril(w, -1)


def interventional_mixture(spark: SparkSession, weights: np.ndarray, targets: list[list[int]], rows: int, seed: int, kind: str = "do", mean: float = 2.0, deviation: float = 1.0, noise: str = "gaussian") -> DataFrame:
    """(row_id, component, x0..): equal parts without and with an intervention on each target set.

    ``kind``: do (the value itself is drawn anew), soft (the noise is shifted) or
    hard (parents are cut, noise as before); ``noise``: gaussian or gamma.
    """
    n = len(weights)

    def make(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            component = ids % (len(targets) + 1)
            e = np.stack([np.random.default_rng((seed, int(i))).normal(size=n) if noise == "gaussian" else np.random.default_rng((seed, int(i))).gamma(2.0, 1.0, n) - 2.0 for i in ids])
            x = np.zeros_like(e)
            for v in range(n):
                hit = np.array([c > 0 and v in targets[c - 1] for c in component])
                value = x @ weights[v] + e[:, v]
                new = {"do": mean + deviation * e[:, v], "soft": value + mean, "hard": e[:, v]}[kind]
                x[:, v] = np.where(hit, new, value)
            out = pd.DataFrame(x, columns=[f"x{i}" for i in range(n)])
            out.insert(0, "component", component)
            out.insert(0, "row_id", ids)
            yield out

    schema = ", ".join(["row_id long", "component int", *(f"x{i} double" for i in range(n))])
    return spark.range(rows).mapInPandas(make, schema)


def structural_rows(spark: SparkSession, edges: set[tuple[int, int]], nodes: int, contexts: int, rows: int, seed: int, targets: dict[int, list[int]] | None = None, kind: str = "soft", form: str = "tanh", dof: float = 2.0) -> DataFrame:
    """(context, row_id, x0..) with heavy-tailed noise; a context's targets get another mechanism.

    ``kind``: soft (new weights), hard (noise alone), scale (noise times three),
    shift (noise plus two), domain (a new random function of the parents).
    """
    order, parents = order_of(edges, nodes), {v: sorted(a for a, b in edges if b == v) for v in range(nodes)}
    targets = targets or {}
    f, block = FORMS.get(form), 1000

    def weight(v: int, p: int, c: int) -> float:
        return float(np.random.default_rng((seed, v, p, c)).uniform(0.5, 2.0) * np.random.default_rng((seed, v, p, c, 1)).choice([-1, 1]))

    def make(batches):
        for batch in batches:
            for c, b in zip(batch["context"], batch["block"], strict=True):
                c, b = int(c), int(b)
                n = min(block, rows - b * block)
                rng = np.random.default_rng((seed, 11, c, b))
                x = np.zeros((n, nodes))
                for v in order:
                    hit = v in targets.get(c, [])
                    e = rng.standard_t(dof, n) if dof else rng.normal(size=n)
                    e = e * 3 if hit and kind == "scale" else e + 2 if hit and kind == "shift" else e
                    if parents[v] and not (hit and kind == "hard"):
                        setting = c if hit and kind in ("soft", "domain") else 0
                        if kind == "domain":
                            x[:, v] = random_function(np.clip(x[:, parents[v]], -5, 5), 1000 * seed + 31 * v + setting) * 2
                        else:
                            x[:, v] = sum(weight(v, p, setting) * f(x[:, p]) for p in parents[v])
                    x[:, v] += e
                out = pd.DataFrame(x, columns=[f"x{i}" for i in range(nodes)])
                out.insert(0, "row_id", np.arange(n) + b * block)
                out.insert(0, "context", c)
                yield out

    blocks = [(c, b) for c in range(contexts) for b in range(-(-rows // block))]
    schema = ", ".join(["context int", "row_id long", *(f"x{i} double" for i in range(nodes))])
    return spark.createDataFrame(blocks, "context int, block int").mapInPandas(make, schema)


def independence_rows(spark: SparkSession, rows: int, seed: int, kind: str = "collider", form: str = "tanh", noise: float = 0.5) -> DataFrame:
    """(row_id, x, y, z): z causes both (fork), x causes y through z (chain), both cause z (collider), or x causes y beside z (direct)."""
    f = FORMS[form]

    def make(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            a, b, c = np.stack([np.random.default_rng((seed, int(i))).normal(size=3) for i in ids]).T
            if kind == "fork":
                z, x, y = a, f(a) + noise * b, f(a) + noise * c
            elif kind == "chain":
                x, z = a, f(a) + noise * b
                y = f(z) + noise * c
            elif kind == "collider":
                x, y, z = a, b, f(a) + f(b) + noise * c
            elif kind == "direct":
                z, x = a, f(a) + noise * b
                y = f(a) + f(x) + noise * c
            else:
                raise ValueError(f"unknown model {kind}")
            yield pd.DataFrame({"row_id": ids, "x": x, "y": y, "z": z})

    return spark.range(rows).mapInPandas(make, "row_id long, x double, y double, z double")


def checked_shape(df: DataFrame, nodes: int, rows: int) -> DataFrame:
    """The same table; raises if it has other columns or another number of rows than the generator promised."""
    missing = [f"x{i}" for i in range(nodes) if f"x{i}" not in df.columns]
    if missing or df.count() != rows:
        raise ValueError(f"generated table lacks {missing or 'rows'}")
    return df
