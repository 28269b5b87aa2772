"""Greedy search over equivalence classes, and orders from interventions; both work from correlation matrices."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, combinations, permutations

import numpy as np

from shiftscope.functions.mixed_graph import MixedGraph
from shiftscope.functions.numerics import chi2_sf

Score = Callable[[int, tuple[int, ...]], float]


def gaussian_bic(corr: np.ndarray, n: int, penalty: float = 1.0) -> Score:
    """Local score of a node given parents (higher is better), remembered by its sorted arguments."""
    known: dict[tuple, float] = {}

    def score(node: int, parents: tuple[int, ...]) -> float:
        key = (node, tuple(sorted(parents)))
        if key not in known:
            ps = list(key[1])
            rest = corr[node, node] - (corr[node, ps] @ np.linalg.pinv(corr[np.ix_(ps, ps)]) @ corr[ps, node] if ps else 0.0)
            known[key] = -n / 2 * float(np.log(max(1e-12, rest))) - penalty * len(ps) / 2 * float(np.log(n))
        return known[key]

    return score


def _subsets(items: set[int]):
    items = sorted(items)
    return chain.from_iterable(combinations(items, k) for k in range(len(items) + 1))


def _dag_of(graph: MixedGraph) -> MixedGraph | None:
    """A DAG with the graph's edges, arrows and colliders, by removing sinks one after another."""
    left, directed, lines, out = set(range(graph.n)), set(graph.directed), set(graph.undirected), set(graph.directed)
    while left:
        for v in sorted(left):
            if any(a == v for a, _ in directed):
                continue
            near = {x for e in lines if v in e for x in e if x != v}
            adjacent = near | {a for a, b in directed if b == v}
            if all(graph.adjacent(x, y) for x in near for y in adjacent if x != y):
                out |= {(x, v) for x in near}
                directed = {e for e in directed if v not in e}
                lines = {e for e in lines if v not in e}
                left.discard(v)
                break
        else:
            return None
    return MixedGraph(graph.n, out)


def _clique(graph: MixedGraph, nodes: set[int]) -> bool:
    return all(graph.adjacent(a, b) for a, b in combinations(sorted(nodes), 2))


def _semi_path(graph: MixedGraph, start: int, goal: int, blocked: set[int]) -> bool:
    stack, seen = [start], {start}
    while stack:
        v = stack.pop()
        if v == goal:
            return True
        ahead = graph.children(v) | {x for e in graph.undirected if v in e for x in e if x != v}
        for w in ahead - seen - blocked:
            seen.add(w)
            stack.append(w)
    return False


def greedy_equivalence(n: int, score: Score) -> MixedGraph:
    """Best valid insertions, then best valid deletions, over completed partially directed graphs."""
    graph = MixedGraph(n)
    lines = lambda v: {x for e in graph.undirected if v in e for x in e if x != v}
    while True:
        best, move = 1e-9, None
        for x, y in permutations(range(n), 2):
            if graph.adjacent(x, y):
                continue
            beside = {v for v in lines(y) if graph.adjacent(v, x)}
            for t in map(set, _subsets({v for v in lines(y) if not graph.adjacent(v, x)})):
                if not _clique(graph, beside | t) or _semi_path(graph, y, x, beside | t):
                    continue
                base = beside | t | graph.parents(y)
                gain = score(y, tuple(base | {x})) - score(y, tuple(base))
                if gain > best:
                    best, move = gain, (x, y, t)
        if move is None:
            break
        x, y, t = move
        turned = MixedGraph(n, graph.directed | {(x, y)} | {(v, y) for v in t}, (), {e for e in graph.undirected if not (y in e and set(e) - {y} <= t)})
        dag = _dag_of(turned)
        if dag is None:
            break
        graph = dag.cpdag()
    while True:
        best, move = 1e-9, None
        for x, y in permutations(range(n), 2):
            if (x, y) not in graph.directed and tuple(sorted((x, y))) not in graph.undirected:
                continue
            beside = {v for v in lines(y) if graph.adjacent(v, x)} - {x}
            for h in map(set, _subsets(beside)):
                if not _clique(graph, beside - h):
                    continue
                base = (beside - h) | (graph.parents(y) - {x})
                gain = score(y, tuple(base)) - score(y, tuple(base | {x}))
                if gain > best:
                    best, move = gain, (x, y, h)
        if move is None:
            return graph
        x, y, h = move
        gone = {e for e in graph.undirected if set(e) == {x, y}}
        cut = {e for e in graph.undirected if (y in e and set(e) - {y} <= h) or (x in e and set(e) - {x} <= h)}
        arrows = (graph.directed - {(x, y), (y, x)}) | {(y, v) for v in h} | {(x, v) for v in h if tuple(sorted((x, v))) in graph.undirected}
        dag = _dag_of(MixedGraph(n, arrows, (), graph.undirected - gone - cut))
        if dag is None:
            return graph
        graph = dag.cpdag()


def changed_targets(base: np.ndarray, n_base: int, other: np.ndarray, n_other: int, graph: MixedGraph, alpha: float = 1e-3) -> set[int]:
    """Nodes whose linear mechanism given the graph's parents differs between two covariance matrices (likelihood ratio)."""
    out = set()
    for v in range(graph.n):
        ps = sorted(graph.parents(v))

        def loss(cov: np.ndarray, n: int, v=v, ps=ps) -> float:
            rest = cov[v, v] - (cov[v, ps] @ np.linalg.pinv(cov[np.ix_(ps, ps)]) @ cov[ps, v] if ps else 0.0)
            return n * float(np.log(max(1e-12, rest)))

        pooled = (n_base * base + n_other * other) / (n_base + n_other)
        if chi2_sf(max(0.0, loss(pooled, n_base + n_other) - loss(base, n_base) - loss(other, n_other)), len(ps) + 1) < alpha:
            out.add(v)
    return out


def latent_bic(x: np.ndarray, k_max: int = 3, seed: int = 42) -> Score:
    """Local score of a node given parents under the best mixture of regressions, remembered by its arguments."""
    from shiftscope.functions.mixture import latent_score

    known: dict[tuple, float] = {}

    def score(node: int, parents: tuple[int, ...]) -> float:
        key = (node, tuple(sorted(parents)))
        if key not in known:
            known[key] = latent_score(x[:, list(key[1])], x[:, node], k_max, seed)[0]
        return known[key]

    return score


def greedy_latent(x: np.ndarray, k_max: int = 3) -> tuple[MixedGraph, dict[int, np.ndarray]]:
    """Greedy search with the mixture score, and the hidden labels of each node given its parents and neighbours."""
    from shiftscope.functions.mixture import latent_score

    graph = greedy_equivalence(x.shape[1], latent_bic(x, k_max))
    near = lambda v: sorted(graph.parents(v) | {w for e in graph.undirected if v in e for w in e if w != v})
    return graph, {v: latent_score(x[:, near(v)], x[:, v], k_max)[1] for v in range(x.shape[1])}


def best_dag(n: int, score: Score) -> tuple[set[tuple[int, int]], float]:
    """The graph of the best total score, by dynamic programming over node sets: exact, for about a dozen nodes."""
    def best_parents(node: int, pool: tuple[int, ...]) -> tuple[float, tuple[int, ...]]:
        return max((score(node, s), s) for s in _subsets(set(pool)))

    table: dict[frozenset, tuple[float, set[tuple[int, int]]]] = {frozenset(): (0.0, set())}
    for size in range(1, n + 1):
        fresh = {}
        for nodes in map(frozenset, combinations(range(n), size)):
            options = []
            for v in nodes:
                rest = nodes - {v}
                value, ps = best_parents(v, tuple(sorted(rest)))
                total, edges = table[rest]
                options.append((total + value, -v, edges | {(p, v) for p in ps}))
            fresh[nodes] = max(options, key=lambda o: o[:2])
            fresh[nodes] = (fresh[nodes][0], fresh[nodes][2])
        table = {**{k: v for k, v in table.items() if len(k) == size - 1}, **fresh}
    total, edges = table[frozenset(range(n))]
    return edges, total


def flip_gain(score: Score, parents: dict[int, set[int]], a: int, b: int) -> float:
    """What turning the edge a -> b around adds to the total score."""
    now = score(b, tuple(parents[b])) + score(a, tuple(parents[a]))
    return score(b, tuple(parents[b] - {a})) + score(a, tuple(parents[a] | {b})) - now


def interventional_class(dag: MixedGraph, targets: list[set[int]]) -> MixedGraph:
    """The class of a DAG under interventions: edges between a target set and the rest are known too."""
    from shiftscope.functions.mixed_graph import orient

    known = {(a, b) for a, b in dag.directed for t in targets if (a in t) != (b in t)}
    colliders = {(a, v) for l, v, r in dag.v_structures() for a in (l, r)}
    return orient(dag.n, dag.skeleton(), known | colliders)


def per_component(moments: list[tuple[np.ndarray, np.ndarray]], counts: list[int], alpha: float = 0.05) -> list[MixedGraph]:
    """The PC graph of every component of a mixture, from its covariance and row count."""
    from shiftscope.functions.independence import fisher_z
    from shiftscope.plans.constraint import pc

    out = []
    for (_, cov), n in zip(moments, counts, strict=True):
        d = np.sqrt(np.maximum(1e-300, np.diag(cov)))
        corr = cov / np.outer(d, d)
        out.append(pc(len(cov), lambda x, y, z, corr=corr, n=n: fisher_z(corr, n, x, y, z)[1], alpha))
    return out


def component_targets(moments: list[tuple[np.ndarray, np.ndarray]], counts: list[int], observational: int = 0, alpha: float = 1e-3) -> tuple[MixedGraph, list[set[int]]]:
    """The observational component's graph, oriented further by what changes, and each component's targets.

    A node is a target if its mean or its linear mechanism given the graph's
    parents differs; the graph is that of the observational component.
    """
    mean, cov = moments[observational]
    d = np.sqrt(np.maximum(1e-300, np.diag(cov)))
    graph = greedy_equivalence(len(cov), gaussian_bic(cov / np.outer(d, d), counts[observational]))
    members = graph.members() or [graph]

    def found(dag: MixedGraph) -> list[set[int]]:
        out = []
        for k, (m, c) in enumerate(moments):
            if k == observational:
                out.append(set())
                continue
            targets = changed_targets(cov, counts[observational], c, counts[k], dag, alpha)
            for v in range(dag.n):
                ps = sorted(dag.parents(v))
                w = np.linalg.pinv(cov[np.ix_(ps, ps)]) @ cov[ps, v] if ps else np.zeros(0)
                rest = cov[v, v] - (w @ cov[ps, v] if ps else 0.0)
                gap = (m[v] - mean[v]) - (w @ (m[ps] - mean[ps]) if ps else 0.0)
                step = m[ps] - mean[ps]
                lever = step @ np.linalg.pinv(cov[np.ix_(ps, ps)]) @ step if ps else 0.0  # the weights are estimates
                z2 = gap**2 / (max(1e-12, rest) * ((1 + lever) / counts[observational] + 1 / counts[k]))
                if chi2_sf(float(z2), 1) < alpha:
                    targets.add(v)
            out.append(targets)
        return out

    best = min(members, key=lambda g: sum(map(len, found(g))))
    targets = found(best)
    return interventional_class(best, [t for t in targets if t]), targets
