"""Constraint-based search: the correlation matrix (or a bounded sample) comes from one job, the rest is small."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions import independence as ci, partial_ancestral
from shiftscope.functions.mixed_graph import MixedGraph, orient
from shiftscope.functions.numerics import chi2_sf
from shiftscope.operators import graphs, labels, scoring
from shiftscope.operators.moments import one_hot

Test = Callable[[int, int, tuple[int, ...]], float]


def ci_test(df: DataFrame, cols: list[str], kind: str = "fisherz", most: int = 500, seed: int = 0) -> Test:
    """p value of x and y given z, by column numbers.

    ``fisherz`` uses all rows through their cross products, ``gsq`` (discrete columns)
    through their counts; ``kci`` and ``cmi`` use a hash sample of about ``most`` rows.
    """
    if kind == "fisherz":
        corr, n = scoring.correlation(df, cols)
        return lambda x, y, z: ci.fisher_z(corr, n, x, y, z)[1]
    if kind == "gsq":
        counts = graphs.settled(df.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")))
        levels = counts.agg(*(F.countDistinct(c) for c in cols)).first()

        def g_square(x: int, y: int, z: tuple[int, ...]) -> float:
            stat, strata, n = labels.g2_of_counts(counts, cols[x], cols[y], [cols[c] for c in z])
            dof = (levels[x] - 1) * (levels[y] - 1) * strata
            return 1.0 if dof <= 0 or n < 10 * dof else chi2_sf(stat, dof)

        return g_square
    rows = scoring.sampled(df.select(*cols).withColumn("_g", F.lit(0)), ["_g"], most, seed).drop("_g").toPandas()[cols].to_numpy()
    pick = lambda z: rows[:, list(z)] if z else None
    if kind == "kci":
        return lambda x, y, z: ci.kci(rows[:, [x]], rows[:, [y]], pick(z))[1]
    if kind == "cmi":
        return lambda x, y, z: ci.cmi_permutation(rows[:, [x]], rows[:, [y]], pick(z))[1]
    raise ValueError(f"unknown test {kind}")


def oracle_test(graph: MixedGraph) -> Test:
    return lambda x, y, z: float(graph.separated(x, y, z))


def skeleton(n: int, test: Test, alpha: float = 0.05, most: int | None = None, forbidden: set[tuple[int, int]] = frozenset(), method: str = "neighbours") -> tuple[set[tuple[int, int]], dict]:
    """Order-independent skeleton and separating sets; candidates are neighbours or all other nodes."""
    near = {v: {w for w in range(n) if w != v and (min(v, w), max(v, w)) not in forbidden} for v in range(n)}
    apart: dict[tuple[int, int], set[int]] = {p: set() for p in forbidden}
    size = 0
    while most is None or size <= most:
        frozen, tested = {v: set(ws) for v, ws in near.items()}, False
        for x, y in combinations(range(n), 2):
            if y not in near[x]:
                continue
            for pool in ({"neighbours": [frozen[x] - {y}, frozen[y] - {x}], "complete": [set(range(n)) - {x, y}]}[method]):
                found = False
                for z in combinations(sorted(pool), size):
                    tested = True
                    if test(x, y, z) > alpha:
                        near[x].discard(y)
                        near[y].discard(x)
                        apart[x, y] = set(z)
                        found = True
                        break
                if found:
                    break
        if not tested:
            break
        size += 1
    return {(v, w) for v in near for w in near[v] if v < w}, apart


def pc(n: int, test: Test, alpha: float = 0.05, forbidden_arrows: set[tuple[int, int]] = frozenset(), forbidden: set[tuple[int, int]] = frozenset()) -> MixedGraph:
    """Skeleton, colliders, rules; ``forbidden_arrows`` (x, y) are directed the other way where present."""
    edges, apart = skeleton(n, test, alpha, forbidden=forbidden)
    near = {v: {w for e in edges if v in e for w in e if w != v} for v in range(n)}
    arrows = {(y, x) for x, y in forbidden_arrows if (min(x, y), max(x, y)) in edges and (y, x) not in forbidden_arrows}
    for v in range(n):
        for a, b in combinations(sorted(near[v]), 2):
            if b not in near[a] and v not in apart.get((a, b), set()):
                for w in (a, b):
                    if (v, w) not in arrows and (w, v) not in forbidden_arrows:
                        arrows.add((w, v))
    return orient(n, edges, arrows)


def discover(df: DataFrame, cols: list[str], kind: str = "fisherz", alpha: float = 0.05) -> MixedGraph:
    return pc(len(cols), ci_test(df, cols, kind), alpha)


def discover_by(df: DataFrame, cols: list[str], by: str, alpha: float = 0.05) -> DataFrame:
    """Edge tables (graph, src, dst, kind) of every group's PC graph by partial correlations, all groups from one pass over the rows."""
    from shiftscope.functions.scores import Basis

    last, every = len(cols) - 1, tuple(range(len(cols)))
    table = scoring.grams(df, cols, [by], [(last, every)], Basis("lin", *scoring.column_stats(df, cols)))[last, every]
    rows = []
    for key, g in sorted(table.items()):
        n = g[0, 0]
        cov = g[1:-1, 1:-1] / n - np.outer(g[0, 1:-1], g[0, 1:-1]) / n / n
        d = np.sqrt(np.maximum(1e-300, np.diag(cov)))
        corr = cov / np.outer(d, d)
        graph = pc(len(cols), lambda x, y, z, corr=corr, n=n: ci.fisher_z(corr, int(n), x, y, z)[1], alpha)
        rows += [(key[0], cols[a], cols[b], kind) for kind in ("directed", "undirected") for a, b in sorted(getattr(graph, kind))]
    return df.sparkSession.createDataFrame(rows, "graph string, src string, dst string, kind string")


def joint(df: DataFrame, cols: list[str], context: str, alpha: float = 0.05, kind: str = "fisherz", encode: str = "one_hot") -> tuple[MixedGraph, list[str]]:
    """Contexts as variables that nothing points to: indicator columns, or the context's number alone.

    Returns the graph over the columns and then the context variables, and their names.
    """
    if encode == "one_hot":
        values = [r[0] for r in df.select(context).distinct().orderBy(context).collect()]  # one row per context
        rows = one_hot(df, context, values, "ctx_")
        extra = [f"ctx_{v}" for v in values[1:]]
    else:
        values = {r[0]: i for i, r in enumerate(df.select(context).distinct().orderBy(context).collect())}
        number = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(context)]
        rows, extra = df.withColumn("ctx", number.cast("double")), ["ctx"]
    names = [*cols, *extra]
    n, k = len(cols), len(names)
    between = {(a, b) for a, b in combinations(range(n, k), 2)}
    into = {(x, c) for x in range(n) for c in range(n, k)}
    return pc(k, ci_test(rows, names, kind), alpha, into, between), names


def targets_of(graph: MixedGraph, n: int) -> set[int]:
    """Nodes that a context variable points to."""
    return {b for a, b in graph.directed if a >= n > b}


def edge_table(spark, graph: MixedGraph, names: list[str]) -> DataFrame:
    rows = [(0, names[a], names[b], kind) for kind in ("directed", "bidirected", "undirected") for a, b in sorted(getattr(graph, kind))]
    return spark.createDataFrame(rows, "graph int, src string, dst string, kind string")


def sort_regress(corr: np.ndarray, n: int, scores: np.ndarray, alpha: float = 1e-3) -> set[tuple[int, int]]:
    """Each node on its predecessors in the order of the scores; backward elimination by BIC."""
    order, out = np.argsort(scores, kind="stable"), set()
    for k, node in enumerate(order):
        held = [int(p) for p in order[:k]]

        def bic(ps: list[int], node=int(node)) -> float:
            r = 1.0 - (corr[node, ps] @ np.linalg.pinv(corr[np.ix_(ps, ps)]) @ corr[ps, node] if ps else 0.0)
            return n * np.log(max(1e-12, r)) + len(ps) * np.log(max(2, n))

        while held:
            best = min(([p for p in held if p != q] for q in held), key=bic)
            if bic(best) > bic(held):
                break
            held = best
        out |= {(p, int(node)) for p in held}
    return out


def r2_scores(corr: np.ndarray) -> np.ndarray:
    """How well each column is explained by all others."""
    return 1 - 1 / np.maximum(1e-300, np.diag(np.linalg.pinv(corr)) * np.diag(corr))


def sortability(edges: set[tuple[int, int]], n: int, scores: np.ndarray, tol: float = 0.0) -> float:
    """Share of directed paths' node pairs (by path length) that the scores order; ties count half."""
    a = np.zeros((n, n))
    for s, d in edges:
        a[s, d] = 1
    step, hits, total = a.copy(), 0.0, 0.0
    for _ in range(n - 1):
        s, d = np.nonzero(step)
        gap = scores[d] - scores[s]
        hits += float((gap > tol).sum() + 0.5 * (np.abs(gap) <= tol).sum())
        total += len(s)
        step = (step @ a > 0).astype(float)
    return hits / total if total else 0.5


TAIL, ARROW, CIRCLE = -1, 1, 2


def fci(n: int, test: Test, alpha: float = 0.05) -> dict[tuple[int, int], int]:
    """Partial ancestral graph as marks: ``marks[a, b]`` is the mark at b of the edge between a and b.

    Skeleton, then another look with the nodes that colliders or triangles lead
    to as candidates, colliders, and the ten orientation rules.
    """
    marks, apart = _ancestral_skeleton(n, test, alpha)
    return _close_marks(n, marks, apart)


def _ancestral_skeleton(n: int, test: Test, alpha: float, forbidden: set[tuple[int, int]] = frozenset()) -> tuple[dict, dict]:
    edges, apart = skeleton(n, test, alpha, forbidden=forbidden)
    marks = _collide(n, edges, apart)
    for x, y in sorted(edges):
        for a, b in ((x, y), (y, x)):
            pool = _possible(n, marks, a) - {a, b}
            hit = next((z for k in range(min(len(pool), n) + 1) for z in combinations(sorted(pool), k) if test(x, y, z) > alpha), None)
            if hit is not None:
                edges = edges - {(x, y)}
                apart[x, y] = set(hit)
                break
    return _collide(n, edges, apart), apart


def _close_marks(n: int, marks: dict, apart: dict, targets: dict[int, set[int]] | None = None) -> dict:
    while True:
        while _orient_marks(n, marks, apart):
            pass
        before = dict(marks)
        partial_ancestral.close(marks)
        if targets:
            partial_ancestral.rule12(marks, targets)
        if marks == before:
            return marks


def interventional_skeleton(n: int, pooled: Test, invariant: Callable[[int, int, tuple[int, ...]], float], settings: int, alpha: float = 0.05) -> tuple[dict, dict]:
    """Marks and separating sets over n nodes and one intervention node per pair of settings (numbers n, n + 1, ...).

    ``pooled`` tests two nodes; ``invariant`` (pair number, node, given) is the p
    value of the node's distribution given others being the same in a pair of
    settings.  Intervention nodes are not adjacent to each other, and no
    intervention node is conditioned on when two nodes are tested.
    """
    pairs = list(combinations(range(settings), 2))
    extra = set(range(n, n + len(pairs)))

    def test(x: int, y: int, z: tuple[int, ...]) -> float:
        if extra & set(z):
            return 0.0  # no statement with an intervention node among the given ones
        if y in extra:
            return invariant(y - n, x, z)
        return pooled(x, y, z)

    forbidden = set(combinations(sorted(extra), 2))
    return _ancestral_skeleton(n + len(pairs), test, alpha, forbidden)


def psi_fci(n: int, pooled: Test, invariant: Callable[[int, int, tuple[int, ...]], float], settings: int, targets: dict[int, set[int]] | None = None, alpha: float = 0.05) -> dict[tuple[int, int], int]:
    """Marks of the ancestral graph of several settings; ``targets``: known targets of pairs of settings, by pair number."""
    marks, apart = interventional_skeleton(n, pooled, invariant, settings, alpha)
    total = n + settings * (settings - 1) // 2
    partial_ancestral.rule11(marks, set(range(n, total)))
    return _close_marks(total, marks, apart, {n + k: t for k, t in (targets or {}).items()})


def setting_tests(df: DataFrame, cols: list[str], setting: str) -> tuple[Test, Callable[[int, int, tuple[int, ...]], float], int]:
    """The two tests of ``psi_fci`` from one pass of cross products per setting: partial correlations of the pooled rows, and equal linear mechanisms."""
    from shiftscope.functions.scores import Basis

    basis = Basis("lin", *scoring.column_stats(df, cols))
    last = len(cols) - 1
    table = scoring.grams(df, cols, [setting], [(last, tuple(range(len(cols))))], basis)[last, tuple(range(len(cols)))]
    blocks = [table[k][:-1, :-1] for k in sorted(table)]  # of (1, all columns)
    whole = sum(blocks)
    n = whole[0, 0]
    cov = whole[1:, 1:] / n - np.outer(whole[0, 1:], whole[0, 1:]) / n / n
    d = np.sqrt(np.maximum(1e-300, np.diag(cov)))
    corr = cov / np.outer(d, d)
    pairs = list(combinations(range(len(blocks)), 2))

    def invariant(pair: int, node: int, z: tuple[int, ...]) -> float:
        at = [0, *(1 + v for v in z), 1 + node]
        return ci.linear_params_grams(*(blocks[k][np.ix_(at, at)] for k in pairs[pair]))[1]

    return (lambda x, y, z: ci.fisher_z(corr, int(n), x, y, z)[1]), invariant, len(blocks)


def joint_fci(df: DataFrame, cols: list[str], context: str, alpha: float = 0.05, kind: str = "fisherz") -> tuple[dict[tuple[int, int], int], list[str]]:
    """Ancestral graph over the columns and indicator columns of the contexts, which nothing points to; marks and names."""
    values = [r[0] for r in df.select(context).distinct().orderBy(context).collect()]  # one row per context
    rows = one_hot(df, context, values, "ctx_")
    names = [*cols, *(f"ctx_{v}" for v in values[1:])]
    n, k = len(cols), len(names)
    marks, apart = _ancestral_skeleton(k, ci_test(rows, names, kind), alpha, {(a, b) for a, b in combinations(range(n, k), 2)})
    partial_ancestral.rule11(marks, set(range(n, k)))
    return _close_marks(k, marks, apart), names


def mark_scores(marks: dict[tuple[int, int], int], directed: set[tuple[int, int]], confounded: set[tuple[int, int]]) -> dict[str, dict[str, float]]:
    """Confusion of bidirected edges against confounded pairs, and of arrows against true edges."""
    from shiftscope.functions.graph_distances import confusion

    n = 1 + max((v for e in marks for v in e), default=0)
    both = {(a, b) for a, b in marks if marks[a, b] == marks[b, a] == ARROW}
    arrows = {(a, b) for a, b in marks if marks[a, b] == ARROW and marks[b, a] == TAIL}
    return {"confounded": confusion({e for a, b in confounded for e in ((a, b), (b, a))}, both, n), "causal": confusion(directed, arrows, n)}


def missing_value_pc(df: DataFrame, cols: list[str], alpha: float = 0.05) -> MixedGraph:
    """PC with a test per statement on the rows where its columns are present, each pattern of missing values in one pass.

    Rows are summed by pattern of present columns; a statement adds up the
    patterns that have all its columns.  A column whose missingness depends on
    another directly (tests against its indicator) is conditioned on that other as well.
    """
    marks = [F.when(F.col(c).isNull(), 1.0).otherwise(0.0).alias(f"_m{i}") for i, c in enumerate(cols)]
    pattern = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols)).alias("_p")
    filled = df.select(pattern, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols), *marks)
    both = [*cols, *(f"_m{i}" for i in range(len(cols)))]
    from shiftscope.functions.scores import Basis

    n = len(cols)
    centre, scale = scoring.column_stats(df, cols)
    basis = Basis("lin", np.append(centre, np.zeros(n)), np.append(scale, np.ones(n)))
    last, every = 2 * n - 1, tuple(range(2 * n))
    table = {k[0]: g[:-1, :-1] for k, g in scoring.grams(filled, both, ["_p"], [(last, every)], basis)[last, every].items()}

    def p_value(index: list[int], present: list[int]) -> float:
        held = [g for k, g in table.items() if all(k[c] == "1" for c in present)]
        if not held:
            return 1.0
        g = sum(held)
        rows = g[0, 0]
        at = [1 + i for i in index]
        cov = g[np.ix_(at, at)] / rows - np.outer(g[0, at], g[0, at]) / rows / rows
        d = np.sqrt(np.maximum(1e-300, np.diag(cov)))
        return ci.fisher_z(cov / np.outer(d, d), int(rows), 0, 1, tuple(range(2, len(index))))[1]

    # direct causes alone: dependent on the indicator, and still so given each other column
    direct = lambda v, c: all(p_value([v, n + c, *given], [v, *given]) < alpha / n for given in [[], *([u] for u in range(n) if u not in (v, c))])
    causes = {c: {v for v in range(n) if v != c and direct(v, c)} if any(k[c] == "0" for k in table) else set() for c in range(n)}

    def test(x: int, y: int, z: tuple[int, ...]) -> float:
        plain = p_value([x, y, *z], [x, y, *z])
        if plain > alpha:
            return plain
        more = sorted({w for v in (x, y, *z) for w in causes[v]} - {x, y, *z})
        return max(plain, p_value([x, y, *z, *more], [x, y, *z, *more])) if more else plain

    return pc(n, test, alpha)


def _collide(n: int, edges: set[tuple[int, int]], apart: dict) -> dict[tuple[int, int], int]:
    marks = {e: CIRCLE for a, b in edges for e in ((a, b), (b, a))}
    for v in range(n):
        for a, b in combinations([w for w in range(n) if (v, w) in marks], 2):
            if (a, b) not in marks and v not in apart.get((a, b), set()):
                marks[a, v] = marks[b, v] = ARROW
    return marks


def _possible(n: int, marks: dict, start: int) -> set[int]:
    """Nodes at the end of a path on which every inner node is a collider or lies in a triangle."""
    seen, stack, out = set(), [(start, w) for w in range(n) if (start, w) in marks], set()
    while stack:
        u, v = stack.pop()
        if (u, v) in seen:
            continue
        seen.add((u, v))
        out.add(v)
        for w in range(n):
            if w not in (u, v) and (v, w) in marks and ((u, w) in marks or marks[u, v] == marks[w, v] == ARROW):
                stack.append((v, w))
    return out


def _orient_marks(n: int, marks: dict, apart: dict) -> bool:
    before = dict(marks)
    for a, b in permutations(range(n), 2):
        if (a, b) not in marks:
            continue
        for c in range(n):
            if c in (a, b) or (b, c) not in marks:
                continue
            if marks[a, b] == ARROW and marks[c, b] == CIRCLE and (a, c) not in marks:  # away from a collider
                marks[c, b], marks[b, c] = TAIL, ARROW
            if (a, c) in marks and marks[a, c] == CIRCLE and marks[a, b] == ARROW and marks[b, c] == ARROW and TAIL in (marks[b, a], marks[c, b]):  # no cycle
                marks[a, c] = ARROW
            if marks[a, b] == marks[c, b] == ARROW and (a, c) not in marks:  # double triangle
                for d in range(n):
                    if (a, d) in marks and (c, d) in marks and (d, b) in marks and marks[a, d] == marks[c, d] == marks[d, b] == CIRCLE:
                        marks[d, b] = ARROW
            if (a, c) in marks and marks[c, b] == CIRCLE and marks[a, b] == ARROW and marks[a, c] == ARROW and marks[c, a] == TAIL:
                path = _discriminating(n, marks, a, b, c)
                if path is not None:
                    if b in apart.get((min(path, c), max(path, c)), set()):
                        marks[c, b], marks[b, c] = TAIL, ARROW
                    else:
                        marks[c, b] = marks[b, c] = ARROW
    return marks != before


def _discriminating(n: int, marks: dict, a: int, b: int, c: int) -> int | None:
    """The far end of a path to (a, b, c) whose inner nodes are colliders and parents of c."""
    stack, seen = [(a, {a, b, c})], {a}
    while stack:
        v, used = stack.pop()
        for w in range(n):
            if w in used or (w, v) not in marks or marks[w, v] != ARROW:
                continue
            if (w, c) not in marks:
                return w
            if w not in seen and marks[v, w] == ARROW and marks[w, c] == ARROW and marks[c, w] == TAIL:
                seen.add(w)
                stack.append((w, used | {w}))
    return None


# --- what a search may know -----------------------------------------------------------


def candidate_sets(edges: set[tuple[int, int]], n: int, x: int, y: int, method: str = "neighbours", marks: dict | None = None) -> list[set[int]]:
    """Pools of nodes that may separate x and y.

    complete: all others; neighbours: those of x, and of y; neighbours_path: of
    these the ones on a path to the other; pds: what colliders and triangles lead
    to in a graph with marks; pds_path: of these the ones on a path to the other.
    """
    near = {v: {w for e in edges if v in e for w in e if w != v} for v in range(n)}

    def on_path(a: int, b: int, v: int) -> bool:
        """Whether a walk from a through v to b passes neither end twice."""
        seen, stack = {a, b}, [v]
        while stack:
            u = stack.pop()
            if b in near[u] and u != a:
                return True
            fresh = near[u] - seen
            seen |= fresh
            stack += fresh
        return False

    if method == "complete":
        return [set(range(n)) - {x, y}]
    if method in ("neighbours", "neighbours_path"):
        pools = [near[x] - {y}, near[y] - {x}]
        ends = [(x, y), (y, x)]
    elif method in ("pds", "pds_path"):
        marks = marks if marks is not None else {e: CIRCLE for a, b in edges for e in ((a, b), (b, a))}
        pools = [_possible(n, marks, x) - {x, y}, _possible(n, marks, y) - {x, y}]
        ends = [(x, y), (y, x)]
    else:
        raise ValueError(f"unknown method {method}")
    if method.endswith("_path"):
        pools = [{v for v in pool if on_path(a, b, v)} for pool, (a, b) in zip(pools, ends, strict=True)]
    return pools


def context_knowledge(nodes: int, contexts: int, level: int = 3) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Arrows (x, y) and pairs that are ruled out for context variables numbered after the nodes.

    Level 1: no node causes a context; 2: nor shares a hidden cause with one (for
    graphs without hidden causes nothing more); 3: contexts are not adjacent.
    """
    extra = range(nodes, nodes + contexts)
    arrows = {(v, c) for v in range(nodes) for c in extra} if level >= 1 else set()
    return arrows, set(combinations(extra, 2)) if level >= 3 else set()


class SearchContext:
    """What is known before a search: variables, latent ones, edges that must or must not be there, settings and their targets."""

    def __init__(self):
        self.variables: list[str] = []
        self.latent: set[str] = set()
        self.included: set[tuple[str, str]] = set()
        self.excluded: set[tuple[str, str]] = set()
        self.settings = 1
        self.targets: dict[int, set[str]] = {}

    def of(self, *names: str) -> SearchContext:
        self.variables = list(dict.fromkeys([*self.variables, *names]))
        return self

    def hidden(self, *names: str) -> SearchContext:
        self.latent |= set(names)
        return self

    def edges(self, include: set[tuple[str, str]] = frozenset(), exclude: set[tuple[str, str]] = frozenset()) -> SearchContext:
        self.included |= set(include)
        self.excluded |= set(exclude)
        return self

    def interventions(self, targets: list[set[str]]) -> SearchContext:
        """Settings and their targets (an empty set: observations)."""
        self.settings = len(targets)
        pairs = combinations(range(len(targets)), 2)
        self.targets = {k: set(targets[a]) ^ set(targets[b]) for k, (a, b) in enumerate(pairs)}
        return self

    def build(self) -> SearchContext:
        """Checks that the parts agree."""
        known = set(self.variables)
        named = {v for e in self.included | self.excluded for v in e} | self.latent | {v for t in self.targets.values() for v in t}
        if not known or named - known:
            raise ValueError(f"unknown variables {sorted(named - known)}" if known else "no variables")
        if self.included & self.excluded:
            raise ValueError("an edge is both included and excluded")
        MixedGraph(len(known), {(self.variables.index(a), self.variables.index(b)) for a, b in self.included}).order()
        return self

    @property
    def observed(self) -> list[str]:
        return [v for v in self.variables if v not in self.latent]

    @property
    def intervention_nodes(self) -> list[str]:
        return [f"F{k}" for k in range(self.settings * (self.settings - 1) // 2)]

    def discover(self, df: DataFrame, alpha: float = 0.05) -> MixedGraph:
        """PC over the observed variables under this knowledge."""
        cols = self.observed
        at = {v: i for i, v in enumerate(cols)}
        inside = lambda edges: {(at[a], at[b]) for a, b in edges if a in at and b in at}
        gone = inside(self.excluded)
        pairs = {tuple(sorted(e)) for e in gone if e[::-1] in gone}
        found = pc(len(cols), ci_test(df, cols), alpha, (gone - {e for p in pairs for e in (p, p[::-1])}) | {e[::-1] for e in inside(self.included)}, pairs)
        keep = inside(self.included)
        skeleton_ = found.skeleton() | {tuple(sorted(e)) for e in keep}
        return orient(len(cols), skeleton_, {e for e in found.directed if e[::-1] not in keep} | keep)
