"""Small graphs on the driver: separation, orientation, equivalence classes, separation and adjustment distances.

Graphs of a few dozen nodes; edge tables of many graphs are handled by
``operators.graphs`` instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

Edge = tuple[int, int]


class MixedGraph:
    """Directed, bidirected and undirected edges over nodes 0..n-1."""

    def __init__(self, n: int, directed: Iterable[Edge] = (), bidirected: Iterable[Edge] = (), undirected: Iterable[Edge] = ()):
        self.n = n
        self.directed = set(directed)
        self.bidirected = {tuple(sorted(e)) for e in bidirected}
        self.undirected = {tuple(sorted(e)) for e in undirected}

    def parents(self, v: int) -> set[int]:
        return {a for a, b in self.directed if b == v}

    def children(self, v: int) -> set[int]:
        return {b for a, b in self.directed if a == v}

    def adjacent(self, a: int, b: int) -> bool:
        return (a, b) in self.directed or (b, a) in self.directed or tuple(sorted((a, b))) in self.bidirected | self.undirected

    def _reach(self, start: Iterable[int], step) -> set[int]:
        seen, stack = set(), list(start)
        while stack:
            for w in step(stack.pop()):
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        return seen

    def ancestors(self, nodes: Iterable[int]) -> set[int]:
        return self._reach(nodes, self.parents)

    def descendants(self, nodes: Iterable[int]) -> set[int]:
        return self._reach(nodes, self.children)

    def possible_ancestors(self, nodes: Iterable[int]) -> set[int]:
        near = lambda v: self.parents(v) | {a for e in self.undirected if v in e for a in e if a != v}
        return self._reach(nodes, near) - set(nodes)

    def order(self) -> list[int]:
        """Nodes with parents first; raises on a cycle."""
        left, out = set(range(self.n)), []
        while left:
            free = sorted(v for v in left if not self.parents(v) & left)
            if not free:
                raise ValueError("the graph has a cycle")
            out += free
            left -= set(free)
        return out

    def canonical(self) -> MixedGraph:
        """Each bidirected edge becomes a latent common parent beyond the nodes."""
        extra = [(self.n + k, v) for k, e in enumerate(sorted(self.bidirected)) for v in e]
        return MixedGraph(self.n + len(self.bidirected), self.directed | set(extra), (), self.undirected)

    def separated(self, x: int, y: int, z: Iterable[int] = ()) -> bool:
        """d-separation (after canonicalisation), by walks that remember their direction."""
        g, z = (self.canonical() if self.bidirected else self), set(z)
        above = g.ancestors(z) | z
        seen, stack = set(), [(x, "up")]
        while stack:
            v, way = stack.pop()
            if (v, way) in seen:
                continue
            seen.add((v, way))
            if v == y and v not in z:
                return False
            if way == "up" and v not in z:
                stack += [(p, "up") for p in g.parents(v)] + [(c, "down") for c in g.children(v)]
            elif way == "down":
                if v not in z:
                    stack += [(c, "down") for c in g.children(v)]
                if v in above:
                    stack += [(p, "up") for p in g.parents(v)]
        return True

    def separator(self, x: int, y: int) -> set[int] | None:
        """A minimal separating set, None if there is none."""
        z = (self.ancestors([x, y]) | {x, y}) - {x, y}
        if not self.separated(x, y, z):
            return None
        for v in sorted(z):
            if self.separated(x, y, z - {v}):
                z = z - {v}
        return z

    def v_structures(self) -> set[tuple[int, int, int]]:
        heads = {v: self.parents(v) | {a for e in self.bidirected if v in e for a in e if a != v} for v in range(self.n)}
        return {(a, v, b) for v, hs in heads.items() for a, b in combinations(sorted(hs), 2) if not self.adjacent(a, b)}

    def skeleton(self) -> set[Edge]:
        return {tuple(sorted(e)) for e in self.directed} | self.bidirected | self.undirected

    def cpdag(self) -> MixedGraph:
        arrows = {(a, v) for l, v, r in self.v_structures() for a in (l, r)}
        return orient(self.n, self.skeleton(), arrows)

    def members(self) -> list[MixedGraph]:
        """All DAGs of a partially directed graph that keep its colliders (a depth-first search with the rules)."""
        if not self.undirected:
            try:
                self.order()
            except ValueError:
                return []
            return [self]
        a, b = min(self.undirected)
        out = []
        for edge in ((a, b), (b, a)):
            closed = orient(self.n, self.skeleton(), self.directed | {edge})
            if closed.v_structures() == self.v_structures() and self.directed <= closed.directed:
                out += closed.members()
        return out

    def acyclic(self) -> MixedGraph:
        """Strongly connected nodes joined by bidirected edges; each member gets all parents from outside its component."""
        group = [frozenset({v} | (self.ancestors([v]) & self.descendants([v]))) for v in range(self.n)]
        directed = {(a, w) for a, b in self.directed if group[a] != group[b] for w in group[b]}
        both = {(a, b) for g in set(group) for a, b in combinations(sorted(g), 2)}
        return MixedGraph(self.n, directed, self.bidirected | both)


def orient(n: int, skeleton: Iterable[Edge], arrows: Iterable[Edge]) -> MixedGraph:
    """Close arrows over a skeleton under the orientation rules; the other edges stay undirected."""
    near: dict[int, set[int]] = {v: set() for v in range(n)}
    for a, b in skeleton:
        near[a].add(b)
        near[b].add(a)
    directed = set(arrows)
    free = {tuple(sorted(e)) for e in skeleton} - {tuple(sorted(e)) for e in directed}
    changed = True
    while changed:
        changed = False
        for a, b in sorted(free):
            for x, y in ((a, b), (b, a)):
                into_x = {w for w in near[x] if (w, x) in directed}
                away = any(w != y and w not in near[y] for w in into_x)
                chain = any((x, w) in directed and (w, y) in directed for w in near[x] & near[y])
                sides = [w for w in near[x] & near[y] if tuple(sorted((x, w))) in free and (w, y) in directed]
                fork = any(v not in near[w] for w, v in combinations(sides, 2))
                kite = any(tuple(sorted((x, w))) in free and (w, v) in directed and (v, y) in directed and w not in near[y] for w in near[x] for v in near[w] & near[x] & near[y])
                if away or chain or fork or kite:
                    directed.add((x, y))
                    free.discard(tuple(sorted((x, y))))
                    changed = True
                    break
    return MixedGraph(n, directed, (), free)


def parent_adjustment_distance(true: MixedGraph, guess: MixedGraph) -> int:
    """Ordered pairs whose effect is wrongly identified by adjusting for the guess's parents in the true graph."""
    wrong = 0
    for x in range(true.n):
        z = guess.parents(x)
        below = true.descendants([x])
        cut = MixedGraph(true.n, {(a, b) for a, b in true.directed if a != x})
        for y in range(true.n):
            if y == x:
                continue
            if y in z:  # the guess says no effect
                wrong += y in below
                continue
            # valid if z holds no node on or below a causal path and blocks all other paths
            between = {v for v in below if y == v or y in true.descendants([v])}
            bad = z & (between | true.descendants(between))
            wrong += bool(bad) or not cut.separated(x, y, z)
    return wrong


def ancestor_adjustment_distance(true: MixedGraph, guess: MixedGraph) -> int:
    """Ordered pairs on whose ancestral relation, or whose adjustment by the guess's ancestors, the graphs differ."""
    wrong = 0
    for x in range(true.n):
        z, below, claimed = guess.ancestors([x]), true.descendants([x]), guess.descendants([x])
        cut = MixedGraph(true.n, {(a, b) for a, b in true.directed if a != x})
        for y in range(true.n):
            if y == x:
                continue
            if y not in claimed:
                wrong += y in below
                continue
            between = {v for v in below if y == v or y in true.descendants([v])}
            wrong += bool(z & (between | true.descendants(between))) or not cut.separated(x, y, z - {y})
    return wrong


def separation_distance(a: MixedGraph, b: MixedGraph, kind: str = "minimal") -> float:
    """Share of b's non-adjacent pairs whose separator in b (parent, ancestor or minimal) fails in a, plus pairs adjacent in b alone."""
    pairs, wrong = list(combinations(range(a.n), 2)), 0
    for x, y in pairs:
        if b.adjacent(x, y):
            wrong += a.separator(x, y) is not None
            continue
        if kind == "parent":
            z = b.parents(y) if x not in b.descendants([y]) else b.parents(x)
        elif kind == "ancestor":
            z = b.ancestors([x, y]) - {x, y}
        elif kind == "minimal":
            z = b.separator(x, y) or set()
        else:
            raise ValueError(f"unknown separator {kind}")
        wrong += not a.separated(x, y, z - {x, y})
    return wrong / max(1, len(pairs))


def separation_disagreement(a: MixedGraph, b: MixedGraph, most: int = 1) -> dict[str, float]:
    """Disagreement on d-separation statements with up to ``most`` conditioning nodes: all, and by who claims it."""
    total = markov = faithful = claims_b = claims_not = 0
    for k in range(most + 1):
        for x, y in combinations(range(a.n), 2):
            for z in combinations([v for v in range(a.n) if v not in (x, y)], k):
                in_a, in_b = a.separated(x, y, z), b.separated(x, y, z)
                total += 1
                claims_b += in_b
                claims_not += not in_b
                markov += in_b and not in_a
                faithful += in_a and not in_b
    return {"sc": (markov + faithful) / max(1, total), "markov": markov / max(1, claims_b), "faithfulness": faithful / max(1, claims_not)}


def symmetric(distance, a: MixedGraph, b: MixedGraph) -> float:
    return (distance(a, b) + distance(b, a)) / 2
