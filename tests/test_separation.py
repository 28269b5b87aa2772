"""Distances of many graphs at once against those of one pair at a time."""

import numpy as np
import pytest

from shiftscope.functions.mixed_graph import MixedGraph, ancestor_adjustment_distance, parent_adjustment_distance, separation_disagreement, separation_distance
from shiftscope.operators import separation as S


def random_dag(n, chance, rng):
    order = rng.permutation(n)
    return {(int(order[i]), int(order[j])) for i in range(n) for j in range(i + 1, n) if rng.random() < chance}


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(0)
    sizes = [1, 2, *rng.integers(2, 8, 90).tolist()]
    return [(int(n), random_dag(n, c, rng), random_dag(n, c, rng)) for n in sizes for c in [rng.choice([0.1, 0.4, 0.8])]]


def test_distances(spark, pairs):
    name = lambda g, v: 10 * v + g % 7  # noqa: E731  any numbers in order
    nodes = spark.createDataFrame([(g, name(g, v)) for g, (n, _, _) in enumerate(pairs) for v in range(n)], "graph long, node long")
    tables = [spark.createDataFrame([(g, name(g, a), name(g, b)) for g, p in enumerate(pairs) for a, b in p[k]], "graph long, src long, dst long") for k in (1, 2)]
    got = {r.graph: r for r in S.distances(nodes.repartition(5), *tables).collect()}
    assert len(got) == len(pairs)
    for g, (n, true, guess) in enumerate(pairs):
        a, b = MixedGraph(n, true), MixedGraph(n, guess)
        count = n * (n - 1) // 2
        assert got[g].nodes == n
        assert got[g].separation == round(separation_distance(a, b, "parent") * max(1, count))
        assert got[g].parent_adjustment == parent_adjustment_distance(a, b)
        assert got[g].ancestor_adjustment == ancestor_adjustment_distance(a, b)
        differ = sum(a.separated(x, y, z) != b.separated(x, y, z) for x in range(n) for y in range(x + 1, n) for z in [(), *((v,) for v in range(n) if v not in (x, y))])
        assert got[g].disagreement == differ


def test_equal_graphs_and_no_graphs(spark, pairs):
    nodes = spark.createDataFrame([(g, v) for g, (n, _, _) in enumerate(pairs) for v in range(n)], "graph long, node long")
    edges = spark.createDataFrame([(g, a, b) for g, p in enumerate(pairs) for a, b in p[1]], "graph long, src long, dst long")
    for r in S.distances(nodes, edges, edges).collect():
        assert (r.separation, r.parent_adjustment, r.ancestor_adjustment, r.disagreement) == (0, 0, 0, 0)
    assert S.distances(nodes.limit(0), edges, edges).collect() == []
    assert separation_disagreement(MixedGraph(2, set()), MixedGraph(2, {(0, 1)}), 0)["sc"] > 0


def test_known_closures_and_repeated_graphs(spark):
    """A closure can be given, and graphs that are alike but for their nodes' numbers count alike."""
    rng = np.random.default_rng(0)
    a = np.triu(rng.random((50, 6, 6)) < 0.4, 1)
    z = rng.random((50, 6)) < 0.3
    z[:, 0] = False
    assert np.array_equal(S.connected(a, 0, z), S.connected(a, 0, z, S.closure(a)))
    ways = [(0, 10, 11), (0, 11, 12)]
    true = spark.createDataFrame([(g, s + 100 * g, d + 100 * g) for g in range(5) for _, s, d in ways], "graph long, src long, dst long")
    guess = spark.createDataFrame([(g, 10 + 100 * g, 12 + 100 * g) for g in range(5)], "graph long, src long, dst long")
    nodes = true.selectExpr("graph", "src as node").union(true.selectExpr("graph", "dst"))
    found = {tuple(r)[1:] for r in S.distances(nodes, true, guess).collect()}
    assert len(found) == 1
