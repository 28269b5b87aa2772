"""Variants of scores, tests, searches and sinks, and the pipelines over many sites."""

import math

import numpy as np
import pytest

from shiftscope.functions import changepoints, independence as ci, mixture as X, numerics as N, scores
from shiftscope.functions.mixed_graph import MixedGraph
from shiftscope.operators import evaluation as ev, labels, regimes
from shiftscope.plans import constraint as K, equivalence as E, mixtures, sites
from shiftscope.plans.topological import Topological
from shiftscope.sources import sinks


def test_scores_by_name():
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(150, 1)), rng.normal(size=(150, 1))
    y = np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=150)
    for kind in scores.SCORES:
        assert scores.score_of(kind, x, y) < scores.null_bits(y) - 50 < scores.score_of(kind, noise, y)
    assert scores.score_of("rff", np.zeros((150, 0)), y) == scores.null_bits(y)
    with pytest.raises(ValueError):
        scores.score_of("other", x, y)
    assert N.entropy_of_probabilities([0.5, 0.5, 0], 2) == pytest.approx(1)
    assert N.ami_or_nmi(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == pytest.approx(1)
    assert len(set(N.cluster_points(np.array([[0.0], [0.1], [5.0], [5.1], [9.0], [9.1]])))) == 3 and N.cluster_points(np.zeros((4, 2))).tolist() == [0] * 4
    assert changepoints.equal_cuts(10, 3) == [0, 3, 6, 10]


def test_clusterings_by_name():
    rng = np.random.default_rng(1)
    x, truth = np.vstack([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) + 9]), np.repeat([0, 1], 60)
    for method in ("gmm", "kmeans", "hdbscan", "dbscan", "spectral"):
        found = X.cluster(x, method)
        keep = found >= 0
        assert N.information_scores(truth[keep], found[keep])["ami"] > 0.6, method
    assert len(X.cluster(x, "random")) == 120
    y = 3 * x[:, 0] + rng.normal(size=120) + 20 * truth
    assert X.pruned_parents(np.column_stack([x[:, 0], rng.normal(size=120)]), y, truth) == [0]


def test_searches_with_other_scores():
    rng = np.random.default_rng(2)
    a = rng.normal(size=400)
    b = 2 * a + rng.normal(size=400)
    c = rng.normal(size=400)
    d = b + 2 * c + rng.normal(size=400)
    x = np.column_stack([a, b, c, d])
    score = E.gaussian_bic(np.corrcoef(x.T), 400)
    edges, total = E.best_dag(4, score)
    assert {tuple(sorted(e)) for e in edges} == {(0, 1), (1, 3), (2, 3)} and (1, 3) in edges and (2, 3) in edges
    parents = {v: {p for p, q in edges if q == v} for v in range(4)}
    assert E.flip_gain(score, parents, 1, 3) < 0
    graph, hidden = E.greedy_latent(x[:150], 2)
    assert (1, 3) in graph.skeleton() and set(hidden) == {0, 1, 2, 3}
    chain = MixedGraph(3, {(0, 1), (1, 2)})
    assert E.interventional_class(chain, [{0}]).directed == {(0, 1), (1, 2)} and not E.interventional_class(chain, []).directed


def test_classifier_and_witness():
    rng = np.random.default_rng(3)
    x, group = rng.normal(size=(300, 1)), np.repeat([0.0, 1.0], 150)
    y = x[:, 0] * (1 - 2 * group) + 0.2 * rng.normal(size=300)
    assert ci.kcd_tuned(x, y, group, 40)[1] < 0.1
    at = np.array([[1.0], [1.0]])
    witness = ci.kcd_witness(x, y, group, at, np.array([[-1.0], [1.0]]))
    assert witness[0] > 0.1 and witness[1] < -0.1
    assert 1e-6 <= ci.ridge_by_bound(ci.rbf(x[:80])) <= 1
    z = rng.normal(size=(300, 1))
    u, v, w = z + 0.5 * rng.normal(size=(300, 1)), z + 0.5 * rng.normal(size=(300, 1)), rng.normal(size=(300, 1))
    assert ci.classifier_cmi(u, v, None, 20)[1] < 0.1 < ci.classifier_cmi(u, w, None, 20)[1] + 0.1
    assert ci.classifier_cmi(u, v, z, 20)[1] > 0.04
    near = ci.nearest_in(z, 2)
    assert near.shape == (300, 2) and not (near == np.arange(300)[:, None]).any()
    train, label, test, truth = ci.shuffle_split(u, v, z, 3)
    assert len(train) == len(label) and label.mean() == truth.mean() == 0.5
    assert ci.f_divergence(np.zeros(5), np.zeros(5)) == 0


def test_what_a_search_knows(spark):
    edges = {(0, 1), (1, 2), (2, 3)}
    assert K.candidate_sets(edges, 4, 0, 3, "complete") == [{1, 2}]
    assert K.candidate_sets(edges, 4, 0, 2) == [{1}, {1, 3}] and K.candidate_sets(edges, 4, 0, 2, "neighbours_path") == [{1}, {1}]
    assert K.candidate_sets(edges, 4, 0, 2, "pds_path")[0] == {1} and K.candidate_sets(edges, 4, 0, 2, "pds")[0] >= {1}
    arrows, pairs = K.context_knowledge(2, 2)
    assert arrows == {(0, 2), (0, 3), (1, 2), (1, 3)} and pairs == {(2, 3)} and not K.context_knowledge(2, 2, 0)[0]
    rng = np.random.default_rng(4)
    a = rng.normal(size=800)
    b = a + rng.normal(size=800)
    c = b + rng.normal(size=800)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    context = K.SearchContext().of("a", "b", "c", "h").hidden("h").edges(include={("a", "b")}).interventions([set(), {"b"}, {"c"}]).build()
    assert context.observed == ["a", "b", "c"] and context.intervention_nodes == ["F0", "F1", "F2"] and context.targets[2] == {"b", "c"}
    assert context.discover(df).directed == {(0, 1), (1, 2)}
    for bad in (K.SearchContext(), K.SearchContext().of("a").edges({("a", "z")}), K.SearchContext().of("a", "b").edges({("a", "b")}, {("a", "b")})):
        with pytest.raises(ValueError):
            bad.build()


def test_labels_tables_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "p", 0), (0, "p", 0), (0, "q", 1), (1, "p", 0), (1, "p", 1)], "node int, a string, b int")
    got = {r.node: r for r in labels.partition_scores(rows, ["node"], "a", "b").collect()}
    assert got[0].ari == got[0].nmi == got[0].pair_f1 == 1 and got[0].is_variant and got[1].pair_recall == 0 and not got[1].is_variant and got[0].n_pairs == 3
    table = spark.createDataFrame([(i % 2, (i % 2 + (i % 10 == 0)) % 2, i % 3) for i in range(600)], "x int, y int, z int")
    stat, dof, p = labels.categorical_test(table, "x", "y", ["z"])
    assert dof == 3 and p < 1e-6 and labels.categorical_test(table, "x", "z")[2] > 0.9
    assert labels.confounded_partition(table, "x", "z", "xz").select("xz").distinct().count() == 6
    segments = spark.createDataFrame([(0, 0, 2, 0), (0, 2, 1, 1)], "s int, begin int, duration int, regime int")
    assert [r.inside for r in regimes.regime_mask(segments, ["s"], 1).orderBy("t").collect()] == [False, False, True]
    steps = spark.createDataFrame([(0, t) for t in range(5)], "s int, t int")
    windows = spark.createDataFrame([(0, 1, 3)], "s int, t0 int, tn int")
    assert regimes.subsample("horizontal", steps, windows, ["s"], "t").count() == 2
    with pytest.raises(NotImplementedError):
        regimes.subsample("vertical", steps, windows, ["s"], "t")
    with pytest.raises(ValueError):
        regimes.subsample("other", steps, windows, ["s"], "t")
    targets = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "node int, context int")
    assert ev.target_jaccard(targets, targets.where("context = 1")).first().jaccard == pytest.approx(0.75)
    edges = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (1, "a", "c")], "graph int, src string, dst string")
    sinks.write_graph(edges, str(tmp_path / "g"), ["a", "b", "c"])
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "g"))
    assert back.count() == 6 and sorted(tuple(r)[:3] for r in back.where("graph = 0").collect()) == [("0", "0", "0"), ("0", "0", "1"), ("0", "1", "0")]
    sinks.write_partition(segments.drop("s"), str(tmp_path / "p"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "p")).count() == 2
    results = spark.createDataFrame([("m", "f1", 0.5), ("m", "f1", 1.0), ("n", "shd", 2.0)], "method string, metric string, value double")
    lines = [r.line for r in sinks.tex_rows(results, "method", "metric").orderBy("line_no").collect()]
    assert lines[0].startswith("method & f1 & shd") and lines[1].startswith("m & 0.75 $\\pm$ 0.35 & -")
    states = mixtures.node_mixtures(spark.createDataFrame([(i, float(i % 2 * 9 + i % 5 * 0.1), float(i % 2 * 7 + i % 7 * 0.1)) for i in range(200)], "r int, a double, b double"), "r", {"a": [], "b": []}, k_max=2)
    found = mixtures.shared_sets_by_threshold(states, [0.0, 0.5, 2.0])
    assert {(r.threshold, r.node) for r in found.collect()} == {(t, v) for t in (0.0, 0.5) for v in "ab"}


def test_latent_clusters_and_components():
    from shiftscope.functions import information as I, latent_clusters as L

    rng = np.random.default_rng(7)
    n = 400
    a = rng.uniform(-1, 1, n)
    b = 0.8 * a + rng.uniform(-1, 1, n)
    noise = lambda: 0.4 * rng.uniform(-1, 1, n)
    x = np.column_stack([a + noise(), 1.5 * a + noise(), b + noise(), -1.2 * b + noise()])
    assert L.independent_noise(x, [0, 1], [2, 3])[0] and not L.independent_noise(x, [0, 2], [1, 3])[0]
    assert L.latent_clusters(x, 0.01, 2) == [[0, 1], [2, 3]] and sorted(L.latent_order(x, [[0, 1], [2, 3]])) == [0, 1]
    u = rng.integers(0, 3, 300)
    assert I.expected_ami_by_sampling(u, u) == pytest.approx(1) and abs(I.expected_ami_by_sampling(u, rng.integers(0, 3, 300))) < 0.1
    z = rng.normal(size=(150, 1))
    v, w = np.sin(z[:, 0]) + 0.3 * rng.normal(size=150), np.cos(z[:, 0]) + 0.3 * rng.normal(size=150)
    assert I.residual_mutual_information(v, v + 0.01 * w, z, z) > I.residual_mutual_information(v, w, z, z)
    p = rng.normal(size=(120, 2))
    assert I.optimised_sliced_mi(p, p @ np.array([[1.0], [0.0]]), 3, 5) > I.optimised_sliced_mi(p, rng.normal(size=(120, 1)), 3, 5)
    base = rng.normal(size=(2000, 3))
    base[:, 1] += 1.5 * base[:, 0]
    base[:, 2] += 1.5 * base[:, 1]
    other = rng.normal(size=(2000, 3))
    other[:, 1] = 3 + 0.1 * other[:, 1]
    other[:, 2] += 1.5 * other[:, 1]
    moments = [(m.mean(0), np.cov(m.T, bias=True)) for m in (base, other)]
    graph, targets = E.component_targets(moments, [2000, 2000])
    assert targets == [set(), {1}] and graph.directed == {(0, 1), (1, 2)}
    assert [g.skeleton() for g in E.per_component(moments, [2000, 2000])] == [{(0, 1), (1, 2)}, {(1, 2)}]


def test_levels_and_cycles(spark):
    from shiftscope.operators import graphs

    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4), (0, 1, 4), (0, 1, 2), (1, 5, 6)], "graph int, src int, dst int")
    assert {(r.graph, r.node): r.level for r in graphs.levels(edges).collect()} == {(0, 1): 0, (0, 2): 1, (0, 3): 1, (0, 4): 2, (1, 5): 0, (1, 6): 1}
    assert graphs.levels(edges.where("graph = 9")).count() == 0
    with pytest.raises(ValueError):
        graphs.levels(edges.union(spark.createDataFrame([(1, 6, 5)], edges.schema)))


def test_all_parent_subsets(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    b = a**3 / 3 + 0.2 * rng.normal(size=300)
    df = spark.createDataFrame([(float(u), float(v), float(w)) for u, v, w in zip(a, b, rng.normal(size=300))], "a double, b double, c double")
    model = Topological(["a", "b", "c"], kind="cub", exhaustive=True).fit(df)
    assert {(p, n) for n, ps in model.parents.items() for p in ps} in ({(0, 1)}, {(1, 0)})


def test_sites(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(3):
        a, b = np.zeros(120), np.zeros(120)
        for t in range(1, 120):
            a[t] = 0.3 * a[t - 1] + rng.normal()
            b[t] = 2 * a[t - 1] + (0.3 if t < 60 or s else 4) * rng.normal()
        rows += [(f"s{s}", t, float(a[t]), float(b[t])) for t in range(120)]
    df = spark.createDataFrame(rows, "site string, t long, a double, b double")
    links = {"a": [("a", 1)], "b": [("a", 1)]}
    cuts = {(r.site, r.cut) for r in sites.cuts_per_site(df, "site", "t", links, 20).collect()}
    assert any(s == "s0" and abs(c - 60) <= 10 for s, c in cuts)
    strengths = sites.monthly_strengths(df, "site", "t", links, 120)
    vectors = sites.strength_vectors(strengths)
    assert vectors.count() == 12 and len(vectors.columns) == 4
    points = sites.embedded(vectors, 3).collect()
    assert len(points) == 12 and all(math.isfinite(p.x) and math.isfinite(p.y) for p in points)
    model = sites.discover_sites(df, "site", "t", ["a", "b"])
    assert 2 in model.parents[1]
