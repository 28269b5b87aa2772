import math
from itertools import permutations

import numpy as np
import pytest

from shiftscope.functions import changepoints, independence as ci, mixture, numerics as N, scores
from shiftscope.functions.mixed_graph import MixedGraph, ancestor_adjustment_distance, parent_adjustment_distance, separation_disagreement, separation_distance
from shiftscope.plans import confounding, constraint, ordering

CHAIN = MixedGraph(6, {(i, i + 1) for i in range(5)})
COLLIDER = MixedGraph(6, {(0, 1), (1, 2), (2, 3), (4, 3), (4, 5)})


def test_tails():
    assert N.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert N.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert N.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert N.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)


def test_expected_mi_is_the_mean_over_permutations():
    a, b = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 1, 0, 0])
    mean = np.mean([N.mutual_information(N.contingency(a, np.array(p))) for p in permutations(b)])
    assert N.expected_mutual_information(N.contingency(a, b)) == pytest.approx(mean)
    assert N.information_scores(np.zeros(4), np.zeros(4)) == {"mi": 1.0, "ami": 1.0, "emi": 0.0, "h1": 0.0, "h2": 1.0}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for shape in ((3, 3), (2, 4), (4, 2)):
        gain = rng.random(shape)
        small, large = min(shape), max(shape)
        g = gain if shape[0] <= shape[1] else gain.T
        best = max(sum(g[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        assert sum(gain[i, j] for i, j in N.assign(gain)) == pytest.approx(best)
    assert N.relabel_to(np.array([0, 0, 1, 1]), np.array([5, 5, 3, 3])).tolist() == [0, 0, 1, 1]


def test_no_hypercompression():
    assert N.insignificant(4.0) and not N.insignificant(4.4) and N.insignificant(-1) and not N.insignificant(1e6)


def test_scores_prefer_the_true_parent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    y = np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=120)
    assert scores.gp_bits(x[:, :1], y) < scores.gp_bits(x[:, 1:], y) < math.inf
    basis = scores.Basis("spline", np.zeros(2), np.ones(2))
    bits = [scores.gram_bits(scores.gram(basis(x, p), y)) for p in ((0,), (1,), ())]
    assert bits[0] < bits[2] and bits[0] < bits[1]


def test_contexts_are_partitioned_by_mechanism():
    rng = np.random.default_rng(2)
    basis = scores.Basis("lin", np.zeros(1), np.ones(1))
    grams = []
    for slope in (1, 1, -1, -1):
        x = rng.normal(size=(100, 1))
        grams.append(scores.gram(basis(x, (0,)), slope * x[:, 0] + 0.3 * rng.normal(size=100)))
    for greedy in (False, True):
        assert scores.partition_contexts(grams, greedy=greedy)[1] == [0, 0, 1, 1]


def test_independence_tests_tell_dependence_from_none():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(250, 1))
    x, y, w = z + 0.5 * rng.normal(size=z.shape), z + 0.5 * rng.normal(size=z.shape), rng.normal(size=z.shape)
    assert ci.kci(x, y)[1] < 0.01 < ci.kci(x, y, z)[1] and ci.kci(x, w)[1] > 0.01
    assert ci.cmi_permutation(x, y, shuffles=40)[1] < 0.05 and ci.cmi_permutation(x, w, shuffles=40)[1] > 0.02
    assert ci.classifier_two_sample(x, y)[1] < 0.01 < ci.classifier_two_sample(x, w)[1]
    corr = np.corrcoef(np.hstack([x, y, z]).T)
    assert ci.fisher_z(corr, 250, 0, 1)[1] < 1e-6 and ci.fisher_z(corr, 250, 0, 1, (2,))[1] > 0.01


def test_mechanism_tests():
    rng = np.random.default_rng(4)
    x, group = rng.normal(size=(300, 1)), np.repeat([0.0, 1.0], 150)
    same, moved = x[:, 0] + 0.3 * rng.normal(size=300), x[:, 0] * (1 + 2 * group) + group + 0.3 * rng.normal(size=300)
    for name, test in ci.PAIR_TESTS.items():
        extra = {"permutations": 60} if name == "kcd" else {}
        assert test(x, moved, group, **extra)[1] < 0.05, name
        assert test(x, same, group, **extra)[1] > 0.01, name
    assert ci.mmd(x[:150], x[150:] + 2)[1] < 0.02 < ci.mmd(x[:150], x[150:])[1]


def test_mixture_finds_two_slopes():
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(300, 1)), rng.integers(0, 2, 300)
    y = np.where(label == 1, 2.0, -2.0) * x[:, 0] + 0.2 * rng.normal(size=300)
    found, posterior, _ = mixture.regression_mixture(x, y, 3)
    assert posterior.shape == (300, 2)
    assert N.mutual_information(N.contingency(label, found)) > 0.35
    clear, _, _ = mixture.gaussian_mixture(np.vstack([rng.normal(size=(80, 2)), rng.normal(size=(80, 2)) + 6]), 4)
    assert N.information_scores(clear, np.repeat([0, 1], 80))["ami"] == pytest.approx(1)
    assert set(mixture.dbscan(np.array([[0.0], [0.1], [0.2], [9.0]]), 0.5, 2)) == {0, -1}


def test_pelt_finds_the_cuts():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(5, 1, 60), rng.normal(-3, 1, 70)])
    cuts = changepoints.pelt(x, 10)
    assert cuts[-1] == 210 and len(cuts) == 3 and abs(cuts[0] - 80) <= 2 and abs(cuts[1] - 140) <= 2
    assert changepoints.pelt(rng.normal(size=120), 10) == [120]
    parts = changepoints.random_cuts(100, 4, 20, rng)
    assert parts[0] == 0 and parts[-1] == 100 and min(np.diff(parts)) >= 20
    assert set(changepoints.random_sequence(3, 5, rng)) == {0, 1, 2}


def test_separation():
    assert CHAIN.separated(0, 2, [1]) and not CHAIN.separated(0, 5)
    assert COLLIDER.separated(2, 4) and not COLLIDER.separated(2, 4, [3])
    assert CHAIN.separator(0, 5) and CHAIN.separator(0, 1) is None
    assert COLLIDER.v_structures() == {(2, 3, 4)} and not CHAIN.cpdag().directed
    assert len(CHAIN.cpdag().members()) == 6
    both = MixedGraph(3, {(0, 1)}, {(1, 2)})
    assert not both.separated(1, 2) and both.separated(0, 2)
    cyclic = MixedGraph(3, {(0, 1), (1, 0), (2, 0)})
    assert cyclic.acyclic().directed == {(2, 0), (2, 1)}
    with pytest.raises(ValueError):
        cyclic.order()


def test_graph_distances():
    for distance in (parent_adjustment_distance, ancestor_adjustment_distance, separation_distance):
        assert distance(CHAIN, CHAIN) == 0 and distance(CHAIN, MixedGraph(6)) > 0
    assert separation_disagreement(CHAIN, CHAIN)["sc"] == 0 < separation_disagreement(CHAIN, COLLIDER)["sc"]


def test_constraint_search_with_an_oracle():
    graph = constraint.pc(6, constraint.oracle_test(COLLIDER))
    want = COLLIDER.cpdag()
    assert (graph.directed, graph.undirected) == (want.directed, want.undirected)


def test_orders():
    rng = np.random.default_rng(7)
    x = np.zeros((300, 3))
    x[:, 0] = rng.uniform(-1, 1, 300)
    x[:, 1] = 1.5 * x[:, 0] + rng.uniform(-1, 1, 300)
    x[:, 2] = -x[:, 1] + rng.uniform(-1, 1, 300)
    assert ordering.direct_lingam(x.copy()) == [0, 1, 2]
    x[:, 1] = np.sin(2 * x[:, 0]) + 0.2 * rng.normal(size=300)
    assert sorted(ordering.stein_order(x)) == [0, 1, 2]
    path = {(i, i + 1) for i in range(9)}
    assert constraint.sortability(path, 10, np.arange(10)) == 1 and constraint.sortability(path, 10, -np.arange(10)) == 0 and constraint.sortability(path, 10, np.ones(10)) == 0.5


def test_confounding_scores():
    labels = {"a": [0, 0, 1, 1, 2, 2, 3, 3], "b": [0, 0, 1, 1, 2, 2, 3, 3], "c": [0, 1, 0, 1, 0, 1, 0, 1], "d": [0] * 8}
    pairs = confounding.pair_scores(labels)
    by = {(p["a"], p["b"]): p for p in pairs}
    assert by["a", "b"]["confounded"] and not by["a", "c"]["confounded"] and not by["a", "d"]["confounded"]
    assert confounding.cuts(sorted(labels), pairs) == [["a", "b"]]
    p = np.ones((3, 3))
    p[0, 1] = p[1, 0] = p[0, 2] = p[2, 0] = 0.01
    assert confounding.ordered_partition(p) in ([0, 1, 1], [1, 0, 0])


def test_information_measures():
    from shiftscope.functions import information as I

    rng = np.random.default_rng(8)
    x, noise = rng.normal(size=400), rng.normal(size=400)
    assert I.knn_entropy(x) == pytest.approx(0.5 * math.log(2 * math.pi * math.e), abs=0.2)
    assert I.knn_mutual_information(x, x + 0.3 * noise) > 0.8 > 0.15 > I.knn_mutual_information(x, noise)
    assert I.mixed_mutual_information(x, (x > 0).astype(int)) > 0.4
    assert I.sliced_mutual_information(np.stack([x, noise], 1), np.stack([x, x], 1), 8) > 0.1
    assert abs(I.kl_divergence(x, noise)) < 0.3 < I.kl_divergence(x + 3, noise)
    p = I.noisy_labels(rng.integers(0, 2, 400), 2, 0.95)
    q = I.noisy_labels(rng.integers(0, 2, 400), 2, 0.95)
    assert I.soft_mutual_information(p, p) > 0.4 > 0.05 > I.soft_mutual_information(p, q)
    assert I.adjusted_soft_mutual_information(p, p) > 0.5 and abs(I.adjusted_soft_mutual_information(p, q)) < 0.1
    assert I.confidence(p) == pytest.approx(0.975) and I.soft_mutual_information(p[:, :1], q[:, :1]) == 1.0
    a, b = rng.integers(0, 3, 300), rng.integers(0, 3, 300)
    assert I.total_correlation(a, a) == pytest.approx(N.entropy_of(np.bincount(a))) and I.total_correlation(a, b) < 0.05
    assert I.von_neumann_divergence(np.eye(3), np.eye(3)) == pytest.approx(0)
    group = np.repeat([0, 1], 200)
    assert I.conditional_divergence(x, np.where(group, -x, x), group) > 5 * abs(I.conditional_divergence(x, x + 0.1 * noise, group))
    assert I.kernel_alignment(x, x) == pytest.approx(1) and I.kernel_alignment(x, noise) < 0.1


def test_equivalence_search():
    from shiftscope.plans import equivalence as E

    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 5))
    x[:, 2] += x[:, 0] + x[:, 1]
    x[:, 3] += 0.9 * x[:, 2]
    x[:, 4] += 0.8 * x[:, 3] + 0.7 * x[:, 0]
    truth = MixedGraph(5, {(0, 2), (1, 2), (2, 3), (3, 4), (0, 4)})
    found = E.greedy_equivalence(5, E.gaussian_bic(np.corrcoef(x.T), 3000))
    want = truth.cpdag()
    assert (found.directed, found.undirected) == (want.directed, want.undirected)
    moved = x.copy()
    moved[:, 3] = -2 * moved[:, 2] + rng.normal(size=3000)
    assert 3 in E.changed_targets(np.cov(x.T), 3000, np.cov(moved.T), 3000, truth)
    assert E.changed_targets(np.cov(x.T), 3000, np.cov(x.T), 3000, truth) == set()


def test_fci_marks_a_latent_confounder():
    graph = MixedGraph(4, {(0, 1), (3, 2)}, {(1, 2)})  # 0 -> 1 <-> 2 <- 3
    marks = constraint.fci(4, constraint.oracle_test(graph))
    assert marks[1, 2] == marks[2, 1] == constraint.ARROW and (0, 2) not in marks
    assert marks[0, 1] == marks[3, 2] == constraint.ARROW
    chain = constraint.fci(3, constraint.oracle_test(MixedGraph(3, {(0, 1), (1, 2)})))
    assert set(chain.values()) == {constraint.CIRCLE}
    collider = constraint.fci(4, constraint.oracle_test(MixedGraph(4, {(0, 2), (1, 2), (2, 3)})))
    assert (collider[2, 3], collider[3, 2]) == (constraint.ARROW, constraint.TAIL)
