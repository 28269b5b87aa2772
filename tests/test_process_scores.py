"""Process scores from cross products against the exact process, and searches with them over all rows."""

import numpy as np
import pandas as pd
import pytest

from shiftscope.functions import gaussian_process as gp, scores
from shiftscope.plans.lagged import LaggedRegimes
from shiftscope.plans.topological import Topological


@pytest.mark.parametrize("columns, length, error", [(1, 1.0, 1e-6), (1, 0.5, 1e-3), (2, 1.0, 0.05)])
def test_features_give_the_kernel(columns, length, error):
    x = np.clip(np.random.default_rng(0).normal(size=(200, columns)), -2, 2)
    f = gp.KarhunenLoeveFeatures(columns, 30 if columns == 1 else 60, length)(x)
    assert np.abs(f @ f.T - np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * length**2))).max() < error


def both(x, y):
    """Bits from the sums, bits of the dense kernel over a fine grid of the same length scales, and those without parents."""
    data = np.column_stack([x, y])
    basis = scores.Basis("gp", data.mean(0), data.std(0))
    parents = tuple(range(data.shape[1] - 1))
    z = (data - data.mean(0)) / data.std(0)
    n, d2, best = len(z), ((z[:, None, :-1] - z[None, :, :-1]) ** 2).sum(-1), np.inf
    for length in scores.LENGTHS:
        values, vectors = np.linalg.eigh(np.exp(-d2 / (2 * length**2)))
        inner = (vectors.T @ z[:, -1]) ** 2
        for signal in np.exp(np.arange(-9, 9.1, 0.5)):
            for noise in np.exp(np.arange(-9, 3.1, 0.25)):
                own = signal * np.maximum(0, values) + noise
                best = min(best, 0.5 * ((inner / own).sum() + np.log(own).sum() + n * np.log(2 * np.pi)))
    dense = (best + 1.5 * np.log(n)) / np.log(2) + n * np.log2(data[:, -1].std())
    return scores.process_bits(scores.gram(basis(data, parents), data[:, -1])), dense, scores.null_bits(data[:, -1])


@pytest.mark.parametrize("f", [lambda x: 2 * x, lambda x: np.sin(2 * x), lambda x: x**2, lambda x: 0 * x])
def test_bits_are_those_of_the_dense_process(f):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = 50 * f(x) + 10 * rng.normal(size=300) + 7
    mine, dense, _ = both(x, y)
    assert mine == pytest.approx(dense, abs=3.0)
    # the exact score searches length scales too, on fewer points
    assert mine <= scores.gp_bits(x, y) + 4


def test_bits_of_two_parents():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    mine, exact, null = both(x, np.sin(x[:, 0]) * x[:, 1] + 0.2 * rng.normal(size=300))
    assert null - mine > 0.9 * (null - exact)


def test_sums_of_contexts_are_the_union():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 1))
    data = np.column_stack([x, np.sin(2 * x) + 0.3 * rng.normal(size=(400, 1))])
    basis = scores.Basis("gp", data.mean(0), data.std(0))
    g = [scores.gram(basis(part, (0,)), part[:, 1]) for part in np.array_split(data, 4)]
    assert scores.process_bits(sum(g)) == pytest.approx(scores.process_bits(scores.gram(basis(data, (0,)), data[:, 1])), rel=1e-9)
    total, labels = scores.partition_contexts(g, bits=scores.process_bits)
    assert labels == [0] * 4 and total == pytest.approx(scores.process_bits(sum(g)))
    flipped = [*g[:2], *(scores.gram(basis(part, (0,)), -part[:, 1]) for part in np.array_split(data, 4)[2:])]
    assert scores.partition_contexts(flipped, bits=scores.process_bits)[1] == [0, 0, 1, 1]


def test_topological_search(spark):
    rng = np.random.default_rng(7)
    n = 1500
    c = rng.integers(0, 3, n)
    a = rng.normal(size=n)
    b = np.cos(2 * a) * np.where(c == 2, -1, 1) + 0.3 * rng.normal(size=n)
    d = np.tanh(2 * b) + 0.2 * rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "d": d, "c": c})).repartition(4)
    model = Topological(["a", "b", "d"], "c", "gp").fit(df)
    assert {(r.src, r.dst) for r in model.edges(spark).collect()} == {("a", "b"), ("b", "d")}
    labels = {(r.node, r.context): r.label for r in model.changes(spark).collect()}
    assert labels["b", "0"] == labels["b", "1"] != labels["b", "2"] and labels["d", "0"] == labels["d", "2"]


def test_lagged_search(spark):
    rng = np.random.default_rng(8)
    x, y = np.zeros((2, 400)), np.zeros((2, 400))
    for t in range(1, 400):
        x[:, t] = 0.3 * x[:, t - 1] + rng.normal(size=2)
        y[:, t] = np.cos(1.5 * x[:, t - 1]) + 0.3 * rng.normal(size=2)
    rows = pd.DataFrame({"context": np.repeat([0, 1], 400), "t": np.tile(np.arange(400), 2), "x": x.ravel(), "y": y.ravel()})
    found = {(r.child, r.parent, r.lag) for r in LaggedRegimes(["x", "y"], kind="gp", min_duration=100, iterations=2).fit(spark.createDataFrame(rows)).edges(spark).collect()}
    assert ("y", "x", 1) in found and ("x", "y", 0) not in found and ("x", "y", 1) not in found
