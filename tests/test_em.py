"""Mixtures over all rows against the same EM on one array, and on planted populations."""

import numpy as np
import pandas as pd
import pytest

from shiftscope.functions.mixture import gaussian_mixture, regression_mixture
from shiftscope.functions.numerics import information_scores
from shiftscope.operators import em
from shiftscope.plans import mixtures


def two_slopes(n, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(50, 9, n), rng.integers(0, 2, n)
    return pd.DataFrame({"row": np.arange(n), "x": x, "y": np.where(z == 0, 3 * x + 1000, 700 - 2 * x) + rng.normal(0, 4, n), "z": z})


def test_planted_regressions_over_all_rows(spark):
    data = two_slopes(12_000)
    df = spark.createDataFrame(data).repartition(7)
    models = em.fit(df, "y", ["x"], "lin", 4, most=2000)
    best = models[0]
    assert best.k == 2 and best.n == 12_000 and len(models) == 4
    slopes = sorted(w[1] * best.scale[1] / best.scale[0] for w in best.weights)
    assert slopes == pytest.approx([-2, 3], abs=0.02)
    labels = em.labelled(df, ["row", "z"], "y", ["x"], best).toPandas()
    assert len(labels) == 12_000 and max((labels.label == labels.z).mean(), (labels.label != labels.z).mean()) > 0.999
    assert np.allclose([sum(p) for p in labels.posterior[:50]], 1)
    table = em.components(spark, best).collect()
    assert [r.component for r in table] == [0, 1] and sum(r["size"] for r in table) == pytest.approx(12_000) and table[0].spread == pytest.approx(4, rel=0.1)


def test_same_as_one_array(spark):
    data = two_slopes(600, 3)
    models = {m.k: m for m in em.fit(spark.createDataFrame(data), "y", ["x"], "lin", 2)}
    _, _, bic = regression_mixture(data[["x"]].to_numpy(), data["y"].to_numpy(), 2)
    assert models[2].bic == pytest.approx(bic, rel=1e-3)
    x, y = np.column_stack([np.ones(600), data.x]), data.y.to_numpy()
    var = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).mean()
    assert models[1].bic == pytest.approx(600 * (np.log(2 * np.pi * var) + 1) + 3 * np.log(600), rel=1e-6)


def test_gaussians(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (3000, 2)), rng.normal([8, 5], [1, 3], (1500, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    best = em.fit(df, "b", ["a"], "gmm", 3)[0]
    assert best.k == 2 and sorted(best.shares) == pytest.approx([1 / 3, 2 / 3], abs=0.01)
    small = spark.createDataFrame(pd.DataFrame(x[::15], columns=["a", "b"]))
    assert em.fit(small, "b", ["a"], "gmm", 2)[0].bic == pytest.approx(gaussian_mixture(x[::15], 2)[2], rel=1e-2)
    alone = em.fit(df, "a", [], "lin", 3)[0]
    assert alone.kind == "gmm" and alone.k == 2


def test_likelihood_never_falls(spark):
    df = spark.createDataFrame(two_slopes(4000, 5)).repartition(3).persist()
    values = [next(m for m in em.fit(df, "y", ["x"], "lin", 2, rounds=r, most=60) if m.k == 2).log_likelihood for r in (0, 1, 2, 5, 20)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:]))
    df.unpersist()


def test_node_mixtures_without_blocks(spark):
    data = two_slopes(5000, 7).assign(w=lambda d: d.z * 20 + np.random.default_rng(1).normal(size=5000))
    labels = mixtures.node_mixtures(spark.createDataFrame(data), "row", {"y": ["x"], "w": []}, k_max=3).persist()
    assert labels.count() == 10_000
    for node in ("y", "w"):
        found = labels.where(f"node = '{node}'").toPandas().sort_values("row_id").label.to_numpy()
        assert information_scores(data.z.to_numpy(), found)["ami"] > 0.99
    _, sets = mixtures.shared_sets(labels)
    assert sets == [["w", "y"]]
    labels.unpersist()


def test_edges(spark):
    schema = "row long, x double, y double"
    assert em.fit(spark.createDataFrame([], schema), "y", ["x"]) == []
    assert mixtures.node_mixtures(spark.createDataFrame([], schema), "row", {"y": ["x"]}).collect() == []
    same = spark.createDataFrame([(1, 2.0, 3.0)] * 50 + [(2, None, 1.0)], schema)
    best = em.fit(same, "y", ["x"], k_max=3)[0]
    assert best.n == 50 and best.k == 1
    rows = em.labelled(same, ["row"], "y", ["x"], best).collect()
    assert [r.label for r in rows] == [0] * 50 + [None]


def test_assigned_rows_are_whole(spark):
    """Close rows share their posteriors, so shares are no counts of rows; rows assigned whole are."""
    rows = [(x, slope * x) for slope, n in ((3.0, 300), (-3.0, 100)) for x in (0.5, 50.0) for _ in range(n)]
    df = spark.createDataFrame(rows, "x double, y double")
    model = next(m for m in em.fit(df, "y", ["x"], "lin", k_max=2) if m.k == 2)
    assert sorted(model.shares * model.n) != pytest.approx([200, 600], abs=0.5)
    whole = em.assigned(df, "y", ["x"], model)
    found = sorted(zip((whole.shares * whole.n).tolist(), whole.lines(), strict=True))
    assert [n for n, _ in found] == pytest.approx([200, 600], abs=1e-6)
    assert [line[1] for _, line in found] == pytest.approx([-3, 3], abs=1e-5)
