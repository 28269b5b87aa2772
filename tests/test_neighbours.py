"""Neighbours over all rows against brute force."""

import numpy as np
import pandas as pd
import pytest

from shiftscope.functions import independence as ci
from shiftscope.functions.information import knn_entropy
from shiftscope.operators import neighbours as N, row_tests


@pytest.fixture(autouse=True)
def small_cells(monkeypatch):
    monkeypatch.setattr(N, "CELL", 300)
    monkeypatch.setattr(N, "FINE", 40)


def brute_radius(x, w, k):
    gap = np.abs(x[:, None] - x[None]).max(-1)
    order = np.argsort(gap, axis=1)
    reach = np.cumsum(w[order], axis=1) - 1 >= k
    return np.where(reach.any(1), np.take_along_axis(gap, order, 1)[np.arange(len(x)), reach.argmax(1)], np.inf)


@pytest.mark.parametrize("kind", ["even", "clustered", "ties"])
def test_distances(spark, kind):
    rng = np.random.default_rng(1)
    n = 5000 if kind == "even" else 1500
    x = {"even": rng.uniform(size=(n, 2)), "clustered": np.concatenate([rng.normal(0, 1e-3, (n - 300, 2)), rng.normal(0, 100, (300, 2))]), "ties": np.concatenate([np.zeros((n // 3, 2)), rng.integers(0, 9, (n - n // 3, 2)) / 4.0])}[kind]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(g=np.where(np.arange(n) % 5, "u", None))).repartition(4)
    points = N.points_of(df, "g", ["a", "b"]).persist()
    got = N.distances(points, ["x0", "x1"], 4).toPandas()
    assert got.w.sum() == n
    for g in ("u", None):
        own = got[got.g.isna() if g is None else got.g == g]
        p = own[["x0", "x1"]].to_numpy()
        assert np.array_equal(own.radius.to_numpy(), brute_radius(p, own.w.to_numpy(), 4))
    counts = N.counts_within(got.pipe(spark.createDataFrame).select("g", "x0", "radius").distinct(), points.groupBy("g", "x0").agg({"w": "sum"}).withColumnRenamed("sum(w)", "w"), ["x0"], "m").toPandas()
    for g in ("u", None):
        own, all_rows = counts[counts.g.isna() if g is None else counts.g == g].head(400), x[:, 0][np.arange(n) % 5 == 0] if g is None else x[:, 0][np.arange(n) % 5 > 0]
        gap = np.abs(own.x0.to_numpy()[:, None] - all_rows[None])
        assert own.m.tolist() == ((gap < own.radius.to_numpy()[:, None]) | (gap == 0)).sum(1).tolist()
    points.unpersist()


def test_information_equals_one_array(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(2, 700))
    data = pd.DataFrame({"x": z[0] + rng.normal(size=700), "y": z[0] + 0.5 * rng.normal(size=700), "z": z[0], "g": "a"})
    df = spark.createDataFrame(data).repartition(3)
    (one,) = N.information(df, "g", ["x"], ["y"]).collect()
    assert one.n == 700 and one.nats == pytest.approx(ci.knn_cmi(data.x, data.y), abs=1e-9)
    (given,) = N.information(df, "g", ["x"], ["y"], ["z"], 3).collect()
    assert given.nats == pytest.approx(ci.knn_cmi(data.x, data.y, data.z, 3), abs=1e-9)


def test_discrete_columns_give_their_plain_information(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, 9000)
    data = pd.DataFrame({"x": x, "y": np.where(rng.random(9000) < 0.7, x, rng.integers(0, 3, 9000)), "u": rng.integers(0, 3, 9000), "g": np.repeat(["a", "b"], 4500)})
    df = spark.createDataFrame(data)
    for col in ("y", "u"):
        for r in N.information(df, "g", ["x"], [col]).collect():
            own = data[data.g == r.g]
            joint = np.histogram2d(own.x, own[col], bins=3)[0] / len(own)
            want = np.nansum(joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True)))
            assert r.nats == pytest.approx(want, abs=0.01)


def test_entropy(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"g": "a", "x": rng.normal(size=700), "y": rng.uniform(size=700)})
    (got,) = N.entropy(spark.createDataFrame(data).repartition(3), "g", ["x", "y"]).collect()
    assert got.n == 700 and got.nats == pytest.approx(knn_entropy(data[["x", "y"]].to_numpy()), abs=1e-9)


def test_edges(spark):
    schema = "g string, x double, y double"
    assert N.information(spark.createDataFrame([], schema), "g", ["x"], ["y"]).collect() == []
    few = spark.createDataFrame([("a", 1.0, 2.0), ("a", float("nan"), 1.0), ("a", None, 1.0), ("a", 2.0, 3.0)], schema)
    points = N.points_of(few, "g", ["x", "y"])
    assert points.count() == 2 and [r.radius for r in N.distances(points, ["x0", "x1"], 3).collect()] == [float("inf")] * 2


def test_one_far_value_does_not_fill_a_cell(spark):
    data = pd.DataFrame({"g": "a", "v": np.append(np.random.default_rng(0).normal(size=20_000), 1e9)})
    cells = row_tests._cell(spark.createDataFrame(data), "g", "v").groupBy("_cell").count().toPandas()
    assert cells["count"].max() < 600
