"""Own changepoints per mechanism."""

import itertools

import numpy as np
import pandas as pd
import pytest

from shiftscope.plans.hybrid import HybridLagged


def series(length=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for context in (0, 1):
        x, y, z = (np.zeros(length) for _ in range(3))
        noise = rng.normal(size=(3, length))
        for t in range(2, length):
            x[t] = 0.5 * x[t - 1] * (-1 if t >= 240 else 1) + noise[0, t]
            y[t] = (1.5 if t < 120 else -1.5) * x[t - 2] + 0.5 * noise[1, t]
            z[t] = (0.9 if context == 0 else -0.9) * y[t - 1] + 0.5 * noise[2, t]
        rows.append(pd.DataFrame({"context": context, "t": np.arange(length), "x": x, "y": y, "z": z}))
    return pd.concat(rows)


@pytest.fixture(scope="module")
def model(spark):
    return HybridLagged(["x", "y", "z"], max_lag=2, grain=40, min_duration=40).fit(spark.createDataFrame(series()).repartition(5))


def test_cuts_that_differ_by_node(spark, model):
    assert {(r.child, r.parent, r.lag) for r in model.edges(spark).collect()} >= {("x", "x", 1), ("y", "x", 2), ("z", "y", 1)}
    assert len(model.edges(spark).collect()) <= 4
    assert model.cuts == {0: [240], 1: [120], 2: []}
    spans = {(r.child, r.begin, r.end) for r in model.segments(spark).collect()}
    assert spans == {("x", 0, 240), ("x", 240, 400), ("y", 0, 120), ("y", 120, 400), ("z", 0, 400)}


def test_the_segmentation_is_the_best_of_all(model):
    from shiftscope.functions.scores import partition_contexts

    for child, parents in ((0, (3,)), (1, (6,)), (2, (4,))):
        table = model._whole.of((child, parents))
        total = lambda a, b: partition_contexts([sum(g for (c, w), g in table.items() if c == name and a <= int(w) < b) for name in ("0", "1")])[0]
        m = model._cells
        best = min(sum(total(a, b) for a, b in zip((0, *cuts), (*cuts, m), strict=True)) for k in range(4) for cuts in itertools.combinations(range(1, m), k))
        assert model._segmented(child, parents)[0] <= best + 1e-6


def test_lags_are_exchanged(spark, model):
    other = HybridLagged(["x", "y", "z"], max_lag=2, grain=40)
    other.__dict__.update({k: v for k, v in model.__dict__.items() if k not in ("parents", "cuts", "grain", "min_duration")})
    other.parents = {0: {3}, 1: {3}, 2: {7}}  # y from x one step ago, z from y two steps ago
    for j in (1, 2):
        other._refine_lags(j)
    assert other.parents[1] == {6} and other.parents[2] == {4}
    other.parents = {0: {3}, 1: {6, 5}, 2: {4}}
    other._refine_parents(1)
    assert other.parents[1] == {6}


def test_empty_and_short(spark):
    schema = "context int, t long, x double, y double"
    empty = HybridLagged(["x", "y"]).fit(spark.createDataFrame([], schema))
    assert empty.edges(spark).collect() == []
    short = HybridLagged(["x", "y"], grain=5, min_duration=50).fit(spark.createDataFrame([(0, t, float(t % 3), float(t % 2)) for t in range(12)], schema))
    assert short.cuts[0] == []
