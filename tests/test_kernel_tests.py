"""Kernel tests over all rows: level, power and agreement with the exact tests."""

import numpy as np
import pandas as pd
import pytest

from shiftscope.functions import independence as ci
from shiftscope.operators import kernel_tests as K


def frame(spark, groups):
    return spark.createDataFrame(pd.concat([pd.DataFrame(v).assign(g=g) for g, v in groups.items()])).repartition(3)


def null_and_dependent(kind, n, rng):
    z = rng.normal(size=n)
    noise = rng.normal(size=(2, n))
    x = np.sin(2 * z) + 0.5 * noise[0]
    y = z**2 + 0.5 * noise[1] + (0 if kind == "free" else 0.6 * (x - np.sin(2 * z)) ** 2)
    return {"x": x, "y": y, "z": z}


def test_kci_holds_its_level_and_finds_dependence(spark):
    rng = np.random.default_rng(0)
    groups = {f"free {i}": null_and_dependent("free", 400, rng) for i in range(40)} | {f"bound {i}": null_and_dependent("bound", 400, rng) for i in range(10)}
    found = K.kci(frame(spark, groups), "g", ["x"], ["y"], ["z"])
    free, bound = ([p for g, (_, p) in found.items() if g.startswith(k)] for k in ("free", "bound"))
    assert len(free) == 40 and sum(p < 0.05 for p in free) <= 6 and 0.2 < np.median(free) < 0.8
    exact = [ci.kci(v["x"], v["y"], v["z"])[1] for g, v in groups.items() if g.startswith("bound")]
    assert sum(p < 0.05 for p in bound) >= min(8, sum(p < 0.05 for p in exact) - 1)


def test_kci_without_conditions(spark):
    rng = np.random.default_rng(1)
    groups = {}
    for i in range(20):
        x = rng.normal(size=300)
        groups[f"free {i}"] = {"x": x, "y": rng.normal(size=300)}
        groups[f"bound {i}"] = {"x": x, "y": x**2 + rng.normal(size=300)}
    found = K.kci(frame(spark, groups), "g", ["x"], ["y"])
    assert sum(p < 0.05 for g, (_, p) in found.items() if g[0] == "f") <= 4
    assert all(p < 0.01 for g, (_, p) in found.items() if g[0] == "b")


def test_mmd(spark):
    rng = np.random.default_rng(2)
    groups = {}
    for i in range(30):
        side = rng.integers(0, 2, 400)
        groups[f"same {i}"] = {"a": rng.normal(size=400), "b": rng.normal(size=400), "s": side}
        groups[f"wider {i}"] = {"a": rng.normal(size=400) * (1 + side), "b": rng.normal(size=400), "s": side}
    found = K.mmd(frame(spark, groups), "g", ["a", "b"], "s")
    assert sum(p < 0.05 for g, (_, p) in found.items() if g[0] == "s") <= 5
    assert sum(p < 0.05 for g, (_, p) in found.items() if g[0] == "w") >= 28


def test_kcd(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for i in range(30):
        side = rng.integers(0, 2, 600)
        x = rng.normal(size=600) + 0.5 * side  # the sides differ in x, which is no discrepancy
        y = np.sin(x) + 0.3 * rng.normal(size=600)
        groups[f"same {i}"] = {"x": x, "y": y, "s": side}
        groups[f"other {i}"] = {"x": x, "y": y + 0.25 * side * x, "s": side}
    found = K.kcd(frame(spark, groups), "g", ["x"], ["y"], "s")
    assert sum(p < 0.05 for g, (_, p) in found.items() if g[0] == "s") <= 5
    assert sum(p < 0.05 for g, (_, p) in found.items() if g[0] == "o") >= 27
    one = groups["other 0"]
    assert ci.kcd(one["x"], one["y"], one["s"].astype(float), 200)[1] < 0.05


def test_statistics_do_not_depend_on_partitions_and_odd_groups(spark):
    rng = np.random.default_rng(4)
    whole = {"a": null_and_dependent("bound", 200, rng), "tiny": {"x": [1.0, 2.0], "y": [1.0, None], "z": [0.0, 0.0]}, "flat": {"x": np.ones(50), "y": rng.normal(size=50), "z": np.zeros(50)}}
    df = frame(spark, whole)
    one, many = (K.kci(df.repartition(p), "g", ["x"], ["y"], ["z"]) for p in (1, 8))
    assert set(one) == {"a", "tiny", "flat"} and one["tiny"] == (0.0, 1.0) and one["flat"][1] > 0.5
    assert one["a"] == pytest.approx(many["a"], rel=1e-6)
    sides = df.selectExpr("g", "x", "y", "cast(g = 'a' as int) as s")
    assert K.mmd(sides, "g", ["x", "y"], "s")["a"] == (0.0, 1.0)
