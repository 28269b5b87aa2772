"""Queries and tests that must see every row."""

import numpy as np
import pandas as pd
import pytest

from shiftscope.functions import independence as ci, scores
from shiftscope.operators import row_tests, scoring
from shiftscope.plans import constraint, model_queries


def test_repeated_inputs_score_like_the_full_kernel():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, 150).astype(float)
    y = np.sin(x) + 0.3 * rng.normal(size=150)
    got = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["count", "mean", lambda v: ((v - v.mean()) ** 2).sum()]).to_numpy()
    assert scores.gp_bits_repeated(np.unique(x)[:, None], *got.T) == pytest.approx(scores.gp_bits(x, y), rel=1e-6)


def test_gp_bits_counts_every_row(spark, sf_dir):
    rows = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    got = {r.l_returnflag: r for r in model_queries.gp_bits(spark, sf_dir).collect()}
    assert {f: r.n for f, r in got.items()} == rows.groupby("l_returnflag").size().to_dict()
    for f, part in rows.groupby("l_returnflag"):
        assert got[f].null_bits == pytest.approx(scores.null_bits(part["l_extendedprice"].to_numpy()))


def test_linear_cost_tests_see_every_row(spark, sf_dir):
    cols = model_queries.COLS
    rows = pd.read_parquet(f"{sf_dir}/lineitem.parquet").sort_values(cols)
    got = {(r.l_returnflag, r.test): (r.stat, r.p) for r in model_queries.independence_tests(spark, sf_dir).collect()}
    assert len(got) == 24
    for f, part in rows.groupby("l_returnflag"):
        x, y, z = (part[[c]].to_numpy() for c in ("l_discount", "l_tax", "l_quantity"))
        half = np.arange(len(part)) % 2
        want = {"fisherz": ci.fisher_z(np.corrcoef(np.hstack([x, y, z]).T), len(x), 0, 1, (2,)), "linear": ci.linear_params(z, y[:, 0], half), "residuals": ci.invariant_residuals(z, y[:, 0], half)}
        for name, pair in want.items():
            assert got[f, name] == pytest.approx(pair, rel=1e-5, abs=1e-7), (f, name)


def test_classifier_finds_what_a_sample_would_lose(spark):
    rng = np.random.default_rng(1)
    n = 20000
    z = rng.normal(size=n)
    rows = pd.DataFrame({"g": np.where(np.arange(n) % 2, "a", "b"), "z": z, "x": rng.normal(size=n), "rank": 0})
    rows["y"] = rng.normal(size=n) + 0.25 * rows["x"] * (rows["g"] == "a")
    rows = row_tests.ranked(spark.createDataFrame(rows.drop(columns="rank")).repartition(5), "g", ["y", "x", "z"])
    ranks = rows.toPandas().sort_values(["g", "y", "x", "z"])
    assert (ranks["rank"].to_numpy().reshape(2, -1) == np.arange(n // 2)).all() and (ranks["size"] == n // 2).all()
    order = rows.withColumn("rank", (rows["rank"] * 7919) % (n // 2))  # a split that does not follow y
    got = row_tests.classifier(order, "g", "x", "y", "z")
    assert got["a"][1] < 1e-4 and got["b"][1] > 0.01


def test_equal_rows_are_drawn_by_their_number(spark):
    rows = spark.createDataFrame(pd.DataFrame({"g": [0] * 6000 + [1] * 40, "v": [*np.repeat([1, 2, 3], [3000, 2000, 1000]), *range(40)]}))
    got = scoring.sampled(rows, ["g"], 600).groupBy("g", "v").count().toPandas()
    assert np.abs(got[got["g"] == 0].sort_values("v")["count"].to_numpy() - [300, 200, 100]).max() <= 1
    assert got[got["g"] == 1]["count"].tolist() == [1] * 40
    few = scoring.sampled(spark.createDataFrame([(None, 1.0)] * 50, "g string, v double"), ["g"], 10)
    assert 10 <= few.count() <= 11


def test_g_square_counts_all_rows(spark):
    rng = np.random.default_rng(2)
    z = rng.integers(0, 3, 20000)
    x, y = (z + rng.integers(0, 3, 20000)) % 5, (z + rng.integers(0, 4, 20000)) % 4
    rows = pd.DataFrame({"x": x, "y": y, "z": z})
    test = constraint.ci_test(spark.createDataFrame(rows), ["x", "y", "z"], "gsq")
    assert test(0, 1, ()) == pytest.approx(ci.g_square(x, y)[1], rel=1e-6)
    assert test(0, 1, (2,)) == pytest.approx(ci.g_square(x, y, z[:, None])[1], rel=1e-6)
    assert test(0, 2, ()) == pytest.approx(ci.g_square(x, z)[1], abs=1e-12)


def test_changes_are_those_of_the_table(spark, sf_dir):
    got = {(r.node, r.context) for r in model_queries.topological_changes(spark, sf_dir).collect()}
    assert got == {(c, f) for c in model_queries.COLS for f in "ANR"}
