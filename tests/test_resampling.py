"""Bootstrap and interpolation against plain loops."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from shiftscope.operators import resampling as R


def test_copies_follow_a_poisson_distribution(spark):
    from pyspark.sql import functions as F

    rows = R.drawn(spark.range(20_000), "id", 6, 1).withColumnRenamed("_w", "w")
    got = rows.groupBy("rep").agg(F.avg("w").alias("mean"), F.variance("w").alias("var"), F.avg((F.col("w") == 0).cast("int")).alias("none")).collect()
    assert len(got) == 6
    for r in got:
        assert r.mean == pytest.approx(1, abs=0.03) and r.var == pytest.approx(1, abs=0.05) and r.none == pytest.approx(np.exp(-1), abs=0.015)


def test_bootstrap_equals_a_loop(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"g": rng.choice(["a", "b"], 300), "k": rng.integers(0, 200, 300), "v": rng.normal(5, 2, 300)})
    data.loc[::9, "v"] = np.nan
    df = spark.createDataFrame([(g, int(k) if k else None, None if np.isnan(v) else float(v)) for g, k, v in data.itertuples(index=False)], "g string, k long, v double").repartition(5)
    got = {(r.g, r.rep): r for r in R.bootstrap(df, ["g"], "k", ["v"], 7, 3).collect()}
    bounds = R.poisson_bounds()
    for rep in range(7):
        weight = [sum(int(hashlib.md5(f"3 {rep // 4} {k}".encode()).hexdigest()[8 * (rep % 4) :][:8], 16) / 2**32 >= b for b in bounds) if k else 0 for k in data.k]
        for g in "ab":
            own = (data.g == g).to_numpy()
            w, v = np.array(weight)[own], data.v.to_numpy()[own]
            some = ~np.isnan(v)
            assert got[g, rep].n == w.sum() and got[g, rep].mean_v == pytest.approx((w * np.nan_to_num(v)).sum() / w[some].sum())


def test_interval_covers_what_it_should(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "k": np.arange(2000), "v": rng.exponential(size=2000)}))
    (r,) = R.intervals(R.bootstrap(df, ["g"], "k", ["v"], 100), ["g"], "mean_v").collect()
    assert r.error == pytest.approx(1 / np.sqrt(2000), rel=0.25) and r.low < r.centre < r.high and r.reps == 100


@pytest.mark.parametrize("size", [7, 100_000])
def test_interpolation_equals_numpy(spark, monkeypatch, size):
    monkeypatch.setattr(R, "RANGE_ROWS", size)
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"g": rng.choice(["a", "b", None], 300), "x": rng.integers(-40, 200, 300), "y": np.where(rng.random(300) < 0.2, rng.normal(size=300), np.nan)})
    rows = [(g, int(x), None if np.isnan(y) else float(y)) for g, x, y in data.itertuples(index=False)] + [("none", 1, None), ("a", None, 5.0)]
    got = R.interpolated(spark.createDataFrame(rows, "g string, x long, y double").repartition(4), "x", "y", ["g"]).toPandas()
    for g in ("a", "b", None):
        own = data[data.g.isna() if g is None else data.g == g]
        known = own.dropna(subset=["y"]).groupby("x")["y"].mean()
        mine = got[got.g.isna() if g is None else got.g == g].sort_values("x")
        assert mine.x.tolist() == sorted(set(own.x)) and np.allclose(mine.value, np.interp(mine.x, known.index, known.to_numpy()))
    assert got[got.g == "none"].value.isna().tolist() == [True]
    alone = R.interpolated(spark.createDataFrame([(0, 1.0), (5, None), (10, 3.0)], "x long, y double"), "x", "y").collect()
    assert sorted((r.x, r.value) for r in alone) == [(0, 1.0), (5, 2.0), (10, 3.0)]
    assert R.interpolated(spark.createDataFrame([], "x long, y double"), "x", "y").collect() == []
