"""Moments, ranks and checks where rounding, skew or many partitions could spoil them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftscope.functions import scores
from shiftscope.operators import labels, moments


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(0)
    rows = [(int(c), float(x), float((1 + c // 2) * x + rng.normal())) for c in range(4) for x in rng.normal(size=60)]
    return spark.createDataFrame(rows, "c int, x double, y double")


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_bits_keep_their_digits_under_an_offset(lines, offset):
    plain = {(r.c1, r.c2): r.delta_bits for r in moments.context_delta_bits(lines, "c", "y", "x").collect()}
    moved = lines.withColumns({"x": F.col("x") + offset, "y": F.col("y") - offset})
    for r in moments.context_delta_bits(moved, "c", "y", "x").collect():
        assert r.delta_bits == pytest.approx(plain[r.c1, r.c2], rel=1e-4, abs=1e-3)


def test_merged_states_are_those_of_the_union(lines):
    state = moments.moment_state(lines.where("c < 2"), ["c"], "y", "x").collect()
    whole = moments.moment_state(lines.where("c < 2").withColumn("c", F.lit(0)), ["c"], "y", "x").first()
    spark = lines.sparkSession
    both = spark.createDataFrame([(*state[0][1:], *state[1][1:])], [f"{p}{f}" for p in ("a_", "b_") for f in moments.STATE])
    got = both.select(*(c.alias(f) for f, c in moments.merged("a_", "b_").items())).first()
    assert [got[f] for f in moments.STATE] == pytest.approx([whole[f] for f in moments.STATE])


def test_a_constant_column_explains_nothing(spark):
    rows = spark.createDataFrame([(c, 5.0, float(i)) for c in (0, 1) for i in range(9)], "c int, x double, y double")
    assert moments.context_delta_bits(rows, "c", "y", "x").first().delta_bits == pytest.approx(0, abs=1e-9)


def test_running_totals_over_many_cuts(spark, monkeypatch):
    monkeypatch.setattr(moments, "RANGE_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(float(v), int(f)) for v, f in zip(np.concatenate([np.zeros(200), rng.normal(size=400)]), rng.integers(0, 2, 600))]
    df = spark.createDataFrame(rows, "v double, f int").repartition(13)
    found = moments.ks_statistic(df, "v", "f").first()
    values = np.array(rows)
    at = np.unique(values[:, 0])
    steps = [np.searchsorted(np.sort(values[values[:, 1] == s, 0]), at, side="right") / (values[:, 1] == s).sum() for s in (0, 1)]
    assert found.ks == pytest.approx(np.abs(steps[0] - steps[1]).max()) and found.n0 + found.n1 == 600
    u = {r.v: (r.v_u, r.v_r) for r in moments.ranks(moments.rank_uniform(df, ["v"]), ["v"]).collect()}
    for v in at[::17]:
        less, same = (values[:, 0] < v).sum(), (values[:, 0] == v).sum()
        assert u[v] == pytest.approx(((less + same) / 600, less + (same + 1) / 2))


def test_checks(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, 2.0), (float("inf"), 3.0)], "a double, b double")
    got = {r.column: (r.rows, r.nulls, r.nans, r.infs, r.too_few_rows) for r in moments.data_check(df, ["a", "b"]).collect()}
    assert got == {"a": (3, 1, 0, 1, False), "b": (3, 0, 1, 0, False)}
    assert moments.checked(df.select("b"), ["b"], nan=True).count() == 3
    with pytest.raises(Exception, match="null, NaN or infinity"):
        moments.checked(df, ["a"]).collect()


def test_terms_and_permutations(spark):
    df = spark.range(50).select("id", (F.col("id") - 2).cast("double").alias("x"))
    for function, single in [(k, False) for k in range(9)] + [(k, True) for k in range(8)]:
        terms = moments.basis_terms(F.col("x"), function, single)
        row = df.where("x = 3").select(*terms).first()
        powers = {0: [3], 1: [3, 9], 2: [3, 9, 27], 6: [3, 9, 27, 81]}
        want = (powers[function][-1:] if single else powers[function]) if function in powers else [{3: math.exp(3), 4: 1 / 3, 5: 1 / 9, 7: math.sqrt(3), 8: 1 / math.sqrt(3)}[function]]
        assert list(row) == pytest.approx(want)
    assert df.where("x = 0").select(*moments.basis_terms(F.col("x"), 4)).first()[0] == pytest.approx(1e4)
    mixed = moments.shuffled(df, "id", "x", 3)
    assert sorted(r.x for r in mixed.collect()) == sorted(r.x for r in df.collect()) and mixed.exceptAll(df).count() > 30
    ties = spark.range(40).select("id", F.lit(1.0).alias("x"))
    noise = [r.x for r in moments.jittered(ties, ["x"], "id").collect()]
    assert len(set(noise)) == 40 and abs(np.mean(noise) - 1) < 1e-5 and noise == [r.x for r in moments.jittered(ties, ["x"], "id").collect()]


def test_cantor_in_whole_numbers(spark):
    a, b = 1_200_000_001, 1_200_000_002
    df = spark.createDataFrame([(a, b), (3, 4), (60_000, 60_000)], "a long, b long")
    assert [r[0] for r in df.select(labels.cantor(F.col("a"), F.col("b"))).collect()] == [(x + y) * (x + y + 1) // 2 + y for x, y in ((a, b), (3, 4), (60_000, 60_000))]
    assert df.where("a = 60000").select(labels.cantor(F.col("a").cast("int"), F.col("b").cast("int"))).first()[0] == 120_000 * 120_001 // 2 + 60_000


def test_kernel_bits_compare_with_and_without_parents():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 1)), rng.normal(size=80)
    for scale in (1.0, 20_000.0):
        noise, none = scores.gp_bits(x, scale * y), scores.null_bits(scale * y)
        assert none < noise < none + 40
        assert scores.gp_bits(x, scale * (np.sin(2 * x[:, 0]) + 0.05 * y)) < scores.null_bits(scale * (np.sin(2 * x[:, 0]) + 0.05 * y)) - 50
