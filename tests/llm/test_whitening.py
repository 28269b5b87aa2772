import numpy as np
import pytest
from pyspark.sql import types as T

from shiftscope.llm import whitening

WIDE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType()), T.StructField("part", T.StringType()), T.StructField("n", T.StringType())])


def by_hand(rows):
    """Whitened rows from exact integers and LAPACK's eigenvectors."""
    xs = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows}
    fit = np.array(sorted({tuple(x) for x in xs.values()}))
    n, sums = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    return {i: (int(((n * x - sums) ** 2).sum()), (x - sums / n) @ axes[:, :4] / np.sqrt(values[:4])) for i, x in xs.items()}, n, values / values.sum()


def test_eigen_of_known_matrices():
    rng = np.random.default_rng(3)
    for m in (np.zeros((3, 3)), np.diag([1.0, 5.0, 3.0]), np.ones((6, 6)), np.array([[2.0]]), np.diag([1e-12, 1.0, 1e12])):
        values, axes = whitening.symmetric_eigen(m)
        assert np.allclose(axes @ np.diag(values) @ axes.T, m, atol=1e-12 * max(1, np.abs(m).max())) and np.allclose(axes.T @ axes, np.eye(len(m)), atol=1e-12)
    a = rng.normal(size=(200, 40))
    values, axes = whitening.symmetric_eigen(a.T @ a)
    assert np.allclose(values, np.linalg.eigvalsh(a.T @ a)[::-1], rtol=1e-12, atol=1e-12)
    assert np.allclose(a.T @ a @ axes, axes * values, atol=1e-11)


def test_merged_states_equal_one_pass():
    rows = np.random.default_rng(0).integers(-500, 500, (301, 7)) + 10**6
    whole, merged = whitening.Welford(7), whitening.Welford(7)
    whole.count_in(rows), whole.add(rows)
    for part in np.array_split(rows, 5):
        state = whitening.Welford(7)
        state.count_in(part), state.add(part)
        merged.merge(state.n, state.sums, state.mean, state.products)
    assert merged.n == 301 and merged.sums == rows.sum(0).tolist() == whole.sums
    assert np.allclose(merged.products, np.cov(rows.T, bias=True) * 301, rtol=1e-10) and np.allclose(whole.products, merged.products, rtol=1e-9)


def test_query_equals_by_hand(spark, sf_dir):
    got = whitening.query(spark, sf_dir).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, n, explained = by_hand(rows)
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got}.__len__() == 1 and got[0]["identity_error"] < 1e-9
    for k in range(4):
        ours = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        sign = np.sign(sum(ours[i] * want[i][1][k] for i in ours))
        assert max(abs(sign * ours[i] - want[i][1][k]) for i in ours) < 1e-9
    for r in got:
        assert r["deviation"] == want[r["vec_id"]][0] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, -1.0, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [1.0, inf, 1.0]), (6, [1.0]), (7, [4.0, 4.0, 1.0]), (8, []), (9, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], WIDE)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    assert model.n == 3 and len(got) == 4 * 3 and {r["vec_id"] for r in got} == {1, None, 7}
    want, _, _ = by_hand([(i, v) for i, v in rows if i in (1, None, 7)])
    assert all(r["deviation"] == want[r["vec_id"]][0] for r in got)
    # three vectors span two directions
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got) and model.identity_error < 1e-9
    same = [r["whitened"] for r in got if r["vec_id"] == 1 and r["component"] == 1]
    assert len(same) == 2 and same[0] == same[1]


def test_one_and_no_vector(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], "a", "b", "c")] * 3, WIDE)
    got = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(got) == 6 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in got)
    assert whitening.fit(spark.createDataFrame([], WIDE)) is None
    assert whitening.fit(spark.createDataFrame([(1, None, "a", "b", "c"), (2, [], "a", "b", "c")], WIDE)) is None


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2**40 + 4096 * i * i), float(i)]) for i in range(6)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], WIDE)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, whitening.fit(df)).collect()}
    xs = [[int(np.float32(v)) * 256 for v in r[1]] for r in rows]
    distinct = {tuple(x) for x in xs}
    n, sums = len(distinct), [sum(x[k] for x in distinct) for k in range(2)]
    for i, x in enumerate(xs):
        want = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        assert got[i] == (want if want < 2**63 else None)


@pytest.mark.parametrize("far", [1 << 20, 1 << 40])
def test_deviations(far):
    x = np.array([[far, 0], [-far, 3]])
    model = whitening.Whitening(3, [5, -7], np.ones(2), np.eye(2))
    want = [(3 * far - 5) ** 2 + 49, (-3 * far - 5) ** 2 + 16**2]
    assert model.deviations(x) == [v if v < 2**63 else None for v in want]
