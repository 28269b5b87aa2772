"""Moments, scaling, regression from moments, and tests that need moments alone.

All of it is grouped aggregation: one pass with partial sums before the shuffle,
then arithmetic on one row per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def _keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """A key to join statistics on; without ``by`` all rows have the same one."""
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _with_stats(df: DataFrame, by: list[str], stats: list[Column]) -> DataFrame:
    rows, keys = _keys(df, by)
    found = F.broadcast(rows.groupBy(*keys).agg(*stats))  # one row per context: dealt out by context, rows would fill as many tasks
    return rows.join(found, keys).drop("_all")


def zscore(df: DataFrame, cols: list[str], by: list[str] = (), eps: float = 0.0, guard: bool = False) -> DataFrame:
    """Add ``<col>_z`` by population deviation; ``eps`` is added to it, ``guard`` replaces one under 1e-12 by 1."""
    by = list(by)
    out = _with_stats(df, by, [s for c in cols for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    for c in cols:
        width = F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}")) if guard else F.col(f"_s_{c}") + eps
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"_m_{c}")) / F.nullif(width, F.lit(0.0))).drop(f"_m_{c}", f"_s_{c}")
    return out


def minmax(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """Add ``<col>_u`` in 0..1; null for a constant column."""
    by = list(by)
    out = _with_stats(df, by, [s for c in cols for s in (F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"))])
    for c in cols:
        span = F.nullif(F.col(f"_b_{c}") - F.col(f"_a_{c}"), F.lit(0.0))
        out = out.withColumn(f"{c}_u", (F.col(c) - F.col(f"_a_{c}")) / span).drop(f"_a_{c}", f"_b_{c}")
    return out


def inlier_rows(df: DataFrame, cols: list[str], limit: float = 3.0, by: list[str] = ()) -> DataFrame:
    """Rows with every column within ``limit`` population deviations of its mean."""
    by = list(by)
    out = _with_stats(df, by, [s for c in cols for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    for c in cols:
        out = out.where(F.abs(F.col(c) - F.col(f"_m_{c}")) <= limit * F.col(f"_s_{c}"))
    return out.select(*df.columns)


def one_hot(df: DataFrame, column: str, values: list, prefix: str = "is_") -> DataFrame:
    """Indicator columns of the given values, the first one being the reference without a column."""
    return df.withColumns({f"{prefix}{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values[1:]})


def context_moments(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Count, means, population variances and covariances of ``cols`` per group."""
    stats = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        stats += [F.avg(a).alias(f"mean_{a}"), F.var_pop(a).alias(f"var_{a}")]
        stats += [F.covar_pop(a, b).alias(f"cov_{a}_{b}") for b in cols[i + 1 :]]
    return df.groupBy(*by).agg(*stats)


def simple_ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope, intercept, r squared and population residual variance of y on x per group."""
    m = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(y, x).alias("cxy")
    )
    return from_moments(m, by)


def from_moments(m: DataFrame, keep: list[str]) -> DataFrame:
    slope = F.col("cxy") / F.col("vx")
    return m.select(
        *keep, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        (F.col("cxy") * F.col("cxy") / (F.col("vx") * F.col("vy"))).alias("r2"), (F.col("vy") - F.col("cxy") * slope).alias("var_resid"),
    )


def gaussian_bits(n: str = "n", variance: str = "var_resid") -> Column:
    """Bits to encode n residuals of a Gaussian with this variance."""
    return F.col(n) / 2 * F.log2(2 * math.pi * math.e * F.col(variance))


def moment_state(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Count, means and central moments per group: the state of a mergeable regression, which keeps its digits whatever the columns' offsets."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(y, x).alias("cxy")
    )


STATE = ("n", "mx", "my", "vx", "vy", "cxy")


def merged(a: str, b: str) -> dict[str, Column]:
    """State of the union of two groups whose states are in the columns with these prefixes."""
    (n1, mx1, my1, vx1, vy1, c1), (n2, mx2, my2, vx2, vy2, c2) = ([F.col(p + f) for f in STATE] for p in (a, b))
    n = n1 + n2
    share, apart = (n1 / n, n2 / n), n1 / n * (n2 / n)
    mix = lambda u, v: share[0] * u + share[1] * v
    dx, dy = mx1 - mx2, my1 - my2
    return {"n": n, "mx": mix(mx1, mx2), "my": mix(my1, my2), "vx": mix(vx1, vx2) + apart * dx * dx, "vy": mix(vy1, vy2) + apart * dy * dy, "cxy": mix(c1, c2) + apart * dx * dy}


#: a residual variance under this share of the target's is rounding, and none is under this value
LEAST_SHARE, LEAST_VARIANCE = 1e-15, 1e-300


def bits_of_state(prefix: str = "") -> Column:
    """Gaussian bits of the regression whose state is in the columns ``<prefix>n, <prefix>mx, ...``; a constant x explains nothing."""
    n, _, _, vx, vy, cxy = (F.col(prefix + c) for c in STATE)
    explained = F.coalesce(cxy * cxy / F.nullif(vx, F.lit(0.0)), F.lit(0.0))
    return n / 2 * F.log2(2 * math.pi * math.e * F.greatest(vy - explained, LEAST_SHARE * vy, F.lit(LEAST_VARIANCE)))


def context_delta_bits(df: DataFrame, context: str, y: str, x: str) -> DataFrame:
    """For each pair of contexts the extra bits of one common regression over two of their own.

    The pair join runs over one row of moments per context.
    """
    state = moment_state(df, [context], y, x).withColumn("bits", bits_of_state())
    fields = (*STATE, "bits")
    a = state.select(F.col(context).alias("c1"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = state.select(F.col(context).alias("c2"), *(F.col(f).alias(f"b_{f}") for f in fields))
    pairs = a.join(b, F.col("c1") < F.col("c2")).withColumns({f"p_{f}": c for f, c in merged("a_", "b_").items()})
    return pairs.select("c1", "c2", (bits_of_state("p_") - F.col("a_bits") - F.col("b_bits")).alias("delta_bits"))


def partial_correlation(x: str, y: str, z: str) -> Column:
    """Aggregate: correlation of x and y given z."""
    rxy, rxz, ryz = F.corr(x, y), F.corr(x, z), F.corr(y, z)
    return (rxy - rxz * ryz) / F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz))


def fisher_z(r: Column, n: Column, k: int) -> Column:
    """Fisher's statistic of a (partial) correlation with k conditioning columns."""
    return 0.5 * F.log((1 + r) / (1 - r)) * F.sqrt(n - k - 3)


#: values that one window of running totals sees, about
RANGE_ROWS = 1_000_000


def running_totals(counts: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """Rows of distinct values with ``<sum>_run``, the total up to and with each value, and ``<sum>_all``.

    The values are cut at fixed bounds, taken from their approximate quantiles
    once; totals run inside the cuts and get the cuts' offsets, so no window sees
    all rows and no partition's number matters.
    """
    from pyspark.sql import Window as W

    parts = min(512, max(1, -(-counts.count() // RANGE_ROWS)))
    found = counts.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)] or [1.0], 10_000).alias("at")).first()["at"]
    bounds = sorted({float(v) for v in found or []}) if parts > 1 else []
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda v: v < F.col(value))) if bounds else F.lit(0)
    rows = counts.withColumn("_cut", cut)
    before = W.orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)  # one row per cut, 512 at most
    every = W.partitionBy()
    offsets = rows.groupBy("_cut").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    offsets = offsets.select("_cut", *(F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums), *(F.sum(f"_{s}").over(every).alias(f"{s}_all") for s in sums))
    inside = W.partitionBy("_cut").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"{s}_run": F.sum(s).over(inside) for s in sums}).join(F.broadcast(offsets), "_cut")
    return rows.withColumns({f"{s}_run": F.col(f"{s}_run") + F.col(f"_b_{s}") for s in sums}).drop("_cut", *(f"_b_{s}" for s in sums))


def ks_statistic(df: DataFrame, value: str, flag: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of ``value`` between flag 0 and 1."""
    counts = df.groupBy(value).agg(F.sum(F.when(F.col(flag) == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).alias("n1"))
    rows = running_totals(counts, value, ["n0", "n1"])
    return rows.agg(F.max(F.abs(F.col("n0_run") / F.col("n0_all") - F.col("n1_run") / F.col("n1_all"))).alias("ks"), F.max("n0_all").alias("n0"), F.max("n1_all").alias("n1"))


def rank_uniform(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``<col>_u``: the empirical distribution function of each column at its value, ties taking the highest rank."""
    out = df
    for c in cols:
        rows = running_totals(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, ["_n"])
        out = out.join(rows.select(c, (F.col("_n_run") / F.col("_n_all")).alias(f"{c}_u")), c, "left")
    return out.select(*df.columns, *(f"{c}_u" for c in cols))


def ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``<col>_r``: the mean rank (from 1) of each column's value, as rank correlations take it."""
    out = df
    for c in cols:
        rows = running_totals(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, ["_n"])
        out = out.join(rows.select(c, (F.col("_n_run") - (F.col("_n") - 1) / 2).alias(f"{c}_r")), c, "left")
    return out.select(*df.columns, *(f"{c}_r" for c in cols))


def jittered(df: DataFrame, cols: list[str], key: str, scale: float = 1e-5, seed: int = 0) -> DataFrame:
    """Ties broken by seeded noise of this deviation, drawn from a hash of the row's key and column, so that every attempt gives the same."""
    unit = lambda c, k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.lit(k), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda c: F.sqrt(-2 * F.log(unit(c, 0))) * F.cos(2 * math.pi * unit(c, 1))
    return df.withColumns({c: F.col(c) + scale * normal(c) for c in cols})


def data_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column the nulls, NaNs and infinities, and whether the table has fewer rows than columns (one row per column)."""
    stats = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        v = F.col(c).cast("double")
        stats += [F.count_if(v.isNull()).alias(f"null_{c}"), F.count_if(F.isnan(v)).alias(f"nan_{c}"), F.count_if(F.abs(v) == float("inf")).alias(f"inf_{c}")]
    one = df.agg(*stats)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"null_{c}").alias("nulls"), F.col(f"nan_{c}").alias("nans"), F.col(f"inf_{c}").alias("infs")) for c in cols)))
    return one.select("rows", rows.alias("r")).select("r.column", "rows", "r.nulls", "r.nans", "r.infs", (F.col("rows") < len(cols)).alias("too_few_rows"))


def checked(df: DataFrame, cols: list[str], nan: bool = False, inf: bool = False) -> DataFrame:
    """The same rows; the query fails at the first null, NaN or infinity that isn't allowed."""
    good = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        good = good & v.isNotNull() & (F.lit(nan) | ~F.isnan(v)) & (F.lit(inf) | (F.abs(v) != float("inf")))
    return df.where(F.assert_true(good, "the data have a null, NaN or infinity").isNull())


#: terms by function id, for columns of numbers: fixed values
POWERS = {0: (1,), 1: (1, 2), 2: (1, 2, 3), 6: (1, 2, 3, 4)}
NEAR_ZERO = 1e-4


def basis_terms(x: Column, function: int, single: bool = False) -> list[Column]:
    """Terms of x for ids 0 to 8: powers up to 1, 2, 3 (6: 4), exponential (3), 1/x (4), 1/x^2 (5), root of |x| (7), 1/root of |x| (8); ``single`` keeps the highest power alone."""
    safe = lambda v: F.when(x == 0, F.lit(NEAR_ZERO)).otherwise(v)
    if function in POWERS:
        powers = POWERS[function][-1:] if single else POWERS[function]
        return [F.pow(x, F.lit(float(k))) for k in powers]
    terms = {3: lambda: F.exp(x), 4: lambda: 1 / safe(x), 5: lambda: 1 / safe(x * x), 7: lambda: F.sqrt(F.abs(x)), 8: lambda: 1 / F.sqrt(safe(F.abs(x)))}
    if function not in terms or (single and function == 8):
        raise ValueError(f"unknown function id {function}")
    return [terms[function]()]


def shuffled(df: DataFrame, key: str, column: str, seed: int = 0) -> DataFrame:
    """``df`` with ``column`` permuted over the rows by a seeded hash of ``key`` (unique): a row gets the value of the row with its rank in another order.

    The hash is the first 60 bits of the MD5 of the seed, a space and the key as text, so that other engines can tell the order.
    """
    mark = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(f"{s} "), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    marks = df.select(F.col(key).alias("_k"), F.col(column).alias("_v"), mark(seed).alias("_a"), mark(seed + 1).alias("_b"))

    def placed(order: str) -> DataFrame:
        # buckets of the hash are in order among themselves; their counts give each one's first rank
        from pyspark.sql import Window as W

        rows = marks.withColumn("_c", F.shiftright(order, 48))
        counts = rows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
        first = counts.select("_c", F.coalesce(F.sum("_n").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # 4096 buckets at most
        return rows.withColumn("_r", F.row_number().over(W.partitionBy("_c").orderBy(order, "_k"))).join(F.broadcast(first), "_c").withColumn("_place", F.col("_first") + F.col("_r"))

    moved = placed("_a").select("_place", "_k").join(placed("_b").select("_place", "_v"), "_place")
    return df.drop(column).join(moved.select(F.col("_k").alias(key), F.col("_v").alias(column)), key).select(*df.columns)


def simpson_rates(df: DataFrame, treatment: str, stratum: str, outcome: Column) -> DataFrame:
    """Outcome rates by treatment overall and within strata, and over all: grouping sets in one scan."""
    rows = df.select(F.col(treatment).alias("treatment"), F.col(stratum).alias("stratum"), outcome.cast("int").alias("hit"))
    sets = rows.groupingSets([[F.col("treatment"), F.col("stratum")], [F.col("treatment")], []], F.col("treatment"), F.col("stratum"))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("rate"))
