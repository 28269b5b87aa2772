"""Bootstrap with replacement and interpolation between known values, over any number of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: rows of a range of values
RANGE_ROWS = 100_000
#: the most copies of a row that a draw can have; more have a chance of 1e-11
MOST_COPIES = 12
#: draws that one hash gives, of 32 bits each
PER_HASH = 4


def poisson_bounds() -> list[float]:
    """Chances of at most 0, 1, ... copies under a Poisson distribution of mean one."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(MOST_COPIES):
        total += term
        out.append(total)
        term /= k + 1
    return out


def copies(uniform: Column) -> Column:
    """Copies of a row in a sample drawn with replacement, from a number between 0 and 1."""
    out = F.lit(MOST_COPIES)
    for k, bound in reversed(list(enumerate(poisson_bounds()))):
        out = F.when(uniform < bound, k).otherwise(out)
    return out


def drawn(rows: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """``rows`` once for each repetition (``rep``) with its copies (``_w``): from 32 bits each of the MD5 of seed, block of repetitions and key as text."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // PER_HASH))))
    blocks = blocks.withColumn("_md5", F.md5(F.concat(F.lit(f"{seed} "), F.col("_block").cast("string"), F.lit(" "), F.col(key).cast("string"))))
    parts = F.array(*(F.conv(F.substring("_md5", 1 + 8 * k, 8), 16, 10).cast("double") / float(1 << 32) for k in range(PER_HASH)))
    each = blocks.select(*rows.columns, "_block", F.posexplode(parts).alias("_k", "_u")).withColumn("rep", F.col("_block") * PER_HASH + F.col("_k"))
    return each.where(F.col("rep") < reps).select(*rows.columns, "rep", copies(F.col("_u")).alias("_w"))


def bootstrap(df: DataFrame, by: list[str], key: str, values: list[str], reps: int = 100, seed: int = 0) -> DataFrame:
    """(``by``, rep, n, mean_<value> ...): means of samples drawn with replacement, all repetitions in one pass.

    Rows of one key are drawn together.  A draw of n rows with replacement is held by
    Poisson numbers of copies, so tasks need not know each other: weighted sums
    leave each task, one row per group and repetition.  Rows of a key are summed before they
    are drawn.  Null values count in no mean, rows of a null key in no sample; a group
    that a repetition draws nothing of has n 0.
    """
    sums = [e for v in values for e in (F.sum(v).alias(f"_s_{v}"), F.count(v).alias(f"_n_{v}"))]
    rows = df.where(F.col(key).isNotNull()).groupBy(*by, F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"), *sums)
    total = [e for v in values for e in (F.sum(F.col("_w") * F.col(f"_s_{v}")).alias(f"_s_{v}"), F.sum(F.col("_w") * F.col(f"_n_{v}")).alias(f"_n_{v}"))]
    held = drawn(rows, "_key", reps, seed).groupBy(*by, "rep").agg(F.sum(F.col("_w") * F.col("_rows")).alias("n"), *total)
    return held.select(*by, "rep", "n", *(F.when(F.col(f"_n_{v}") > 0, F.col(f"_s_{v}") / F.col(f"_n_{v}")).alias(f"mean_{v}") for v in values))


def intervals(reps: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(``by``, reps, centre, error, low, high) of a value over the repetitions; as many rows per group as repetitions."""
    return reps.groupBy(*by).agg(
        F.count(value).alias("reps"), F.avg(value).alias("centre"), F.stddev_samp(value).alias("error"), F.percentile(value, F.lit(low)).alias("low"), F.percentile(value, F.lit(high)).alias("high")
    )


def interpolated(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(``by``, x, value) for every distinct x: the mean of its known values of y, else the straight line between the nearest known ones.

    Beyond the first and last known value the nearest holds; a group without any has nulls.
    Windows see one range of x; what a range needs from the others is its neighbours'
    nearest known point, carried over in a table of one row per range and group.
    """
    by = list(by)
    points = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.avg(y).alias("_y"))
    parts = min(512, max(1, -(-points.count() // RANGE_ROWS)))
    found = points.agg(F.percentile_approx(F.col(x).cast("double"), [i / parts for i in range(1, parts)] or [1.0], 10_000).alias("at")).first()["at"]
    bounds = sorted({float(v) for v in found or []}) if parts > 1 else []
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda v: v < F.col(x))) if bounds else F.lit(0)
    rows = points.withColumn("_cut", cut).withColumn("_p", F.when(F.col("_y").isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col("_y").alias("y"))))
    edges = rows.groupBy(*by, "_cut").agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
    order = W.partitionBy(*by).orderBy("_cut")
    edges = edges.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), F.col("_cut").alias("_c"), F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    inner = W.partitionBy(*by, "_cut").orderBy(x)
    rows = rows.withColumns({"_l": F.last("_p", True).over(inner.rowsBetween(W.unboundedPreceding, 0)), "_r": F.first("_p", True).over(inner.rowsBetween(0, W.unboundedFollowing))})
    same = F.col("_cut") == F.col("_c")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    rows = rows.join(edges, same).withColumns({"_l": F.coalesce("_l", "_before"), "_r": F.coalesce("_r", "_after")})
    line = F.col("_l.y") + (F.col("_r.y") - F.col("_l.y")) * (F.col(x) - F.col("_l.x")) / (F.col("_r.x") - F.col("_l.x"))
    value = F.when(F.col("_y").isNotNull(), F.col("_y")).when(F.col("_l").isNull(), F.col("_r.y")).when(F.col("_r").isNull(), F.col("_l.y")).otherwise(line)
    return rows.select(*by, x, value.alias("value"))
