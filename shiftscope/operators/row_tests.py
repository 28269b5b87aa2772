"""Independence and two-sample tests over all rows of every group; what reaches the driver is small.

``functions.independence`` has the same tests on one array of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from shiftscope.functions import independence as ci
from shiftscope.functions.numerics import normal_sf
from shiftscope.operators import scoring
from shiftscope.functions.scores import Basis

#: ranges of a group, a power of two
CELLS = 256


def _cell(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Adds ``_cell``, ranges of ``value`` that hold about as many rows each within their group, in order: the number of bounds below it, by halving."""
    points = F.array(*(F.lit(i / CELLS) for i in range(1, CELLS)))
    bounds = rows.groupBy(by).agg(F.percentile_approx(value, points, 2000).alias("_bounds"))  # CELLS numbers per group
    rows = rows.join(F.broadcast(bounds), by).withColumn("_cell", F.lit(0))
    step = CELLS // 2
    while step:
        rows = rows.withColumn("_cell", F.col("_cell") + F.when(F.get("_bounds", F.col("_cell") + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return rows.drop("_bounds")


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0, in the order of numeric columns) and ``size`` per group; windows see one range of the first column."""
    rows = _cell(rows, by, order[0])
    cells = rows.groupBy(by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(by)
    cells = cells.select(by, "_cell", (F.sum("_n").over(group.orderBy("_cell")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("size"))  # at most CELLS rows per group
    rows = rows.withColumn("_r", F.row_number().over(W.partitionBy(by, "_cell").orderBy(*order))).join(F.broadcast(cells), [by, "_cell"])
    return rows.withColumn("rank", F.col("_before") + F.col("_r") - 1).drop("_cell", "_before", "_r")


def ks(rows: DataFrame, by: str, value: str, side: str) -> dict:
    """Per group: KS statistic and p of ``value`` between sides 0 and 1, and the median of each side."""
    counts = rows.groupBy(by, value).agg(*(F.sum(F.when(F.col(side) == s, 1).otherwise(0)).alias(f"n{s}") for s in (0, 1)))
    counts = _cell(counts, by, value)
    group = W.partitionBy(by)
    cells = counts.groupBy(by, "_cell").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    cells = cells.select(by, "_cell", *(e for s in "01" for e in ((F.sum(f"c{s}").over(group.orderBy("_cell")) - F.col(f"c{s}")).alias(f"b{s}"), F.sum(f"c{s}").over(group).alias(f"t{s}"))))
    inner = W.partitionBy(by, "_cell").orderBy(value)
    run = counts.withColumns({f"r{s}": F.sum(f"n{s}").over(inner) for s in "01"}).join(F.broadcast(cells), [by, "_cell"])
    run = run.withColumns({f"r{s}": F.col(f"r{s}") + F.col(f"b{s}") for s in "01"})
    middle = lambda s, up: F.min(F.when(F.col(f"r{s}") > F.floor((F.col(f"t{s}") - (0 if up else 1)) / 2), F.col(value)))
    found = run.groupBy(by).agg(F.max(F.abs(F.col("r0") / F.col("t0") - F.col("r1") / F.col("t1"))).alias("ks"), F.max("t0").alias("t0"), F.max("t1").alias("t1"), *(((middle(s, False) + middle(s, True)) / 2).alias(f"m{s}") for s in "01"))
    return {r[by]: (r["ks"], ci.ks_p(r["ks"], r["t0"], r["t1"]), (r["m0"], r["m1"])) for r in found.collect()}


def regression_tests(rows: DataFrame, by: str, x: str, y: str, z: str, side: str) -> dict:
    """Per group: Fisher's z of x and y given z, and the linear mechanism test of y given z between two sides; one pass."""
    cols = [x, z, y]
    basis = Basis("lin", *scoring.column_stats(rows, cols))
    grams: dict = {}
    for (g, s), m in scoring.grams(rows, cols, [by, side], [(2, (0, 1))], basis)[2, (0, 1)].items():
        grams.setdefault(g, {})[int(s)] = m
    out = {}
    for g, sides in grams.items():
        both = sum(sides.values())
        n = both[0, 0]
        cov = both[1:, 1:] / n - np.outer(both[0, 1:], both[0, 1:]) / n**2
        d = np.sqrt(np.maximum(1e-300, np.diag(cov)))
        # columns of the matrix are x, z, y
        out[g] = {"fisherz": ci.fisher_z(cov / np.outer(d, d), int(n), 0, 2, (1,)), "linear": ci.linear_params_grams(*(m[np.ix_([0, 2, 3], [0, 2, 3])] for m in sides.values()))}
    return out


def residual_test(rows: DataFrame, by: str, x: str, y: str, side: str) -> dict:
    """``invariant_residuals`` per group: a pooled cubic regression from cross products, then KS of all residuals."""
    centre, scale = scoring.column_stats(rows, [x, y])
    basis = Basis("cub", centre, scale)
    weights = []
    for (g,), m in scoring.grams(rows, [x, y], [by], [(1, (0,))], basis)[1, (0,)].items():
        weights.append((g, *map(float, np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=1e-12)[0])))
    table = rows.sparkSession.createDataFrame(weights, f"{by} string, w0 double, w1 double, w2 double, w3 double")  # one row per group
    u = (F.col(x) - float(basis.centre[0])) / float(basis.scale[0])
    left = rows.join(F.broadcast(table), by).select(by, side, (F.col(y) - (F.col("w0") + u * (F.col("w1") + u * (F.col("w2") + u * F.col("w3"))))).alias("_res"))
    first = ks(left, by, "_res", side)
    medians = rows.sparkSession.createDataFrame([(g, *map(float, m)) for g, (_, _, m) in first.items()], f"{by} string, m0 double, m1 double")
    spread = left.join(F.broadcast(medians), by).select(by, side, F.abs(F.col("_res") - F.when(F.col(side) == 0, F.col("m0")).otherwise(F.col("m1"))).alias("_res"))
    second = ks(spread, by, "_res", side)
    return {g: (max(first[g][0], second[g][0]), min(1.0, 2 * min(first[g][1], second[g][1]))) for g in first}


def classifier(rows: DataFrame, by: str, x: str, y: str, z: str, seed: int = 0) -> dict:
    """``classifier_two_sample`` per group of ``ranked`` rows: rows against rows with x of a neighbour in z, trained on the first half."""
    cols = [x, y, z]
    stats = rows.groupBy(by).agg(*(e for c in cols for e in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    part = rows.join(F.broadcast(stats), by)
    part = part.select(by, "rank", "size", *(((F.col(c) - F.col(f"a_{c}")) / F.when(F.col(f"s_{c}") < 1e-12, 1.0).otherwise(F.col(f"s_{c}"))).alias(f"_{n}") for c, n in zip(cols, "xyz", strict=True)))
    part = part.withColumn("_near", F.rint(F.col("_z") * 10)).withColumn("_draw", F.xxhash64(F.lit(seed), "rank"))
    # the first row of a neighbourhood takes x of the last one of the neighbourhood before, in a ring
    ends = part.groupBy(by, "_near").agg(F.max_by("_x", F.struct("_draw", "rank")).alias("_end"))
    ring = W.partitionBy(by).orderBy("_near")  # one row per neighbourhood
    ends = ends.select(by, "_near", F.coalesce(F.lag("_end").over(ring), F.last("_end").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_end"))
    inner = W.partitionBy(by, "_near").orderBy("_draw", "rank")
    part = part.withColumn("_lag", F.lag("_x").over(inner)).join(F.broadcast(ends), [by, "_near"])
    part = part.select(by, (F.col("rank") < F.floor(F.col("size") / 2)).alias("train"), "_x", F.coalesce("_lag", "_end").alias("_s"), "_y", "_z").persist()
    fields = [f.dataType.simpleString() for f in part.schema.fields if f.name == by][0]

    def cross(m: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(m), 1)), m, (m[:, :, None] * m[:, None, :]).reshape(len(m), -1)])

    def total(train: bool, of) -> dict:
        """Sums per group of what ``of`` gives for the features of a batch's real and swapped rows."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for batch in batches:
                for g, b in batch.groupby(by, sort=False):
                    rest = b[["_y", "_z"]].to_numpy()
                    for label, name in ((1.0, "_x"), (0.0, "_s")):
                        v = of(g, cross(np.hstack([b[[name]].to_numpy(), rest])), label)
                        held[g] = held[g] + v if g in held else v
            if held:
                yield pd.DataFrame([(g, v.tobytes()) for g, v in held.items()], columns=[by, "v"])

        out: dict = {}
        for r in part.where(F.col("train") == train).mapInPandas(run, f"{by} {fields}, v binary").collect():  # one small row per partition and group
            out[r[by]] = out.get(r[by], 0) + np.frombuffer(bytes(r["v"]))
        return out

    weights = {r[by]: np.zeros(13) for r in stats.select(by).collect()}
    open_ = set(weights)
    for _ in range(30):
        held = {g: weights[g] for g in open_}

        def slopes(g, a: np.ndarray, label: float) -> np.ndarray:
            if g not in held:
                return np.zeros(13 * 14)
            p = 1 / (1 + np.exp(-np.clip(a @ held[g], -30, 30)))
            return np.concatenate([(a.T @ (a * (p * (1 - p))[:, None])).ravel(), a.T @ (label - p)])

        for g, v in total(True, slopes).items():
            if g in open_:
                step = np.linalg.solve(v[:169].reshape(13, 13) + np.eye(13), v[169:] - weights[g])
                weights[g] = weights[g] + step
                if np.abs(step).max() < 1e-8:
                    open_.discard(g)
        if not open_:
            break
    hits = total(False, lambda g, a, label: np.array([float(((a @ weights[g] > 0) == (label > 0)).sum()), float(len(a))]))
    part.unpersist()
    return {g: (hit / n, normal_sf((hit / n - 0.5) / (0.25 / n) ** 0.5)) for g, (hit, n) in hits.items()}
