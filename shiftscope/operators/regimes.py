"""Time series: lags, windows, regimes, changepoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def lag_features(df: DataFrame, series: list[str], t: str, columns: dict[str, list[int]]) -> DataFrame:
    """Add ``<column>_lag<k>`` per series; rows without all lags are dropped."""
    over = W.partitionBy(*series).orderBy(t)
    added = {f"{c}_lag{k}": F.lag(c, k).over(over) for c, ks in columns.items() for k in ks}
    return df.withColumns(added).dropna(subset=list(added))


def partition_to_windows(partition: DataFrame, skip: int) -> DataFrame:
    """(begin, duration, regime) to windows t0..tn with ``skip`` steps left out at the start."""
    return partition.select("*", (F.col("begin") + skip).alias("t0"), (F.col("begin") + F.col("duration")).alias("tn"))


def windows_to_partition(windows: DataFrame, skip: int, by: list[str]) -> DataFrame:
    """Windows (t0, tn) back to (begin, duration): a window lasts until the next one begins."""
    over = W.partitionBy(*by).orderBy("t0")
    begin = F.col("t0") - skip
    return windows.select(*by, begin.alias("begin"), F.coalesce(F.lead("t0").over(over) - skip - begin, F.col("tn") - begin).alias("duration"))


def cuts_to_windows(cuts: DataFrame, skip: int, by: list[str], cut: str = "cut") -> DataFrame:
    """Between consecutive cuts: (cut + skip, next cut - 1), the last end inclusive."""
    over = W.partitionBy(*by).orderBy(cut)
    rows = cuts.select(*by, F.col(cut).alias("a"), F.lead(cut).over(over).alias("b"), F.lead(cut, 2).over(over).alias("c"))
    return rows.where("b is not null").select(*by, (F.col("a") + skip).alias("t0"), F.when(F.col("c").isNull(), F.col("b")).otherwise(F.col("b") - 1).alias("tn"))


def rows_in_windows(rows: DataFrame, windows: DataFrame, by: list[str], t: str) -> DataFrame:
    """Range join: rows with t0 <= t < tn of a window of the same series (windows are few per series)."""
    return rows.join(windows, by).where((F.col(t) >= F.col("t0")) & (F.col(t) < F.col("tn")))


def islands(rows: DataFrame, by: list[str], t: str, label: str) -> DataFrame:
    """Runs of equal labels: (begin, end, length) per run, in order of t."""
    over = W.partitionBy(*by).orderBy(t)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(over)) & F.lag(t).over(over).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(over.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run", label).agg(F.min(t).alias("begin"), F.max(t).alias("end"), F.count(F.lit(1)).alias("length")).drop("_run")


def changepoint_scores(true: DataFrame, found: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Precision, recall and mean distance per series; a true point is met if any found one lies within tolerance.

    Without true points precision and recall are 1 if none is found, else 0.
    """
    t, f = true.select(*by, F.col("cp").alias("tcp")), found.select(*by, F.col("cp").alias("fcp"))
    near = t.join(f, by, "left").groupBy(*by, "tcp").agg(F.min(F.abs(F.col("tcp") - F.col("fcp"))).alias("d"))
    hits = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n_true"), F.sum(F.when(F.col("d") <= tolerance, 1).otherwise(0)).alias("hits"), F.avg(F.when(F.col("d") <= tolerance, F.col("d"))).alias("distance"))
    counts = f.groupBy(*by).agg(F.count(F.lit(1)).alias("n_found"))
    both = hits.join(counts, by, "full").fillna(0, ["n_true", "hits", "n_found"])
    empty = F.col("n_true") == 0
    none = F.when(F.col("n_found") == 0, 1.0).otherwise(0.0)
    return both.select(
        *by, "n_true", "n_found",
        F.when(empty, none).otherwise(F.coalesce(F.col("hits") / F.nullif(F.col("n_found"), F.lit(0)), F.lit(0.0))).alias("precision"),
        F.when(empty, none).otherwise(F.col("hits") / F.col("n_true")).alias("recall"), "distance",
    )


def moving_average(df: DataFrame, series: list[str], t: str, column: str, width: int) -> DataFrame:
    """Mean of the last ``width`` rows where there are that many."""
    over = W.partitionBy(*series).orderBy(t)
    span = over.rowsBetween(-(width - 1), 0)
    rows = df.withColumns({"moving_avg": F.avg(column).over(span), "_n": F.count(F.lit(1)).over(span)})
    return rows.where(F.col("_n") == width).drop("_n")


def unit_nll(residual: Column) -> Column:
    """Negative log likelihood of a residual under a unit Gaussian."""
    return 0.5 * math.log(2 * math.pi) + residual * residual / 2


def regime_map(labels: DataFrame) -> DataFrame:
    """Windows (window, node, label) get one regime if their labels agree for every node, numbered by first window."""
    tuples = labels.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("labels"))
    first = tuples.groupBy("labels").agg(F.min("window").alias("first"))
    named = first.withColumn("regime", F.dense_rank().over(W.orderBy("first")) - 1)
    return tuples.join(named, "labels").select("window", "regime")


def labels_of_segments(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments (begin, duration, regime) to one row per time step."""
    return segments.where("duration > 0").select(*by, F.explode(F.sequence("begin", F.col("begin") + F.col("duration") - 1)).alias("t"), "regime")


def nearest(df: DataFrame, by: list[str], column: str, target: float) -> DataFrame:
    """Per group the value nearest to a target, the lower one on ties."""
    return df.groupBy(*by).agg(F.min_by(column, F.struct(F.abs(F.col(column) - target), F.col(column))).alias("nearest"))


def block_gate(df: DataFrame, by: list[str], t: str, value: str, sentinel_below: float = -9000.0, block: int = 30, most: int = 8) -> DataFrame:
    """Groups without a block of ``block`` rows that has more than ``most`` sentinel values."""
    numbered = df.withColumn("_block", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(t)) - 1) / block))
    bad = numbered.groupBy(*by, "_block").agg(F.count_if(F.col(value) < sentinel_below).alias("n")).where(F.col("n") > most).select(*by).distinct()
    return df.select(*by).distinct().join(bad, by, "left_anti")


def subsample(strategy: str, rows: DataFrame, windows: DataFrame, by: list[str], t: str) -> DataFrame:
    """Rows of a window by strategy: ``horizontal`` takes all steps of each series; the other known ones have no agreed meaning."""
    if strategy == "horizontal":
        return rows_in_windows(rows, windows, by, t)
    if strategy in ("jumping_window", "vertical"):
        raise NotImplementedError(f"{strategy} subsampling is not defined")
    raise ValueError(f"unknown strategy {strategy}")


def regime_mask(partition: DataFrame, by: list[str], regime: int) -> DataFrame:
    """One row per time step with whether it belongs to a regime."""
    return labels_of_segments(partition, by).select(*by, "t", (F.col("regime") == regime).alias("inside"))
