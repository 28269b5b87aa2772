"""Distributed scores: cross products of basis functions per candidate and group, summed over partitions.

One pass over the rows serves any number of candidates (node, parents) and any
grouping (contexts, regimes, windows).  With an additive basis one matrix of all
columns per group holds every candidate's, so a whole search takes one pass
(``WholeGram``).  What reaches the driver is small, whatever the number of rows;
scores of unions of groups come from sums of matrices without another pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.scores import Basis, gram

Candidate = tuple[int, tuple[int, ...]]


def column_stats(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations, in one aggregate."""
    row = df.agg(*(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
    values = np.array([0.0 if v is None else float(v) for v in row])
    return values[: len(cols)], values[len(cols) :]


def correlation(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """Correlation matrix and row count, from one pass of cross products."""
    centre, scale = column_stats(df, cols)
    basis = Basis("lin", centre, scale)
    last = len(cols) - 1
    table = grams(df, cols, [], [(last, tuple(range(len(cols))))], basis).get((last, tuple(range(len(cols)))), {})
    if not table:
        return np.eye(len(cols)), 0
    g = table[()]
    n, block = g[0, 0], g[1:-1, 1:-1] / g[0, 0]
    d = np.sqrt(np.maximum(1e-300, np.diag(block)))
    return block / np.outer(d, d), int(n)


def summed(df: DataFrame, cols: list[str], by: list[str], matrices: Callable[..., list[np.ndarray]], keyed: bool = False) -> dict[tuple, np.ndarray]:
    """Sums over all rows of what ``matrices`` makes of a block of rows (with ``keyed``: of its group and the block), by matrix number and group.

    One pass, partial sums before the shuffle.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.dropna(subset=cols).select(*(F.col(b).cast("string").alias(k) for b, k in zip(by, keys, strict=True)), *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]
            for key, part in groups:
                x = part.iloc[:, len(keys) :].to_numpy()
                for c, g in enumerate(matrices(key, x) if keyed else matrices(x)):
                    held[c, *key] = held[c, *key] + g if (c, *key) in held else g
        if held:
            yield pd.DataFrame([(k[0], *k[1:], g.tobytes()) for k, g in held.items()], columns=["c", *keys, "g"])

    schema = ", ".join(["c int", *(f"{k} string" for k in keys), "g binary"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("g").to_pylist())
        return table.slice(0, 1).drop(["g"]).append_column("g", pa.array([total.tobytes()], pa.binary()))

    out = {}
    for row in rows.mapInPandas(run, schema).groupBy("c", *keys).applyInArrow(add, schema).collect():  # small matrices, as many as candidates and groups
        flat = np.frombuffer(bytes(row["g"]))
        size = int(round(len(flat) ** 0.5))
        out[row["c"], *(row[k] for k in keys)] = flat.reshape(size, size)
    return out


class WholeGram:
    """One matrix per group of the functions of all columns and of all targets, from which every candidate's is cut (additive bases)."""

    def __init__(self, df: DataFrame, cols: list[str], by: list[str], basis: Basis):
        columns = range(len(cols))

        def matrices(x: np.ndarray) -> list[np.ndarray]:
            block = np.hstack([np.ones((len(x), 1)), *(basis.of_column(x, i) for i in columns), x])
            return [block.T @ block]

        self.tables = {k[1:]: g for k, g in summed(df, cols, by, matrices).items()}
        self.columns, self.width = len(cols), basis.of_column(np.zeros((1, len(cols))), 0).shape[1]

    def of(self, candidate: Candidate) -> dict[tuple, np.ndarray]:
        node, parents = candidate
        at = [0, *(1 + p * self.width + f for p in parents for f in range(self.width)), 1 + self.columns * self.width + node]
        return {k: g[np.ix_(at, at)] for k, g in self.tables.items()}


def grams(df: DataFrame, cols: list[str], by: list[str], candidates: list[Candidate], basis: Basis) -> dict[Candidate, dict[tuple, np.ndarray]]:
    """Gram matrix per candidate and group, in one pass.  Rows with a null among ``cols`` are left out."""
    if not candidates:
        return {}
    if basis.additive:
        whole = WholeGram(df, cols, by, basis)
        return {c: whole.of(c) for c in candidates}
    out: dict[Candidate, dict[tuple, np.ndarray]] = {c: {} for c in candidates}
    for k, g in summed(df, cols, by, lambda x: [gram(basis(x, parents), x[:, node]) for node, parents in candidates]).items():
        out[candidates[k[0]]][k[1:]] = g
    return out


def sampled(df: DataFrame, by: list[str], most: int, seed: int = 0) -> DataFrame:
    """About ``most`` rows per group; smaller groups stay whole.

    Equal rows are counted first, and a row value of count c stays c * share times, rounded
    up or down by a hash of the value: repeated values keep their share, whatever the partitions.
    """
    cols = df.columns
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    sizes = df.groupBy(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by))).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    counts = counts.join(F.broadcast(sizes), same) if by else counts.crossJoin(F.broadcast(sizes))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n"))
    draw = F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)
    kept = F.floor(F.col("_c") * share + draw).cast("int")
    return counts.where(kept > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), kept))).select(*cols)
