"""Whitening of embeddings: streaming moments per partition, merged, then a symmetric QR eigen-solve.

Every task runs Welford's rank-one updates over its vectors and passes on one state
(count, exact sums, mean, centred cross products); states are merged by the
formula for two disjoint samples, first by ``MERGERS`` tasks, then by one, each
holding two states at a time.  Only the last state, the square of the width,
reaches the driver, where it is reduced to a tridiagonal matrix and diagonalised
by implicit QR steps.

Defined cases: null vectors and those with null, NaN or infinite entries, or with
entries beyond 64 bits once scaled, are dropped.  The width is that of the most
vectors (the larger one of two); vectors of other widths are dropped too.  Null
and repeated ids are kept, each row gives rows of its own, and equal vectors give
equal values; extra columns are ignored whatever their names.  Directions without
variance (a single distinct vector, linearly dependent entries) have a null
``whitened``; ``explained`` is null where there is no variance at all,
``identity_error`` where no direction has any.  A deviation over 64 bits is null.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.llm.common import discard, folder, small_batches

#: integer steps per unit of an entry
SCALE = 256
COMPONENTS = 4
#: tasks of the first merge
MERGERS = 64
STATE = "part int, n long, sums array<string>, mean binary, products binary"
_STATE = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("products", pa.binary())])


class Welford:
    """Count, exact integer sums, mean and centred cross products of vectors seen one by one."""

    def __init__(self, width: int):
        self.n = 0
        self.sums = [0] * width
        self.mean = np.zeros(width)
        self.products = np.zeros((width, width))
        self._step = np.empty((width, width))

    def add(self, rows: np.ndarray) -> None:
        """A rank-one update for every row: what it adds is its step from the mean so far."""
        for x in rows.astype(np.float64):
            self.n += 1
            step = x - self.mean
            self.mean += step / self.n
            np.multiply.outer(step, step * ((self.n - 1) / self.n), out=self._step)
            self.products += self._step

    def count_in(self, rows: np.ndarray) -> None:
        """Sums of integer rows, exact at any size."""
        if len(rows):
            wide = int(np.abs(rows.astype(np.float64)).max()) * len(rows) >= 1 << 62
            self.sums = [a + int(b) for a, b in zip(self.sums, rows.astype(object).sum(0) if wide else rows.sum(0), strict=True)]

    def merge(self, n: int, sums: list[int], mean: np.ndarray, products: np.ndarray) -> None:
        """Take in the state of other vectors."""
        if n:
            step, both = mean - self.mean, self.n + n
            self.products += products + np.multiply.outer(step, step) * (self.n * (n / both))
            self.mean += step * (n / both)
            self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]
            self.n = both

    def row(self, part: int) -> pa.RecordBatch:
        columns = [[part], [self.n], [[str(s) for s in self.sums]], [self.mean.tobytes()], [self.products.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STATE, strict=True)], schema=_STATE)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _merged(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = Welford(width), 0
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                state.merge(row["n"], [int(s) for s in row["sums"]], np.frombuffer(row["mean"]), np.frombuffer(row["products"]).reshape(width, width))
        if state.n:
            yield state.row(part)

    return run


def moments(vectors: DataFrame, width: int, project=None, after: int | None = None) -> Welford:
    """State of all rows of the column ``x`` (integer vectors), or of ``project`` of them with ``after`` entries."""
    out = width if after is None else after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Welford(out)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            if project is None:
                state.count_in(x)
            state.add(x if project is None else project(x))
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    states = vectors.select("x").mapInArrow(run, STATE)
    states = states.repartition(MERGERS, F.col("part") % MERGERS).mapInArrow(_merged(out), STATE)
    total = Welford(out)
    for row in states.repartition(1).mapInArrow(_merged(out), STATE).collect():  # one state
        total.merge(row["n"], [int(s) for s in row["sums"]], np.frombuffer(row["mean"]), np.frombuffer(row["products"]).reshape(out, out))
    return total


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and basis of a symmetric matrix after Householder reflections."""
    a, n = np.array(matrix, dtype=np.float64), len(matrix)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]):
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        basis[:, k + 1 :] -= 2 * np.multiply.outer(basis[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), basis


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, and unit eigenvectors as columns, by shifted implicit QR steps."""
    diag, side, basis = tridiagonal(matrix)
    top, eps, steps = len(diag) - 1, np.finfo(np.float64).eps, 0
    while top > 0:
        side[np.abs(side) <= eps * (np.abs(diag[:-1]) + np.abs(diag[1:]))] = 0
        if side[top - 1] == 0:
            top -= 1
            continue
        low = top - 1
        while low > 0 and side[low - 1] != 0:
            low -= 1
        steps += 1
        if steps > 60 * len(diag):
            raise ArithmeticError("no convergence")
        half = (diag[top - 1] - diag[top]) / 2
        shift = diag[top] - side[top - 1] ** 2 / (half + math.copysign(math.hypot(half, side[top - 1]), half))
        x, bulge = diag[low] - shift, side[low]
        for k in range(low, top):
            r = math.hypot(x, bulge)
            c, s = (x / r, bulge / r) if r else (1.0, 0.0)
            if k > low:
                side[k - 1] = r
            a, b, o = diag[k], diag[k + 1], side[k]
            diag[k] = c * c * a + 2 * c * s * o + s * s * b
            diag[k + 1] = s * s * a - 2 * c * s * o + c * c * b
            side[k] = c * s * (b - a) + (c * c - s * s) * o
            left, right = basis[:, k].copy(), basis[:, k + 1]
            basis[:, k] = c * left + s * right
            basis[:, k + 1] = c * right - s * left
            if k < top - 1:
                x, bulge = side[k], s * side[k + 1]
                side[k + 1] *= c
    order = np.argsort(-diag, kind="stable")
    return diag[order], basis[:, order]


@dataclass
class Whitening:
    """A fitted map: ``n`` distinct vectors with their exact ``sums``, eigenvalues and axes (columns) of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    scale: int = SCALE
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    def live(self, components: int) -> int:
        """How many of the first components have variance."""
        least = max(self.values[0], 0) * np.finfo(np.float64).eps * self.width if self.width else 0
        return int((self.values[:components] > least).sum())

    def explained(self, components: int) -> list[float | None]:
        trace = float(self.values.sum())
        return [max(float(e), 0.0) / trace if trace > 0 else None for e in self.values[:components]]

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """The first components with variance; a row's values don't depend on the rows beside it."""
        centred = x.astype(np.float64) - np.array([s / self.n for s in self.sums])
        return np.stack([(centred * self.axes[:, k]).sum(1) / math.sqrt(self.values[k]) for k in range(components)], axis=1) if components else np.zeros((len(x), 0))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the entries of (n x - sum)^2; null where 64 bits don't hold it."""
        if not len(x):
            return []
        far = self.n * int(np.abs(x.astype(np.float64)).max() + 1) + max(map(abs, self.sums))
        if far * far * self.width < 1 << 63:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def integer_vectors(vectors: DataFrame, column: str, scale: int = SCALE) -> DataFrame:
    """All columns needed later plus ``x``, the entries in whole steps, for vectors that have only finite entries."""
    entry = F.col(column)
    fits = F.forall(entry, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < float(1 << 63)))
    return vectors.where(entry.isNotNull() & fits).withColumn("x", F.transform(entry, lambda e: F.floor(e.cast("double") * scale)))


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", scale: int = SCALE) -> Whitening | None:
    """The map fitted on each distinct vector once; None for a table without vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    x = integer_vectors(vectors.select(F.col(column).alias("embedding")), "embedding", scale).select("x")
    widths = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths or not widths[0]["width"]:
        return None
    width = widths[0]["width"]
    kept = folder(spark, "whitening")
    x.where(F.size("x") == width).distinct().write.parquet(kept)
    distinct = spark.read.parquet(kept)
    state = moments(distinct, width)
    values, axes = symmetric_eigen(state.products / state.n)
    model = Whitening(state.n, state.sums, values, axes, scale)
    if live := model.live(components):
        white = moments(distinct, width, lambda rows: model.project(rows, live), live)
        model.identity_error = float(np.abs(white.products / white.n - np.eye(live)).max())
    discard(spark, kept)
    return model


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_ROWS = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), *((c, pa.float64()) for c in ("whitened", "explained", "identity_error"))])


def whiten(vectors: DataFrame, model: Whitening, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector and component, with what the whole fit is worth."""
    components = min(components, model.width)
    live, explained, held = model.live(components), model.explained(components), vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, rows = held.value, len(batch)
            x = _matrix(batch.column(1), model.width)
            white = np.full((rows, components), np.nan)
            white[:, :live] = model.project(x, live)
            flat = white.ravel()
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), components))),
                np.tile(np.arange(1, components + 1, dtype=np.int32), rows),
                np.full(rows * components, model.n),
                [d for d in model.deviations(x) for _ in range(components)],
                pa.array(flat, mask=np.isnan(flat)),
                explained * rows,
                [model.identity_error] * (rows * components),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    return integer_vectors(rows, "embedding", model.scale).where(F.size("x") == model.width).select("vec_id", "x").mapInArrow(run, ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    return spark.createDataFrame([], ROWS) if model is None else whiten(vectors, model)
