"""Exact nearest neighbours and neighbour counts over all rows, and the information measures made of them.

Equal points are counted once, with their number as weight, so a value that many
rows share costs no more than any other.  A k-d tree over a bounded sample (``SAMPLE``
points a group) cuts the space into cells; points meet within their cells first, and
what a point finds there bounds its search: only where its ball crosses the border of
its cell does it visit the cells beyond, once each.  Counts within a ball add the whole
cells inside it and visit those on its border.  Distances are those of the maximum norm.

Rows with a null or non-finite entry are left out.  A group with no more than k rows
has infinite distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.numerics import digamma

SAMPLE = 50_000
#: points in a cell, by the sample's share, and in the finest cells that one task makes of it
CELL, FINE = 5000, 400
PAIRS = 1 << 22


@dataclass
class Tree:
    """A k-d tree: inner nodes cut an axis, leaves are cells numbered from 0."""

    axis: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    cells: int

    @classmethod
    def build(cls, points: np.ndarray, size: int) -> Tree:
        axis, cut, below, above, cells = [], [], [], [], 0
        stack = [(np.arange(len(points)), None, 0)]
        while stack:
            own, parent, side = stack.pop()
            spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(points.shape[1])
            best = int(spread.argmax())
            number = -1 - cells
            if len(own) > size and spread[best] > 0:
                values = points[own, best]
                middle = np.partition(values, len(values) // 2)[len(values) // 2]
                if middle == values.min():  # a value that half the points share: cut above it
                    middle = values[values > middle].min()
                number = len(axis)
                axis.append(best), cut.append(middle), below.append(0), above.append(0)
                stack += [(own[values >= middle], number, 1), (own[values < middle], number, 0)]
            else:
                cells += 1
            if parent is not None:
                (above if side else below)[parent] = number
        return cls(np.array(axis, dtype=np.int64), np.array(cut), np.array(below, dtype=np.int64), np.array(above, dtype=np.int64), cells)

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        if not len(self.axis):
            return np.zeros(len(points), dtype=np.int64)
        node, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        while len(rows):
            at = node[rows]
            node[rows] = np.where(points[rows, self.axis[at]] < self.cut[at], self.below[at], self.above[at])
            rows = rows[node[rows] >= 0]
        return -1 - node

    def touched(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point's number and a cell that its closed ball meets."""
        if not len(self.axis):
            return np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        row, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        rows, cells = [], []
        while len(row):
            value, cut = points[row, self.axis[node]], self.cut[node]
            low, high = value - radius[row] < cut, value + radius[row] >= cut
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([self.below[node[low]], self.above[node[high]]])
            end = node < 0
            rows.append(row[end]), cells.append(-1 - node[end])
            row, node = row[~end], node[~end]
        return np.concatenate(rows), np.concatenate(cells)


def _nearest(queries: np.ndarray, points: np.ndarray, weights: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and weights of the ``count`` nearest points of each query, in order; infinite where there are fewer."""
    dist, mass = np.full((len(queries), count), np.inf), np.zeros((len(queries), count))
    take, step = min(count, len(points)), max(1, PAIRS // max(1, len(points)))
    for i in range(0, len(queries) if take else 0, step):
        gap = np.abs(queries[i : i + step, None] - points[None]).max(-1)
        near = np.argpartition(gap, take - 1, axis=1)[:, :take]
        d = np.take_along_axis(gap, near, 1)
        order = np.argsort(d, axis=1, kind="stable")
        dist[i : i + step, :take] = np.take_along_axis(d, order, 1)
        mass[i : i + step, :take] = weights[np.take_along_axis(near, order, 1)]
    return dist, mass


def _merged(dist: np.ndarray, mass: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dist, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(dist, order, 1), np.take_along_axis(mass, order, 1)


def _kth(dist: np.ndarray, mass: np.ndarray, k: int, own: int) -> np.ndarray:
    """Distance to the k-th neighbour by weight, ``own`` copies of the point itself left out."""
    reached = np.cumsum(mass, axis=1) - own >= k
    return np.where(reached.any(1), np.take_along_axis(dist, reached.argmax(1)[:, None], 1)[:, 0], np.inf)


def search(queries: np.ndarray, points: np.ndarray, weights: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k + 1 nearest points of each query, among cells made of the points; with ``limit``, those within it are right."""
    count = k + 1
    tree = Tree.build(points, FINE)
    home = tree.cell_of(points)
    order = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[order], np.arange(tree.cells + 1))
    inside = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    dist, mass = np.full((len(queries), count), np.inf), np.zeros((len(queries), count))
    own = tree.cell_of(queries)
    by_cell = np.argsort(own, kind="stable")
    marks = np.searchsorted(own[by_cell], np.arange(tree.cells + 1))
    for c in range(tree.cells):
        rows = by_cell[marks[c] : marks[c + 1]]
        dist[rows], mass[rows] = _nearest(queries[rows], points[inside[c]], weights[inside[c]], count)
    radius = _kth(dist, mass, k, 1)
    if limit is not None:
        radius = np.minimum(radius, limit)
    row, cell = tree.touched(queries, radius)
    beyond = cell != own[row]
    row, cell = row[beyond], cell[beyond]
    for c in np.unique(cell).tolist():
        rows = row[cell == c]
        d, m = _nearest(queries[rows], points[inside[c]], weights[inside[c]], count)
        dist[rows], mass[rows] = _merged(np.hstack([dist[rows], d]), np.hstack([mass[rows], m]), count)
    return dist, mass


def points_of(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Distinct points per group (``g``, ``x0`` ...) with their number ``w``."""
    good = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in cols]
    for g in good:
        rows = rows.where(g)
    names = [f"x{i}" for i in range(len(cols))]
    plain = rows.select(F.col(by).cast("string").alias("g"), *((F.col(c).cast("double") + 0.0).alias(n) for c, n in zip(cols, names, strict=True)))
    return plain.groupBy("g", *names).agg(F.count(F.lit(1)).cast("double").alias("w"))


def trees(points: DataFrame, names: list[str]) -> dict[str | None, Tree]:
    """A tree per group over a sample of at most about ``SAMPLE`` points of each."""
    counts = {r["g"]: r["n"] for r in points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per group, as many as results
    if not counts:
        return {}
    table = points.sparkSession.createDataFrame([(g, min(1.0, SAMPLE / n)) for g, n in counts.items()], "_g string, _share double")
    drawn = F.pmod(F.xxhash64(F.lit(11), *names), F.lit(1 << 40)) / float(1 << 40)
    some = points.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("_g"))).where(drawn < F.col("_share")).select("g", *names).toPandas()
    out = {}
    for g, n in counts.items():
        own = some[some["g"].isna() if g is None else some["g"] == g][names].to_numpy()
        out[g] = Tree.build(own, max(8, round(CELL * len(own) / n)))
    return out


def _celled(points: DataFrame, names: list[str], held) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), dtype=np.int64)
            for g in batch["g"].unique():
                own = (batch["g"].isna() if g is None else batch["g"] == g).to_numpy()
                cell[own] = held.value[g].cell_of(batch.loc[own, names].to_numpy())
            yield batch.assign(cell=cell)

    return points.mapInPandas(run, f"{_schema(points)}, cell long")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _visits(queries: DataFrame, names: list[str], held, radius: str, at_home: bool) -> DataFrame:
    """A row for every cell that a query's ball meets, its own one only with ``at_home``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch["g"].unique():
                own = batch[batch["g"].isna() if g is None else batch["g"] == g]
                x = own[names].to_numpy()
                tree = held.value[g]
                row, cell = tree.touched(x, own[radius].to_numpy())
                if not at_home:
                    beyond = cell != tree.cell_of(x)[row]
                    row, cell = row[beyond], cell[beyond]
                for i in range(0, len(row), 20_000):
                    yield own.iloc[row[i : i + 20_000]].assign(cell=cell[i : i + 20_000])

    plain = queries.drop("cell")
    return plain.mapInPandas(run, f"{_schema(plain)}, cell long")


def distances(points: DataFrame, names: list[str], k: int) -> DataFrame:
    """``points`` with ``radius``: the distance of each point's k-th neighbour among all rows of its group, copies included."""
    held = points.sparkSession.sparkContext.broadcast(trees(points, names))  # bounded by the sample
    cells = _celled(points, names, held)
    found = f"{_schema(points)}, cell long, radius double, dist array<double>, mass array<double>"

    def at_home(part: pd.DataFrame) -> pd.DataFrame:
        x, w = part[names].to_numpy(), part["w"].to_numpy()
        dist, mass = search(x, x, w, k)
        return part.assign(radius=_kth(dist, mass, k, 1), dist=_lists(dist, part), mass=_lists(mass, part))

    home = cells.groupBy("g", "cell").applyInPandas(at_home, found)

    def abroad(part: pd.DataFrame) -> pd.DataFrame:
        queries, own = part[part["asks"]], part[~part["asks"]]
        dist, mass = search(queries[names].to_numpy(), own[names].to_numpy(), own["w"].to_numpy(), k, queries["radius"].to_numpy()) if len(queries) and len(own) else (np.zeros((len(queries), 0)), np.zeros((len(queries), 0)))
        return queries[["g", *names, "w"]].assign(dist=_lists(dist, queries), mass=_lists(mass, queries))

    visits = _visits(home.drop("dist", "mass"), names, held, "radius", False)
    lists = ", ".join([_schema(points), "dist array<double>, mass array<double>"])
    both = visits.withColumn("asks", F.lit(True)).unionByName(cells.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    guests = both.groupBy("g", "cell").applyInPandas(abroad, lists)
    keys = ["g", *names, "w"]
    near = home.select(*keys, "dist", "mass").unionByName(guests)
    pairs = F.flatten(F.collect_list(F.arrays_zip("dist", "mass")))  # k + 1 from each cell that the ball meets

    def kth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            radius = [float(_kth(*(v[None] for v in _sorted(p)), k, 1)[0]) for p in batch["pairs"]]
            yield batch[keys].assign(radius=radius)

    return near.groupBy(*keys).agg(pairs.alias("pairs")).mapInPandas(kth, f"{_schema(points)}, radius double")


def _lists(values: np.ndarray, frame: pd.DataFrame) -> pd.Series:
    return pd.Series(list(values), index=frame.index, dtype=object)


def _sorted(pairs) -> tuple[np.ndarray, np.ndarray]:
    dist, mass = np.array([p["dist"] for p in pairs]), np.array([p["mass"] for p in pairs])
    order = np.argsort(dist, kind="stable")
    return dist[order], mass[order]


def counts_within(queries: DataFrame, points: DataFrame, names: list[str], result: str) -> DataFrame:
    """``queries`` with the weight of the points nearer than ``radius`` (at distance 0, where the radius is 0) in the columns ``names``.

    Both have ``g`` and the columns, which are the points' own distinct ones.
    """
    held = points.sparkSession.sparkContext.broadcast(trees(points, names))  # bounded by the sample
    cells = _celled(points, names, held)
    edges = [e for n in names for e in (F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"))]
    # a row per cell: as many as the trees have leaves
    boxes = cells.groupBy("g", "cell").agg(F.sum("w").alias("total"), *edges)
    row = _visits(queries, names, held, "radius", True).withColumnRenamed("cell", "_cell").withColumnRenamed("g", "_g")
    row = row.join(F.broadcast(boxes), (F.col("_cell") == F.col("cell")) & F.col("_g").eqNullSafe(F.col("g"))).drop("_cell", "_g")
    far = F.greatest(*(F.abs(F.col(n) - F.col(f"{e}_{n}")) for n in names for e in ("low", "high")), F.lit(0.0))
    whole = (far < F.col("radius")) | (far == 0.0)
    keys = queries.columns
    inner = row.where(whole).groupBy(*keys).agg(F.sum("total").alias("_n"))
    border = row.where(~whole).select(*keys, "cell")

    def count(part: pd.DataFrame) -> pd.DataFrame:
        asked, own = part[part["asks"]], part[~part["asks"]]
        q, r = asked[names].to_numpy(), asked["radius"].to_numpy()
        x, w = own[names].to_numpy(), own["w"].to_numpy()
        n, step = np.zeros(len(q)), max(1, PAIRS // max(1, len(x)))
        for i in range(0, len(q) if len(x) else 0, step):
            gap = np.abs(q[i : i + step, None] - x[None]).max(-1)
            n[i : i + step] = ((gap < r[i : i + step, None]) | (gap == 0)) @ w
        return asked[keys].assign(_n=n)

    both = border.withColumn("asks", F.lit(True)).unionByName(cells.select("g", *names, "w", "cell").withColumn("asks", F.lit(False)), allowMissingColumns=True)
    met = both.groupBy("g", "cell").applyInPandas(count, f"{_schema(queries)}, _n double")
    return inner.unionByName(met).groupBy(*keys).agg(F.sum("_n").alias(result))


def information(rows: DataFrame, by: str, x: list[str], y: list[str], z: list[str] = (), k: int = 5) -> DataFrame:
    """(``by``, n, nats): nearest-neighbour mutual information of x and y (given z) per group, over all its rows.

    Columns are standardised per group.  Where a row has k copies or more its distance
    is 0, and its copies count in place of k; else this is the usual estimate.
    """
    cols = [*x, *y, *z]
    stats = rows.groupBy(F.col(by).cast("string").alias("_g")).agg(*(e for i, c in enumerate(cols) for e in (F.avg(c).alias(f"_a{i}"), F.stddev_pop(c).alias(f"_d{i}"))))
    # a row per group, as many as results
    level = rows.select(F.col(by).cast("string").alias(by), *cols).join(F.broadcast(stats), F.col(by).cast("string").eqNullSafe(F.col("_g")))
    level = level.select(by, *(((F.col(c) - F.col(f"_a{i}")) / F.when(F.col(f"_d{i}") < 1e-12, 1.0).otherwise(F.col(f"_d{i}"))).alias(c) for i, c in enumerate(cols)))
    points = points_of(level, by, cols).persist()
    names = [f"x{i}" for i in range(len(cols))]
    found = distances(points, names, k).persist()
    at_z = names[len(x) + len(y) :]
    parts = {"nx": [*names[: len(x)], *at_z], "ny": names[len(x) : len(x) + len(y)] + at_z} | ({"nz": at_z} if z else {})
    counted = found
    for name, own in parts.items():
        sub = points.groupBy("g", *own).agg(F.sum("w").alias("w"))
        asked = found.select("g", *own, "radius").distinct()
        n = counts_within(asked, sub, own, name)
        counted = counted.join(n.withColumnRenamed("g", "_g"), [*own, "radius"]).where(F.col("g").eqNullSafe(F.col("_g"))).drop("_g")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.where(batch["radius"] == 0, batch["w"], float(k))
            value = digamma(near) - digamma(batch["nx"].to_numpy()) - digamma(batch["ny"].to_numpy()) + (digamma(batch["nz"].to_numpy()) if z else 0.0)
            yield pd.DataFrame({"g": batch["g"], "w": batch["w"], "v": value * batch["w"]})

    total = counted.mapInPandas(terms, "g string, w double, v double").groupBy("g").agg(F.sum("w").alias("n"), F.sum("v").alias("v"))
    out = [(r["g"], int(r["n"]), float(r["v"] / r["n"] + (0.0 if z else digamma(np.array([r["n"]]))[0])) if r["n"] > k else 0.0) for r in total.collect()]
    found.unpersist(), points.unpersist()
    return rows.sparkSession.createDataFrame(out, f"`{by}` string, n long, nats double")


def entropy(rows: DataFrame, by: str, cols: list[str], k: int = 3) -> DataFrame:
    """(``by``, n, nats): nearest-neighbour entropy of the columns per group, over all its rows; distances of 0 count as 1e-12."""
    names = [f"x{i}" for i in range(len(cols))]
    found = distances(points_of(rows, by, cols), names, k).where(F.col("radius") < float("inf"))
    total = found.groupBy("g").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.log(F.greatest("radius", F.lit(1e-12)))) / F.sum("w")).alias("v"))
    psi = lambda n: float(digamma(np.array([float(n)]))[0])
    out = [(r["g"], int(r["n"]), psi(r["n"]) - psi(k) + len(cols) * (float(np.log(2)) + r["v"])) for r in total.collect()]  # a row per group
    return rows.sparkSession.createDataFrame(out, f"`{by}` string, n long, nats double")
