"""Many sites with yearly series: a common graph, cuts per site, strengths per site and month, and their clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.changepoints import pelt
from shiftscope.functions.numerics import cluster_points
from shiftscope.plans.lagged import LaggedRegimes
from shiftscope.plans.window_tests import Links, fixed_windows, lagged_rows, link_strengths, parents_of


def discover_sites(df: DataFrame, site: str, t: str, nodes: list[str], max_lag: int = 1, min_duration: int = 30) -> LaggedRegimes:
    """One lagged graph with regimes for all sites, each a context."""
    return LaggedRegimes(nodes, series=site, t=t, max_lag=max_lag, min_duration=min_duration).fit(df)


def cuts_per_site(df: DataFrame, site: str, t: str, links: Links, least: int = 30, penalty: float = 3.0) -> DataFrame:
    """(site, cut): changepoints of every site's squared residuals under a known graph; a site's series is one task's work."""
    rows, columns = lagged_rows(df, site, t, links)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(t)
        losses = []
        for node in sorted(links):
            y, x = part[node].to_numpy(dtype=float), part[parents_of(links, node)].to_numpy(dtype=float)
            f = np.hstack([np.ones((len(y), 1)), x])
            r = y - f @ np.linalg.lstsq(f, y, rcond=None)[0]
            losses.append(np.log1p(np.abs(r) / (r.std() + 1e-12)))
        ends = pelt(np.column_stack(losses), least, penalty)
        at = part[t].to_numpy()
        return pd.DataFrame({"site": key[0], "cut": [int(at[e]) for e in ends[:-1]]})

    return rows.withColumn("_site", F.col(site).cast("string")).groupBy("_site").applyInPandas(run, "site string, cut long")


def monthly_strengths(df: DataFrame, site: str, t: str, links: Links, length: int = 365, width: int = 30) -> DataFrame:
    """(site, month, child, parent, strength) of every link in windows of 30 steps, all sites from one pass over the rows."""
    found = link_strengths(df, site, t, links, fixed_windows(length, width, 0))
    return found.select(F.col("series").alias("site"), F.col("window").alias("month"), "child", "parent", (F.col("without") - F.col("with_all")).alias("strength"))


def strength_vectors(strengths: DataFrame) -> DataFrame:
    """One row per site and month with a column per link; rows that lack a link are dropped."""
    link = F.concat("parent", F.lit("->"), "child")
    table = strengths.withColumn("link", link).groupBy("site", "month").pivot("link").agg(F.first("strength"))
    return table.dropna()


def embedded(vectors: DataFrame, k_max: int = 10, seed: int = 0) -> DataFrame:
    """(site, month, x, y, cluster): the two leading principal components and clusters of them; one row per site and month."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    cols = [c for c in vectors.columns if c not in ("site", "month")]
    plain = vectors.select("site", "month", *(F.col(f"`{c}`") for c in cols)).toDF("site", "month", *(f"l{i}" for i in range(len(cols))))
    table = VectorAssembler(inputCols=plain.columns[2:], outputCol="_v").transform(plain)
    table = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(table).transform(table)
    table = PCA(k=min(2, len(cols)), inputCol="_s", outputCol="_p").fit(table).transform(table)
    rows = table.select("site", "month", "_p").toPandas()
    points = np.array([r.toArray() for r in rows["_p"]])
    points = np.hstack([points, np.zeros((len(points), 2 - points.shape[1]))])
    labels = cluster_points(points, k_max, seed)
    out = [(str(s), int(m), float(x), float(y), int(c)) for s, m, (x, y), c in zip(rows["site"], rows["month"], points, labels, strict=True)]
    return vectors.sparkSession.createDataFrame(out, "site string, month int, x double, y double, cluster int")
