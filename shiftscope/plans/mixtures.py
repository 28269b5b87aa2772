"""Hidden populations per node given its parents, and sets of nodes that share one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions.mixture import gaussian_mixture, kmeans_or_one, regression_mixture
from shiftscope.functions.numerics import components, expected_mutual_information, contingency, mutual_information
from shiftscope.operators import em

LABELS = "block long, row_id long, node string, label int, posterior array<double>"
MI_LIMIT = 0.03


def _of_all_rows(df: DataFrame, row: str, parents: dict[str, list[str]], kind: str, k_max: int, seed: int) -> DataFrame:
    out = None
    for node in sorted(parents):
        rows = df.select(F.lit(0).cast("long").alias("block"), F.col(row).cast("long").alias("row_id"), F.lit(node).alias("node"), *{*parents[node], node})
        models = em.fit(rows, node, parents[node], kind, k_max, seed)
        if models:
            part = em.labelled(rows, ["block", "row_id", "node"], node, parents[node], models[0]).where("label is not null")
            out = part if out is None else out.unionByName(part)
    return df.sparkSession.createDataFrame([], LABELS) if out is None else out


def node_mixtures(df: DataFrame, row: str, parents: dict[str, list[str]], block: str | None = None, kind: str = "lin", k_max: int = 5, seed: int = 42) -> DataFrame:
    """(block, row_id, node, label, posterior) for every node; ``kind``: lin, quad, cub, gmm or kmeans.

    Without ``block`` every mixture is fitted to all rows of the table (``operators.em``).
    ``block`` names a column of separate populations, each with mixtures of its own: labels
    are comparable within a block only, and a block is one task's work.
    """
    if block is None and kind != "kmeans":
        return _of_all_rows(df, row, parents, kind, k_max, seed)
    nodes = sorted(parents)
    cols = sorted({*nodes, *(p for ps in parents.values() for p in ps)})
    rows = df.select((F.col(block) if block else F.lit(0)).cast("long").alias("block"), F.col(row).cast("long").alias("row_id"), *(F.col(c).cast("double").alias(c) for c in cols))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_id")
        out = []
        for node in nodes:
            y, x = part[node].to_numpy(), part[parents[node]].to_numpy()
            if kind == "kmeans":
                labels = kmeans_or_one(np.column_stack([x, y]), k_max, seed=seed)
                posterior = np.eye(labels.max() + 1)[labels]
            elif kind == "gmm" or not parents[node]:
                labels, posterior, _ = gaussian_mixture(np.column_stack([x, y]), k_max, seed)
            else:
                labels, posterior, _ = regression_mixture(x, y, k_max, {"lin": 1, "quad": 2, "cub": 3}[kind], seed)
            out.append(pd.DataFrame({"block": part["block"].to_numpy(), "row_id": part["row_id"].to_numpy(), "node": node, "label": labels.astype("int32"), "posterior": list(posterior)}))
        return pd.concat(out)

    return rows.groupBy("block").applyInPandas(run, LABELS)


def shared_sets(labels: DataFrame, limit: float = MI_LIMIT) -> tuple[list[dict], list[list[str]]]:
    """MI of each pair of nodes' labels against its expectation, and the components of the dependent pairs.

    The pair counts are one grouped aggregate over a join on the row.
    """
    a = labels.select("block", "row_id", F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select("block", "row_id", F.col("node").alias("b"), F.col("label").alias("lb"))
    counts = a.join(b, ["block", "row_id"]).where("a < b").groupBy("a", "b", "la", "lb").agg(F.count(F.lit(1)).alias("n")).toPandas()
    pairs = []
    for (x, y), part in counts.groupby(["a", "b"]):
        table = np.zeros((part["la"].max() + 1, part["lb"].max() + 1))
        table[part["la"], part["lb"]] = part["n"]
        table = table[table.sum(1) > 0][:, table.sum(0) > 0]
        mi = 0.0 if min(table.shape) == 1 else mutual_information(table)
        emi = 0.0 if min(table.shape) == 1 else expected_mutual_information(table)
        pairs.append({"a": x, "b": y, "mi": mi, "emi": emi, "dependent": mi > emi and mi > limit})
    nodes = sorted({p[k] for p in pairs for k in "ab"})
    at = {v: i for i, v in enumerate(nodes)}
    group = components(len(nodes), [(at[p["a"]], at[p["b"]]) for p in pairs if p["dependent"]])
    sets = [[v for v in nodes if group[at[v]] == g] for g in sorted(set(group))]
    return pairs, [s for s in sets if len(s) > 1]


def label_overlap(true: np.ndarray, found: np.ndarray) -> float:
    """Mutual information of two labelings as a share of the true one's entropy."""
    t = contingency(true, found)
    h = mutual_information(contingency(true, true))
    return mutual_information(t) / h if h else 1.0


def best_jaccard(true: DataFrame, found: DataFrame) -> DataFrame:
    """For each true set (name, node) the best Jaccard overlap with a found set."""
    t, f = true.select(F.col("name").alias("t"), "node"), found.select(F.col("name").alias("f"), "node")
    nt, nf = t.groupBy("t").agg(F.count(F.lit(1)).alias("nt")), f.groupBy("f").agg(F.count(F.lit(1)).alias("nf"))
    common = t.join(f, "node").groupBy("t", "f").agg(F.count(F.lit(1)).alias("n")).join(nt, "t").join(nf, "f")
    best = common.groupBy("t").agg(F.max(F.col("n") / (F.col("nt") + F.col("nf") - F.col("n"))).alias("jaccard"))
    return nt.select("t").join(best, "t", "left").fillna(0.0, ["jaccard"])


def shared_sets_by_threshold(labels: DataFrame, thresholds: list[float], measure: str = "mi") -> DataFrame:
    """(threshold, set_id, node): the components of dependent pairs at each threshold of ``mi`` or ``ami``; the pair counts are made once."""
    pairs, _ = shared_sets(labels, 0.0)
    nodes = sorted({p[k] for p in pairs for k in "ab"})
    at = {v: i for i, v in enumerate(nodes)}
    value = {"mi": lambda p: p["mi"], "ami": lambda p: p["mi"] - p["emi"]}[measure]
    rows = []
    for t in thresholds:
        group = components(len(nodes), [(at[p["a"]], at[p["b"]]) for p in pairs if p["mi"] > p["emi"] and value(p) > t])
        for g in sorted(set(group)):
            members = [v for v in nodes if group[at[v]] == g]
            rows += [(float(t), g, v) for v in members if len(members) > 1]
    return labels.sparkSession.createDataFrame(rows, "threshold double, set_id int, node string")
