"""Latent confounding from shared mechanism changes.

Each node's contexts are partitioned by pairwise mechanism tests given its
parents; two nodes whose partitions agree more than chance share a confounder;
the pairs' affinities are cut into groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions import independence as ci
from shiftscope.functions.mixture import spectral
from shiftscope.functions.numerics import components, information_scores, normal_sf
from shiftscope.functions.scores import Basis
from shiftscope.operators import scoring

PAIRS = "node string, c1 string, c2 string, stat double, p double"
Z_LIMIT = 1.96


def mechanism_tests(df: DataFrame, context: str, parents: dict[str, list[str]], test: str = "linear", most: int = 400, seed: int = 0) -> DataFrame:
    """(node, c1, c2, stat, p) for every node and pair of contexts: is its mechanism given its parents the same?

    ``linear`` compares linear Gaussian mechanisms (without parents, means and
    variances) and sees all rows, through cross products per context.  The other
    tests cost the square of their rows: each context gives about ``most`` of
    them, which the pair join copies once per partner, and nodes without parents
    are compared by maximum mean discrepancy.
    """
    if test == "linear":
        return _linear_tests(df, context, parents)
    nodes = sorted(parents)
    cols = sorted({*nodes, *(p for ps in parents.values() for p in ps)})
    rows = scoring.sampled(df.select(F.col(context).cast("string").alias("_ctx"), *cols), ["_ctx"], most, seed)
    names = [r["_ctx"] for r in rows.select("_ctx").distinct().orderBy("_ctx").collect()]  # one row per context
    table = rows.sparkSession.createDataFrame([(a, b, c) for a, b in combinations(names, 2) for c in (a, b)], "_c1 string, _c2 string, _ctx string")
    paired = rows.join(F.broadcast(table), "_ctx")  # contexts squared

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        group = (part["_ctx"] == key[1]).to_numpy().astype(float)
        out = []
        for node in nodes:
            y = part[node].to_numpy(dtype=float)
            if parents[node]:
                stat, p = ci.PAIR_TESTS[test](part[parents[node]].to_numpy(dtype=float), y, group) if test in ci.PAIR_TESTS else ci.kci(y, group, part[parents[node]].to_numpy(dtype=float))
            else:
                stat, p = ci.mmd(y[group < 0.5], y[group > 0.5], seed=seed)
            out.append((node, key[0], key[1], float(stat), float(p)))
        return pd.DataFrame(out, columns=["node", "c1", "c2", "stat", "p"])

    return paired.groupBy("_c1", "_c2").applyInPandas(run, PAIRS)


def _linear_tests(df: DataFrame, context: str, parents: dict[str, list[str]]) -> DataFrame:
    cols = sorted({*parents, *(p for ps in parents.values() for p in ps)})
    at = {c: i for i, c in enumerate(cols)}
    wanted = {node: (at[node], tuple(sorted(at[p] for p in ps))) for node, ps in parents.items()}
    tables = scoring.grams(df, cols, [context], sorted(set(wanted.values())), Basis("lin", *scoring.column_stats(df, cols)))
    out = []
    for node, candidate in sorted(wanted.items()):
        cells = {k[0]: g for k, g in tables[candidate].items()}
        for a, b in combinations(sorted(cells), 2):
            stat, p = ci.linear_params_grams(cells[a], cells[b])
            out.append((node, a, b, float(stat), float(p)))
    return df.sparkSession.createDataFrame(out, PAIRS)


def partitions(tests: DataFrame, alpha: float = 0.05) -> dict[str, list[int]]:
    """Labels of the contexts (in order of their names) per node: components of the pairs that do not differ."""
    rows = tests.toPandas()
    names = sorted({*rows["c1"], *rows["c2"]})
    at = {c: i for i, c in enumerate(names)}
    return {node: components(len(names), [(at[a], at[b]) for a, b, p in zip(part["c1"], part["c2"], part["p"], strict=True) if p > alpha]) for node, part in rows.groupby("node")}


def ordered_partition(p: np.ndarray, alpha: float = 0.05) -> list[int]:
    """The variant by overwriting: contexts with fewest differences first; each takes its partners into its group."""
    n = len(p)
    labels = np.zeros(n, dtype=int)
    for name, i in enumerate(np.argsort((p <= alpha).sum(1), kind="stable")):
        labels[i] = name
        for j in range(n):
            if j != i and p[i, j] > alpha:
                labels[j] = name
    return np.unique(labels, return_inverse=True)[1].tolist()


def random_partition(contexts: int, shifts: int, rng: np.random.Generator) -> np.ndarray:
    """Context 0's group, and ``shifts`` contexts with labels of their own."""
    out = np.zeros(contexts, dtype=int)
    out[rng.choice(np.arange(1, contexts), min(shifts, contexts - 1), replace=False)] = np.arange(1, min(shifts, contexts - 1) + 1)
    return out


def null_scores(contexts: int, shifts_i: int, shifts_j: int, reps: int = 100, seed: int = 0) -> dict[str, float]:
    """Moments of the MI of two independent random partitions with these numbers of shifts."""
    rng = np.random.default_rng((seed, contexts, shifts_i, shifts_j))
    rows = [information_scores(random_partition(contexts, shifts_i, rng), random_partition(contexts, shifts_j, rng)) for _ in range(reps)]
    mi, h, ami = (np.array([r[k] for r in rows]) for k in ("mi", "h1", "ami"))
    vi = np.array([r["h1"] + r["h2"] for r in rows])  # conditional entropies: their sum is the variation of information
    return {
        "emi": float(np.mean([r["emi"] for r in rows])), "mi_mean": float(mi.mean()), "mi_sd": float(mi.std()), "mi_high": float(np.quantile(mi, 0.95)), "h_sd": float(h.std()),
        "ami_mean": float(ami.mean()), "ami_sd": float(ami.std()), "vi_low": float(np.quantile(vi, 0.05)), "vi_sd": float(vi.std()),
    }


def null_scores_any(contexts: int, reps: int = 1000, seed: int = 0, alpha: float = 0.05) -> dict[str, float]:
    """Moments over partitions of all numbers of shifts, equally often."""
    each = max(1, reps // max(1, contexts - 1))
    rng = np.random.default_rng((seed, contexts))
    rows = [information_scores(random_partition(contexts, k, rng), random_partition(contexts, k, rng)) for k in range(1, contexts) for _ in range(each)]
    mi, emi = np.array([r["mi"] for r in rows]), np.array([r["emi"] for r in rows])
    return {"mi_high": float(np.quantile(mi, 1 - alpha)), "emi_high": float(np.quantile(emi, 1 - alpha)), "mi_mean": float(mi.mean()), "emi_mean": float(emi.mean()), "h_mean": float(np.mean([r["h1"] + r["mi"] for r in rows]))}


def dependence_test(a: list[int], b: list[int], kind: str = "z_mi", reps: int = 100, seed: int = 0, limit: float = Z_LIMIT) -> tuple[bool, float, float]:
    """Do two nodes' context partitions share their changes?  The decision, the MI and a p value.

    ami: AMI over 0; mi: MI over its expectation; vi: identical partitions;
    exact_mi: MI over the high quantile of random partitions with as many shifts;
    z_mi, z_ami, z_vi: standard scores against such partitions, beyond ``limit``
    in the direction of agreement.
    """
    x, y = np.array(a), np.array(b)
    s = information_scores(x, y)
    one = len(set(a)) == 1 or len(set(b)) == 1
    mi = s["mi"]
    vi = 0.0 if len(set(a)) == len(set(b)) == 1 else s["h1"] + s["h2"]
    if kind in ("ami", "mi", "vi"):
        yes = {"ami": s["ami"] > 1e-9, "mi": mi > s["emi"] + 1e-9, "vi": abs(vi) < 1e-9}[kind]
        return bool(yes), mi, 0.0 if yes else 1.0
    null = null_scores(len(x), len(set(a)) - 1, len(set(b)) - 1, reps, seed)
    if kind == "exact_mi":
        yes = mi > null["mi_high"] + 1e-9
        return bool(yes), mi, 0.0 if yes else 1.0
    gap, sd = {"z_mi": (mi - s["emi"], null["mi_sd"]), "z_ami": (s["ami"] - null["ami_mean"], null["ami_sd"]), "z_vi": (null["vi_low"] - vi, null["vi_sd"])}[kind]
    z = 0.0 if one else gap / sd if sd > 0 else gap
    return bool(z > limit), mi, normal_sf(z)


def pair_scores(labels: dict[str, list[int]], seed: int = 0) -> list[dict]:
    """For each pair of nodes its MI, what chance expects, and the two decisions."""
    cache: dict[tuple[int, int, int], dict[str, float]] = {}
    out = []
    for a, b in combinations(sorted(labels), 2):
        x, y = np.array(labels[a]), np.array(labels[b])
        key = (len(x), len(set(x)) - 1, len(set(y)) - 1)
        null = cache.setdefault(key, null_scores(*key, seed=seed))
        s = information_scores(x, y)
        z = (s["mi"] - s["emi"]) / (null["mi_sd"] or 1e-12) if key[1] and key[2] else 0.0
        causal = (s["h1"] - s["mi"]) / (null["h_sd"] or 1e-12)
        out.append({"a": a, "b": b, **s, "z": z, "p": normal_sf(abs(z)), "confounded": bool(z > Z_LIMIT), "causal_z": causal, "causal": bool(abs(causal) < Z_LIMIT)})
    return out


def cuts(nodes: list[str], pairs: list[dict], seed: int = 42) -> list[list[str]]:
    """Groups of confounded nodes: spectral cuts with k = 1..n/2, scored by the squared MI inside groups of two or more."""
    at = {v: i for i, v in enumerate(nodes)}
    some = sorted({at[v] for p in pairs if p["confounded"] for v in (p["a"], p["b"])})
    if len(some) < 2:
        return []
    affinity, mi = np.full((len(some), len(some)), 0.01), np.zeros((len(some), len(some)))
    place = {v: i for i, v in enumerate(some)}
    for p in pairs:
        if p["confounded"]:
            i, j = place[at[p["a"]]], place[at[p["b"]]]
            affinity[i, j] = affinity[j, i] = 1.01
            mi[i, j] = mi[j, i] = p["mi"]
    best: tuple[float, list[list[int]]] = (-np.inf, [])
    for k in range(1, max(1, len(some) // 2) + 1):
        labels = spectral(affinity, k, seed) if k > 1 else np.zeros(len(some), dtype=int)
        groups = [np.flatnonzero(labels == c) for c in range(k)]
        groups = [g for g in groups if len(g) > 1]
        inside = sum(float((mi[np.ix_(g, g)] ** 2).sum()) / (len(g) * (len(g) - 1)) for g in groups)
        if groups and inside / len(groups) > best[0] + 1e-12:
            best = (inside / len(groups), [g.tolist() for g in groups])
    return [[nodes[some[i]] for i in g] for g in best[1]]


def confounders(df: DataFrame, context: str, parents: dict[str, list[str]], test: str = "linear", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(a, b, mi, emi, z, p, confounded, causal, group): all pairs of nodes, and the group both are cut into."""
    labels = partitions(mechanism_tests(df, context, parents, test, seed=seed), alpha)
    pairs = pair_scores(labels, seed)
    group = {v: k for k, g in enumerate(cuts(sorted(labels), pairs)) for v in g}
    rows = [(p["a"], p["b"], p["mi"], p["emi"], float(p["z"]), p["p"], p["confounded"], p["causal"], group[p["a"]] if group.get(p["a"], -1) == group.get(p["b"], -2) else None) for p in pairs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, mi double, emi double, z double, p double, confounded boolean, causal boolean, group int")
