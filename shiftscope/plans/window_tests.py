"""Regimes and contexts of time series: tests between windows, partitions, and searches for cuts.

A cell is the rows of one (context, window) with a node's lagged parents.  Bits
of any segmentation are those of sums of cells' cross products, which one pass
gives for a grid of cells; kernel tests see a bounded sample of each cell
(``most``, a parameter).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shiftscope.functions import independence as ci
from shiftscope.functions.changepoints import pelt
from shiftscope.functions.gaussian_process import cross_likelihood_same
from shiftscope.functions.numerics import cluster_weights, components
from shiftscope.functions.scores import Basis, gram_bits, partition_contexts
from shiftscope.operators import regimes, scoring

Links = dict[str, list[tuple[str, int]]]
MOST = 400
TESTS = ("skip", "kci", "mdl")


def fixed_windows(length: int, width: int, skip: int) -> list[tuple[int, int]]:
    """Windows of equal width, the first ``skip`` steps of each left out."""
    return [(b + skip, min(b + width, length)) for b in range(0, length, width) if b + skip < min(b + width, length)]


def windows_of_cuts(cuts: list[int], skip: int) -> list[tuple[int, int]]:
    return [(a + skip, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def lagged_rows(df: DataFrame, series: str, t: str, links: Links) -> tuple[DataFrame, list[str]]:
    """Rows with all lags that the links need, and the columns."""
    lags: dict[str, set[int]] = {}
    for parents in links.values():
        for name, k in parents:
            if k:
                lags.setdefault(name, set()).add(k)
    rows = regimes.lag_features(df.select(series, t, *links), [series], t, {n: sorted(ks) for n, ks in lags.items()}) if lags else df.select(series, t, *links)
    return rows, [*links, *(f"{n}_lag{k}" for n, ks in lags.items() for k in sorted(ks))]


def parents_of(links: Links, node: str) -> list[str]:
    return [f"{n}_lag{k}" if k else n for n, k in links[node]]


def in_windows(rows: DataFrame, t: str, windows: list[tuple[int, int]]) -> DataFrame:
    """Rows with the number of their window (t0 <= t < tn); as many windows as are given are broadcast."""
    table = rows.sparkSession.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(windows)], "window int, t0 long, tn long")
    return rows.join(F.broadcast(table), (F.col(t) >= F.col("t0")) & (F.col(t) < F.col("tn"))).drop("t0", "tn")


PAIR = "node string, a string, b string, p double"


def _pair_tests(rows: DataFrame, group: str, links: Links, columns: list[str], most: int, by: list[str] = ()) -> DataFrame:
    """(by, node, a, b, p): is each node's mechanism given its parents the same in every pair of groups?  A node's rows meet once per pair."""
    by = list(by)
    sample = scoring.sampled(rows.select(*by, F.col(group).cast("string").alias("_g"), *columns), [*by, "_g"], most)
    names = [r["_g"] for r in sample.select("_g").distinct().orderBy("_g").collect()]  # one row per group
    pairs = rows.sparkSession.createDataFrame([(a, b, c) for a, b in combinations(names, 2) for c in (a, b)] or [("", "", "")], "_a string, _b string, _g string")
    nodes = sorted(links)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        side = (part["_g"] == key[-1]).to_numpy().astype(float)
        out = []
        for node in nodes:
            p = 1.0  # without rows on both sides, or with a constant target, the mechanisms count as one
            y = part[[node]].to_numpy(dtype=float)
            if 2 < side.sum() < len(side) - 2 and y.std() > 1e-12:
                x = part[parents_of(links, node)].to_numpy(dtype=float)
                p = ci.kci(side[:, None], y, x if x.shape[1] else None)[1]
            out.append((*key[: len(by)], node, key[-2], key[-1], float(p)))
        return pd.DataFrame(out, columns=[*by, "node", "a", "b", "p"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), PAIR])
    return sample.join(F.broadcast(pairs), "_g").groupBy(*by, "_a", "_b").applyInPandas(run, schema)


def _labels(tests: pd.DataFrame, names: list[str], alpha: float) -> list[int]:
    at = {v: i for i, v in enumerate(names)}
    return components(len(names), [(at[a], at[b]) for a, b, p in zip(tests["a"], tests["b"], tests["p"], strict=True) if p > alpha])


def cell_bits(rows: DataFrame, groups: list[str], links: Links, columns: list[str], kind: str = "lin") -> dict[str, dict[tuple, np.ndarray]]:
    """Per node the cross products of every cell, in one pass over the rows."""
    basis = Basis(kind, *scoring.column_stats(rows, columns))
    at = {c: i for i, c in enumerate(columns)}
    wanted = {node: (at[node], tuple(sorted(at[p] for p in parents_of(links, node)))) for node in links}
    found = scoring.grams(rows, columns, groups, sorted(set(wanted.values())), basis)
    return {node: found[c] for node, c in wanted.items()}


def regime_partition(df: DataFrame, series: str, t: str, links: Links, windows: list[tuple[int, int]], test: str = "mdl", alpha: float = 0.5, most: int = MOST) -> tuple[dict[str, list[int]], DataFrame | None]:
    """Labels of the windows per node, all contexts taken together, and the pairwise p values where the test has them.

    skip: one regime; kci: components of the pairs that a kernel test does not
    tell apart; mdl: clusters of the windows' mean bits a row.
    """
    if test not in TESTS:
        raise ValueError(f"unknown test {test}")
    if test == "skip" or len(windows) == 1:
        return {node: [0] * len(windows) for node in links}, None
    rows, columns = lagged_rows(df, series, t, links)
    rows = in_windows(rows, t, windows)
    if test == "kci":
        tests = _pair_tests(rows, "window", links, columns, most)
        table = tests.toPandas()  # nodes x pairs of windows
        names = [str(k) for k in range(len(windows))]
        return {node: _labels(table[table["node"] == node], names, alpha) for node in links}, tests
    out = {}
    for node, cells in cell_bits(rows, [series, "window"], links, columns).items():
        weight = [np.mean([gram_bits(g) / g[0, 0] for (c, w), g in cells.items() if int(w) == k] or [0.0]) for k in range(len(windows))]
        out[node] = cluster_weights(np.array(weight)).tolist()
    return out, None


def context_partition(df: DataFrame, series: str, t: str, links: Links, windows: list[tuple[int, int]], regime: list[int], test: str = "mdl", alpha: float = 0.5, most: int = MOST) -> dict[str, list[int]]:
    """Labels of the contexts (in order of their names) per node: kci makes two contexts one if no regime tells them apart; mdl clusters their mean bits a row."""
    rows, columns = lagged_rows(df, series, t, links)
    of = F.create_map(*[F.lit(x) for k, r in enumerate(regime) for x in (k, int(r))])
    rows = in_windows(rows, t, windows).withColumn("regime", of[F.col("window")])
    names = [r[0] for r in df.select(F.col(series).cast("string")).distinct().orderBy(series).collect()]  # one row per context
    if test == "skip" or len(names) == 1:
        return {node: [0] * len(names) for node in links}
    if test == "kci":
        tests = _pair_tests(rows, series, links, columns, most, ["regime"])
        same = tests.groupBy("node", "a", "b").agg(F.min("p").alias("p")).toPandas()
        return {node: _labels(same[same["node"] == node], sorted(names), alpha) for node in links}
    out = {}
    for node, cells in cell_bits(rows, [series, "regime"], links, columns).items():
        weight = [np.mean([gram_bits(g) / g[0, 0] for (c, _), g in cells.items() if c == name] or [0.0]) for name in sorted(names)]
        out[node] = cluster_weights(np.array(weight)).tolist()
    return out


def global_regimes(labels: dict[str, list[int]]) -> list[int]:
    """Windows get one regime if their labels agree for every node, numbered by first window."""
    known: dict[tuple, int] = {}
    return [known.setdefault(key, len(known)) for key in zip(*(labels[n] for n in sorted(labels)), strict=True)]


def merged_windows(windows: list[tuple[int, int]], regime: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Neighbours of one regime become one window."""
    out: list[tuple[int, int]] = []
    names: list[int] = []
    for w, r in zip(windows, regime, strict=True):
        if names and names[-1] == r:
            out[-1] = (out[-1][0], w[1])
        else:
            out.append(w)
            names.append(r)
    return out, names


def known_windows(df: DataFrame, series: str, t: str, links: Links, windows: list[tuple[int, int]], skip: int, test: str = "mdl") -> list[tuple[int, int, int]]:
    """(begin, duration, regime) of given windows."""
    regime = global_regimes(regime_partition(df, series, t, links, windows, test)[0])
    begins = [a - skip for a, _ in windows]
    ends = [*begins[1:], windows[-1][1]]
    return [(b, e - b, r) for b, e, r in zip(begins, ends, regime, strict=True)]


def partition_under(df: DataFrame, series: str, t: str, links: Links, windows: list[tuple[int, int]], test: str = "mdl") -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """Regime and context labels per node for given windows."""
    labels, _ = regime_partition(df, series, t, links, windows, test)
    return labels, context_partition(df, series, t, links, windows, global_regimes(labels), test)


def greedy_cuts(df: DataFrame, series: str, t: str, links: Links, grain: int | None = None, alpha: float = 0.05) -> tuple[list[int], float]:
    """Cuts on a grid, added while the best one lowers the total bits, and those bits.

    One pass gives the cross products of every (context, grid cell); each
    segmentation's are sums of them.
    """
    rows, columns = lagged_rows(df, series, t, links)
    length = int(rows.agg(F.max(t)).first()[0]) + 1
    grain = grain or max(1, length // 10)
    edges = [*range(0, length, grain), length]
    cells = cell_bits(in_windows(rows, t, list(zip(edges[:-1], edges[1:], strict=True))), [series, "window"], links, columns)
    contexts = sorted({c for table in cells.values() for c, _ in table})

    def total(cuts: list[int]) -> float:
        bits = 0.0
        for table in cells.values():
            parts = [sum(g for (c, w), g in table.items() if c == name and a <= edges[int(w)] < b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for name in contexts]
            bits += partition_contexts([p for p in parts if not isinstance(p, int)], alpha)[0]
        return bits

    chosen, left = [0, length], edges[1:-1]
    current = total(chosen)
    while left:
        value, cut = min((total(sorted([*chosen, c])), c) for c in left)
        if value >= current:
            break
        current = value
        chosen = sorted([*chosen, cut])
        left.remove(cut)
    return chosen, current


def segmentation_bits(df: DataFrame, series: str, t: str, links: Links, windows: list[tuple[int, int]], test: str = "mdl", alpha: float = 0.05) -> tuple[float, list[tuple[int, int]], list[int], dict[str, list[int]]]:
    """Total bits of a segmentation, its windows and regimes after joining neighbours of one regime, and the contexts' labels per node."""
    labels, _ = regime_partition(df, series, t, links, windows, test)
    windows, regime = merged_windows(windows, global_regimes(labels))
    contexts = context_partition(df, series, t, links, windows, regime, test)
    rows, columns = lagged_rows(df, series, t, links)
    cells = cell_bits(in_windows(rows, t, windows), [series, "window"], links, columns)
    names = sorted({c for table in cells.values() for c, _ in table})
    bits = 0.0
    for node, table in cells.items():
        groups: dict[tuple[int, int], np.ndarray] = {}
        for (c, w), g in table.items():
            key = (contexts[node][names.index(c)], regime[int(w)])
            groups[key] = groups[key] + g if key in groups else g
        bits += sum(map(gram_bits, groups.values()))
    return bits, windows, regime, contexts


def link_strengths(df: DataFrame, series: str, t: str, links: Links, windows: list[tuple[int, int]], kind: str = "lin") -> DataFrame:
    """(series, window, child, parent, with_all, without): bits of a child with all parents and with the others alone, per context and window; ``without`` less ``with_all`` is the link's strength."""
    rows, columns = lagged_rows(df, series, t, links)
    rows = in_windows(rows, t, windows)
    basis = Basis(kind, *scoring.column_stats(rows, columns))
    at = {c: i for i, c in enumerate(columns)}
    wanted = []
    for node in links:
        ps = tuple(sorted(at[p] for p in parents_of(links, node)))
        wanted += [(node, None, (at[node], ps)), *((node, columns[p], (at[node], tuple(q for q in ps if q != p))) for p in ps)]
    found = scoring.grams(rows, columns, [series, "window"], sorted({w[2] for w in wanted}), basis)
    whole = {(n, cell): float(basis.bits(g)) for n, p, c in wanted if p is None for cell, g in found[c].items()}
    out = [(cell[0], int(cell[1]), n, p, whole[n, cell], float(basis.bits(g))) for n, p, c in wanted if p is not None for cell, g in found[c].items()]
    return df.sparkSession.createDataFrame(out, "series string, window int, child string, parent string, with_all double, without double")


# --- one series of losses -----------------------------------------------------


def sequential_cuts(loss: np.ndarray, least: int = 10, block: int = 5, alpha: float = 0.005) -> list[int]:
    """A cut wherever the sum of a block of losses is too high for the stretch before it: its tail under a kernel density of the earlier blocks is under ``alpha``."""
    loss = np.asarray(loss, dtype=float)
    cuts, begin, at = [0], 0, 2 * least
    while at + block <= len(loss):
        past = loss[begin:at]
        sums = np.convolve(past, np.ones(block), mode="valid")
        width = max(1e-9, 1.06 * sums.std() * len(sums) ** -0.2)
        value = loss[at : at + block].sum()
        tail = float(np.mean([0.5 * _erfc((value - s) / width / 2**0.5) for s in sums]))
        if tail < alpha:
            cuts.append(at)
            begin, at = at, at + 2 * least
        else:
            at += 1
    return [*cuts, len(loss)]


def _erfc(x: float) -> float:
    import math

    return math.erfc(x)


def regimes_by_permutation(loss: np.ndarray, cuts: list[int], least: int = 10, penalty: float = 3.0) -> list[int]:
    """Labels of the chunks between cuts: two chunks are one regime if no cut is found where one is put behind the other."""
    chunks = [np.asarray(loss[a:b], dtype=float) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    same = []
    for i, j in combinations(range(len(chunks)), 2):
        border = len(chunks[i])
        ends = pelt(np.concatenate([chunks[i], chunks[j]]), least, penalty)[:-1]
        if not any(abs(e - border) <= least for e in ends):
            same.append((i, j))
    return components(len(chunks), same)


def bayesian_cuts(x: np.ndarray, rate: float = 0.01, floor: float = 0.5, spread: float = 10.0) -> tuple[list[int], np.ndarray]:
    """Changepoints of the mean, and each step's posterior chance of being one.

    Segments are Gaussian with unknown mean and variance under conjugate priors;
    forward and backward recursions over all segmentations give exact chances, in
    the square of the length.  The cuts are the peaks over ``floor``.
    """
    from math import lgamma, log, pi

    x = np.asarray(x, dtype=float)
    n = len(x)
    x = (x - x.mean()) / (x.std() or 1.0)
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    k0, a0, b0 = 1 / spread, 1.0, 0.5
    size = np.arange(n + 1)
    gammas = np.array([lgamma(a0 + m / 2) for m in size])

    def evidence(a: int, b: np.ndarray) -> np.ndarray:
        """Log marginal likelihood of x[a:b] for several ends."""
        m = b - a
        mean = (s1[b] - s1[a]) / m
        ss = np.maximum(0, s2[b] - s2[a] - m * mean**2)
        kn, bn = k0 + m, b0 + ss / 2 + k0 * m * mean**2 / 2 / (k0 + m)
        return gammas[m] - lgamma(a0) + a0 * log(b0) - (a0 + m / 2) * np.log(bn) + 0.5 * (log(k0) - np.log(kn)) - m / 2 * log(2 * pi)

    add = lambda v: float(v.max() + np.log(np.exp(v - v.max()).sum()))
    stay, move = log(1 - rate), log(rate)
    table = np.full((n, n + 1), -np.inf)  # log chance of a segment a..b with its length
    for a in range(n):
        b = np.arange(a + 1, n + 1)
        table[a, b] = evidence(a, b) + (b - a - 1) * stay + np.where(b < n, move, 0.0)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    for b in range(1, n + 1):
        ahead[b] = add(ahead[:b] + table[:b, b])
    for a in range(n - 1, -1, -1):
        behind[a] = add(table[a, a + 1 :] + behind[a + 1 :])
    chance = np.exp(np.minimum(0.0, ahead + behind - ahead[n]))
    inner = [t for t in range(1, n) if chance[t] >= floor and chance[t] == chance[max(1, t - 2) : t + 3].max()]
    near = chance[1:n]
    if not inner and len(near):  # chances of one cut may be spread over neighbouring steps
        window = np.convolve(near, np.ones(5), mode="same")
        inner = [t + 1 for t in range(len(near)) if window[t] >= floor and window[t] == window[max(0, t - 4) : t + 5].max()]
    return [0, *inner, n], chance


def same_mechanism(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, alpha: float = 0.05) -> bool:
    """Two cells' mechanisms by cross likelihoods of kernel processes."""
    return cross_likelihood_same(x1, y1, x2, y2, alpha)
