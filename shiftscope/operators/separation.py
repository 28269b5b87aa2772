"""Separation and adjustment distances of many pairs of graphs at once.

The graphs of a table are packed, one row each, next to the graphs that they are
compared with; tasks hold batches of them as arrays and follow all walks of all
graphs together, one step at a time.  A graph has to fit into a row; graphs of acyclic
directed edges alone are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: entries of the arrays of graphs that are followed together
ENTRIES = 1 << 22


def packed(nodes: DataFrame, true: DataFrame, guess: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, nodes, true, guess): sorted node numbers, and edges as pairs of numbers; only graphs with nodes."""
    own = nodes.groupBy(graph).agg(F.array_sort(F.collect_set(F.col("node").cast("long"))).alias("nodes"))
    for name, edges in (("true", true), ("guess", guess)):
        listed = edges.groupBy(graph).agg(F.collect_set(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias(name))
        own = own.join(listed, graph, "left")
    return own


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all lists, and how many each list has (none if it is null)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists), sizes.astype(np.int64)


def _matrices(graphs: np.ndarray, places: np.ndarray, count: int, n: int) -> np.ndarray:
    out = np.zeros((count, n, n), dtype=bool)
    out[graphs, places[:, 0], places[:, 1]] = True
    return out


def _to(a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Children of the nodes of a set, per graph."""
    out = np.zeros_like(s)
    for i in range(s.shape[1]):
        out |= a[:, i] & s[:, i, None]
    return out


def closure(a: np.ndarray) -> np.ndarray:
    """Whether a walk of at least no edge leads from one node to another."""
    out = a | np.eye(a.shape[1], dtype=bool)
    for k in range(a.shape[1]):
        out |= out[:, :, k, None] & out[:, k, None, :]
    return out


def connected(a: np.ndarray, x: int, z: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
    """Nodes outside z that some open walk connects with x given z, per graph; ``below``: the closure, if it is known."""
    back = a.transpose(0, 2, 1)
    above = z | _to((closure(a) if below is None else below).transpose(0, 2, 1), z)
    up, down, free = np.zeros_like(z), np.zeros_like(z), ~z
    up[:, x] = True
    while True:
        further = up | _to(back, (up & free) | (down & above))
        lower = down | _to(a, (up | down) & free)
        if np.array_equal(further, up) and np.array_equal(lower, down):
            return (up | down) & free
        up, down = further, lower


def separation(true: np.ndarray, guess: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pairs per graph whose separator in the guess, the parents of the later one, fails in the true graph, and pairs adjacent in the guess alone."""
    n = true.shape[1]
    below, below_true, wrong = closure(guess), closure(true), np.zeros(len(true), dtype=np.int64)
    for x in range(n):
        for y in range(x + 1, n):
            real = sizes > y
            near = guess[:, x, y] | guess[:, y, x]
            apart_true = ~(true[:, x, y] | true[:, y, x])
            z = np.where(below[:, [y], x], guess[:, :, x], guess[:, :, y])
            z[:, [x, y]] = False
            fails = connected(true, x, z, below_true)[:, y]
            wrong += real & np.where(near, apart_true, fails)
    return wrong


def _causal_ways(true: np.ndarray, below: np.ndarray, x: int, y: int) -> np.ndarray:
    """Nodes other than x on directed walks from x to y."""
    out = below[:, x] & below[:, :, y]
    out[:, x] = False
    return out


def adjustment(true: np.ndarray, guess: np.ndarray, sizes: np.ndarray, kind: str) -> np.ndarray:
    """Ordered pairs per graph whose effect the guess's parents (or ancestors) of the cause identify wrongly."""
    n = true.shape[1]
    below, claimed, wrong = closure(true), closure(guess), np.zeros(len(true), dtype=np.int64)
    for x in range(n):
        z = guess[:, :, x].copy() if kind == "parent" else claimed[:, :, x].copy()
        z[:, x] = False
        cut = true.copy()
        cut[:, x] = False
        below_cut = closure(cut)
        reached = connected(cut, x, z, below_cut) if kind == "parent" else None
        for y in range(n):
            if y == x:
                continue
            real = (sizes > x) & (sizes > y)
            between = _causal_ways(true, below, x, y)
            bad = (z & _to(below, between)).any(1)
            silent = z[:, y] if kind == "parent" else ~claimed[:, x, y]
            if kind == "parent":
                open_ = reached[:, y]
            else:
                rest = z.copy()
                rest[:, y] = False
                open_ = connected(cut, x, rest, below_cut)[:, y]
            wrong += real & np.where(silent, below[:, x, y], bad | open_)
    return wrong


def disagreement(true: np.ndarray, guess: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Statements of independence given nothing or one node on which the graphs differ."""
    n = true.shape[1]
    below, claimed, out = closure(true), closure(guess), np.zeros(len(true), dtype=np.int64)
    for given in range(-1, n):
        z = np.zeros((len(true), n), dtype=bool)
        if given >= 0:
            z[:, given] = True
        for x in range(n):
            if x == given:
                continue
            differ = connected(true, x, z, below) != connected(guess, x, z, claimed)
            for y in range(x + 1, n):
                if y != given:
                    out += (sizes > y) & (sizes > given) & differ[:, y]
    return out


MEASURES = ("separation", "parent_adjustment", "ancestor_adjustment", "disagreement")


def distances(nodes: DataFrame, true: DataFrame, guess: DataFrame, measures: tuple[str, ...] = MEASURES, graph: str = "graph") -> DataFrame:
    """(graph, nodes, one count per measure): what the guessed graph gets wrong about the true one.

    ``separation``: of n (n - 1) / 2 pairs; the adjustments: of n (n - 1) ordered pairs;
    ``disagreement``: of all statements about a pair given at most one node.
    """
    kind = dict(true.dtypes).get(graph, "long")
    run_of = {
        "separation": separation,
        "parent_adjustment": lambda a, b, s: adjustment(a, b, s, "parent"),
        "ancestor_adjustment": lambda a, b, s: adjustment(a, b, s, "ancestor"),
        "disagreement": disagreement,
    }

    def counted(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The measures of every pair of graphs; pairs that are alike but for their nodes' numbers are followed once."""
        bits = np.hstack([np.packbits(m.reshape(len(m), -1), axis=1) for m in (a, b)] + [np.ascontiguousarray(sizes).view(np.uint8).reshape(len(sizes), 8)])
        _, first, again = np.unique(np.ascontiguousarray(bits).view(f"V{bits.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return [run_of[m](a[first], b[first], sizes[first])[again.ravel()] for m in measures]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _flat(batch.column("nodes"))[1]
            batch = batch.take(pa.array(np.argsort(sizes, kind="stable")))  # graphs of like sizes together
            sizes = np.sort(sizes)
            begin = 0
            while begin < len(sizes):
                least = int(sizes[begin])
                most = int(np.searchsorted(sizes, least if least <= 8 else least * 5 // 4, "right"))
                end = min(most, begin + max(1, ENTRIES // max(1, least) ** 2))
                part, size, n = batch.slice(begin, end - begin), sizes[begin:end], int(sizes[end - 1])
                entries = _flat(part.column("nodes"))[0].to_numpy(zero_copy_only=False)
                # nodes by graph and rank among all nodes of the part: sorted, so edges find their ends
                values, ranks = np.unique(entries, return_inverse=True)
                keys = np.repeat(np.arange(len(size)), size) * (len(values) + 1) + ranks.ravel()
                begins = np.cumsum(size) - size
                both = []
                for name in ("true", "guess"):
                    edges, count = _flat(part.column(name))
                    owner = np.repeat(np.arange(len(size)), count)
                    ends = _flat(edges)[0].to_numpy(zero_copy_only=False).reshape(-1, 2)
                    places = np.searchsorted(keys, owner[:, None] * (len(values) + 1) + np.searchsorted(values, ends)) - begins[owner, None]
                    both.append(_matrices(owner, places, len(size), n))
                found = counted(*both, size)
                yield pa.RecordBatch.from_arrays([part.column(graph), pa.array(size), *(pa.array(f.astype(np.int64)) for f in found)], names=[graph, "nodes", *measures])
                begin = end

    schema = ", ".join([f"`{graph}` {kind}", "nodes long", *(f"{m} long" for m in measures)])
    return packed(nodes, true, guess, graph).mapInArrow(run, schema)
