"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a and b, longs); the component is one of its nodes.

    Each round points every node to the least of itself and its neighbours and
    contracts the edges along these pointers, which at least halves the nodes
    that still have an edge to a lower one; the rounds' pointers are then
    followed one after another.  Every table stays distributed; a hub's edges
    are reduced by partial minima before they are shuffled.  The rounds' tables
    are written and read again, so that each round plans with their true sizes:
    estimates carried through checkpoints would multiply from join to join.
    """
    left = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    rounds: list[DataFrame] = []
    while left.count():
        both = left.union(left.select("b", "a"))
        pointer = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "pointers")
        # pointers among neighbours may form chains; two jumps shorten them
        hop = pointer.select(F.col("a").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            pointer = pointer.join(hop, "to").select("a", F.col("next").alias("to"))
        pointer = stored(pointer, "pointers")
        rounds.append(pointer)
        ends = left.join(pointer.withColumnRenamed("to", "x"), "a")
        ends = ends.join(pointer.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    found = nodes.select("node", F.col("node").alias("component"))
    for pointer in rounds:
        step = pointer.select(F.col("a").alias("component"), "to")
        found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stored(found, "components")
