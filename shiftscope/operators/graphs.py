"""Graphs as edge tables (graph, src, dst[, kind]): closure, patterns, distances, confusion.

All functions keep a ``graph`` column, so thousands of graphs are handled by the
same joins; fixpoints iterate over the frontier only, whose plan is cut each
round by a reliable checkpoint.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, which all executors share; a session of one machine without any gets one in its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master or ""):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Joins deal both tables out again by all their keys.  The following group or sort a union instead,
# so tables that are dealt by the graph stay where they are, and their parts stay small.


def marked(keys: list[str], **tables: DataFrame) -> DataFrame:
    """The keys of any of the tables, once each, with a boolean column per table that tells whether it has them."""
    parts = [t.select(*keys, *(F.lit(n == name).alias(n) for n in tables)) for name, t in tables.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.groupBy(*keys).agg(*(F.bool_or(n).alias(n) for n in tables))


def flagged(rows: DataFrame, keys: list[str], **tables: DataFrame) -> DataFrame:
    """The rows, repeated ones too, with a boolean column per table that tells whether it has the row's keys; null keys are in none."""
    rest = [c for c in rows.columns if c not in keys]
    whole = rows.select(*keys, *rest, F.lit(True).alias("_own"), *(F.lit(False).alias(n) for n in tables))
    for name, table in tables.items():
        none = (F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest)
        whole = whole.union(table.dropna(subset=keys).select(*keys, *none, F.lit(False), *(F.lit(n == name) for n in tables)))
    over = W.partitionBy(*keys)
    found = whole.select(*keys, *rest, "_own", *(F.bool_or(n).over(over).alias(n) for n in tables))
    return found.where("_own").drop("_own")


def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on the keys; a key's rows of both tables have to fit into a row."""
    sides = {"_l": left.dropna(subset=keys), "_r": right.dropna(subset=keys)}
    own = {n: F.struct(*(c for c in t.columns if c not in keys)) for n, t in sides.items()}
    kinds = {n: t.select(own[n].alias("x")).schema["x"].dataType for n, t in sides.items()}
    a, b = (t.select(*keys, *((own[n] if n == name else F.lit(None).cast(kinds[n])).alias(n) for n in sides)) for name, t in sides.items())
    lists = a.union(b).groupBy(*keys).agg(F.collect_list("_l").alias("_l"), F.collect_list("_r").alias("_r"))  # nulls are not collected
    return lists.select(*keys, F.explode("_l").alias("_l"), "_r").select(*keys, "_l", F.explode("_r").alias("_r")).select(*keys, "_l.*", "_r.*")


def ancestors(edges: DataFrame) -> DataFrame:
    """Transitive closure (graph, node, ancestor), by doubling: pairs at distance up to 2^k after round k."""
    closure = settled(edges.select("graph", F.col("dst").alias("node"), F.col("src").alias("ancestor")).distinct())
    size = closure.count()
    while True:
        far = closure.select("graph", F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        closure = settled(closure.union(closure.join(far, ["graph", "ancestor"]).select("graph", "node", F.col("further").alias("ancestor"))).distinct())
        if (now := closure.count()) == size:
            return closure
        size = now


def levels(edges: DataFrame) -> DataFrame:
    """Topological level of each node: its longest path from a root.  Cyclic graphs raise.

    Round by round the nodes without an edge into them get the round's number and
    go with their edges, so each round handles only what is left.
    """
    left = settled(edges.select("graph", "src", "dst").distinct())
    nodes = settled(left.select("graph", F.col("src").alias("node")).union(left.select("graph", "dst")).distinct())
    found, size, level = None, nodes.count(), 0
    while size:
        inner = settled(left.select("graph", F.col("dst").alias("node")).distinct())
        rest = inner.count()
        if rest == size:
            raise ValueError("a graph has a cycle")
        here = nodes.join(inner, ["graph", "node"], "left_anti").withColumn("level", F.lit(level))
        found = here if found is None else found.union(here)
        left = settled(left.join(inner.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi").select("graph", "src", "dst"))
        nodes, size, level = inner, rest, level + 1
    return found if found is not None else nodes.withColumn("level", F.lit(0))


def skeleton(edges: DataFrame) -> DataFrame:
    """Undirected pairs a < b."""
    return edges.select("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def v_structures(edges: DataFrame) -> DataFrame:
    """Colliders left -> mid <- right with non-adjacent ends, left < right."""
    l, r = edges.select("graph", F.col("src").alias("l"), F.col("dst").alias("mid")), edges.select("graph", F.col("src").alias("r"), F.col("dst").alias("mid"))
    pairs = l.join(r, ["graph", "mid"]).where("l < r").distinct()
    return pairs.join(skeleton(edges).select("graph", F.col("a").alias("l"), F.col("b").alias("r")), ["graph", "l", "r"], "left_anti").select("graph", F.col("l").alias("left"), "mid", F.col("r").alias("right"))


def markov_blankets(edges: DataFrame) -> DataFrame:
    """(graph, node, member): parents, children and other parents of children."""
    up = edges.select("graph", F.col("dst").alias("node"), F.col("src").alias("member"))
    down = edges.select("graph", F.col("src").alias("node"), F.col("dst").alias("member"))
    spouse = down.select("graph", "node", F.col("member").alias("child")).join(edges.select("graph", F.col("dst").alias("child"), F.col("src").alias("member")), ["graph", "child"])
    return up.union(down).union(spouse.select("graph", "node", "member")).where("node <> member").distinct()


def cpdag(edges: DataFrame) -> DataFrame:
    """Completed partially directed graph of DAGs: (graph, src, dst, kind), undirected edges once with src < dst.

    Collider arrows first, then the orientation rules as joins until nothing changes.
    """
    pairs = skeleton(edges)
    near = settled(pairs.select("graph", F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("graph", F.col("b"), F.col("a"))))
    v = v_structures(edges)
    arrows = settled(v.select("graph", F.col("left").alias("x"), F.col("mid").alias("y")).union(v.select("graph", F.col("right"), F.col("mid"))).distinct())
    size = arrows.count()
    while True:
        turned = arrows.select("graph", F.col("y").alias("x"), F.col("x").alias("y"))
        free = settled(near.join(arrows, ["graph", "x", "y"], "left_anti").join(turned, ["graph", "x", "y"], "left_anti"))
        a = arrows.select("graph", F.col("x").alias("w"), F.col("y").alias("x"))
        apart = near.select("graph", F.col("x").alias("w"), "y")
        away = free.join(a, ["graph", "x"]).where("w <> y").join(apart, ["graph", "w", "y"], "left_anti").select("graph", "x", "y")
        b = arrows.select("graph", F.col("x").alias("w"), "y")
        chain = free.join(arrows.select("graph", "x", F.col("y").alias("w")), ["graph", "x"]).join(b, ["graph", "w", "y"]).select("graph", "x", "y")
        side = free.select("graph", "x", F.col("y").alias("w")).join(b, ["graph", "w"])  # x - w -> y
        two = side.select("graph", "x", "y", F.col("w").alias("w1")).join(side.select("graph", "x", "y", F.col("w").alias("w2")), ["graph", "x", "y"]).where("w1 < w2")
        two = two.join(near.select("graph", F.col("x").alias("w1"), F.col("y").alias("w2")), ["graph", "w1", "w2"], "left_anti").join(free, ["graph", "x", "y"]).select("graph", "x", "y")
        arrows = settled(arrows.union(away).union(chain).union(two).distinct())
        if (now := arrows.count()) == size:
            break
        size = now
    lines = free.where("x < y")
    return arrows.select("graph", F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("directed").alias("kind")).union(
        lines.select("graph", F.col("x"), F.col("y"), F.lit("undirected"))
    )


def edge_confusion(true: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """tp, fp, fn, tn over ordered pairs, rates, precision, F1 and MCC per graph; ``nodes``: (graph, n_nodes)."""
    both = marked(["graph", "src", "dst"], t=true, f=found)
    counts = both.groupBy("graph").agg(*(F.count_if(c).alias(n) for n, c in (("tp", F.col("t") & F.col("f")), ("fp", F.col("f") & ~F.col("t")), ("fn", F.col("t") & ~F.col("f")))))
    counts = nodes.join(counts, "graph", "left").fillna(0, ["tp", "fp", "fn"]).withColumn("tn", F.col("n_nodes") * (F.col("n_nodes") - 1) - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b, empty: F.when(b == 0, float(empty)).otherwise(a / b)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "graph", "tp", "fp", "fn", "tn", ratio(tp, tp + fn, 1).alias("tpr"), ratio(fp, fp + tn, 0).alias("fpr"),
        ratio(tp, tp + fp, 1).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn, 1).alias("f1"), ratio(tp * tn - fp * fn, root, 1).alias("mcc"),
    )


def shd(a: DataFrame, b: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed symmetric difference per graph (a reversal counts two), its share of all pairs, and the variant that counts a reversal once."""
    x, y = (g.select("graph", "src", "dst").distinct() for g in (a, b))
    only = x.exceptAll(y).withColumn("side", F.lit(0)).union(y.exceptAll(x).withColumn("side", F.lit(1)))
    pairs = only.groupBy("graph", F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    found = pairs.groupBy("graph").agg(F.sum("n").alias("shd"), F.count(F.lit(1)).alias("shd_single"))
    return nodes.join(found, "graph", "left").fillna(0, ["shd", "shd_single"]).select("graph", "shd", "shd_single", (F.col("shd") / (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2)).alias("shd_share"))


def order_scores(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Per graph the edges that point backwards in an order (graph, node, rank), and the share that point forwards."""
    s, d = order.select("graph", F.col("node").alias("src"), F.col("rank").alias("rs")), order.select("graph", F.col("node").alias("dst"), F.col("rank").alias("rd"))
    rows = edges.join(s, ["graph", "src"]).join(d, ["graph", "dst"])
    return rows.groupBy("graph").agg(F.count_if(F.col("rs") > F.col("rd")).alias("backward"), F.avg((F.col("rs") < F.col("rd")).cast("double")).alias("forward_share"))


def kendall(a: DataFrame, b: DataFrame) -> DataFrame:
    """Kendall's tau per graph of two orders (graph, node, rank), from node pairs of each graph."""
    both = a.select("graph", "node", F.col("rank").alias("ra")).join(b.select("graph", "node", F.col("rank").alias("rb")), ["graph", "node"])
    x = both.select("graph", F.col("node").alias("n1"), F.col("ra").alias("a1"), F.col("rb").alias("b1"))
    y = both.select("graph", F.col("node").alias("n2"), F.col("ra").alias("a2"), F.col("rb").alias("b2"))
    agree = F.signum((F.col("a1") - F.col("a2")).cast("double")) * F.signum((F.col("b1") - F.col("b2")).cast("double"))
    return x.join(y, "graph").where("n1 < n2").groupBy("graph").agg(F.avg(agree).alias("tau"))


def endpoint_edges(cells: DataFrame) -> DataFrame:
    """Endpoint cells (graph, i, j, m) with -1 tail, 1 arrow, 2 circle at j to edges (src, dst, kind), each pair once."""
    a, b = cells.select("graph", "i", "j", F.col("m").alias("at_j")), cells.select("graph", F.col("j").alias("i"), F.col("i").alias("j"), F.col("m").alias("at_i"))
    pairs = a.join(b, ["graph", "i", "j"])
    kind = (
        F.when((F.col("at_i") == -1) & (F.col("at_j") == 1), "directed")
        .when((F.col("at_i") == 1) & (F.col("at_j") == 1) & (F.col("i") < F.col("j")), "bidirected")
        .when((F.col("at_i") == -1) & (F.col("at_j") == -1) & (F.col("i") < F.col("j")), "undirected")
        .when((F.col("at_i") == 2) & (F.col("at_j") == 1), "semidirected")
        .when((F.col("at_i") == 2) & (F.col("at_j") == 2) & (F.col("i") < F.col("j")), "undirected")
    )
    return pairs.withColumn("kind", kind).where("kind is not null").select("graph", F.col("i").alias("src"), F.col("j").alias("dst"), "kind")


def canonical(edges: DataFrame) -> DataFrame:
    """Directed edges with each bidirected one (kind) replaced by a latent parent of both ends."""
    latent = F.concat(F.lit("latent:"), F.col("src"), F.lit("~"), F.col("dst"))
    both = edges.where("kind = 'bidirected'")
    keep = edges.where("kind = 'directed'").select("graph", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return keep.union(both.select("graph", latent, F.col("src").cast("string"))).union(both.select("graph", latent, F.col("dst").cast("string")))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that each one reaches over undirected edges (a, b), by minima and contraction."""
    found = nodes.select("node", F.col("node").alias("component")).distinct()
    left = settled(edges.select("a", "b").where("a <> b").distinct())
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        found = settled(found.join(step.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        ends = left.join(step, "a").select("b", F.col("to").alias("x")).join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = settled(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return found


def rank_scores(scores: DataFrame, score: str, positive: str, k: int) -> DataFrame:
    """Area under the ROC curve from average ranks, and precision at k."""
    from shiftscope.operators.moments import running_totals

    counts = scores.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(positive).alias("p"))
    ranked = running_totals(counts, score, ["n"]).withColumn("rank", F.col("n_run") - (F.col("n") - 1) / 2)
    area = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    top = scores.orderBy(F.desc(score)).limit(k).agg(F.avg(F.col(positive).cast("double")).alias("precision_at_k"))
    auc = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * (F.col("nn") - F.col("np")))
    return area.select(auc.alias("auroc")).join(F.broadcast(top))
