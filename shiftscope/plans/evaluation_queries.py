"""Queries of ``operators.evaluation`` over the driver's tables, each with SQL that gives the same rows.

Orders are graphs over their line numbers (the edges of ``table_queries``), suppliers
form node sets, users' events are labelings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftscope.operators import evaluation as ev, labels, moments, resampling, separation
from shiftscope.plans.table_queries import CELLS, EDGES, GRAPHS, LABELS, NODE_LABELS, OTHER, QUERIES as DONE, _edges, _labels, _node_labels, _nodes, order_lines, read, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        assert f.__name__ not in DONE
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""SELECT round(h, 6) AS homogeneity, round(c, 6) AS completeness, round(2 * h * c / (h + c), 6) AS v_measure FROM (SELECT mi / ha AS h, mi / hb AS c FROM
(SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb FROM {CELLS}))""")
def v_measure(spark, sf_dir):
    return rounded(ev.v_measure(_labels(spark, sf_dir), "a", "b"))


@query(f"SELECT round((sum(n * n) - max(t)) / (sqrt(sum(n * na) - max(t)) * sqrt(sum(n * nb) - max(t))), 6) AS fowlkes_mallows FROM {CELLS}")
def fowlkes_mallows(spark, sf_dir):
    return rounded(ev.fowlkes_mallows(_labels(spark, sf_dir), "a", "b"))


@query(f"SELECT c, count(DISTINCT a) AS true_k, count(DISTINCT b) AS found_k, abs(count(DISTINCT a) - count(DISTINCT b)) AS err_k, round(abs(count(DISTINCT a) - count(DISTINCT b)) / count(DISTINCT a), 6) AS relerr_k FROM {LABELS} GROUP BY c")
def label_counts(spark, sf_dir):
    return rounded(ev.label_counts(_labels(spark, sf_dir), ["c"], "a", "b"))


@query("""WITH s AS (SELECT l_suppkey, avg(l_discount) AS f1, count(*) AS w, sum(l_linenumber) % 2 = 0 AS v FROM lineitem GROUP BY 1) SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * w) / sum(w), 6) AS micro_f1,
round(avg(CASE WHEN v THEN f1 END), 6) AS macro_variant_f1, round(avg(CASE WHEN NOT v THEN f1 END), 6) AS macro_invariant_f1, count(*) AS n_nodes, count(*) FILTER (WHERE v) AS n_variant, count(*) FILTER (WHERE NOT v) AS n_invariant, sum(w)::BIGINT AS total_pairs FROM s""")
def change_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("f1"), F.count(F.lit(1)).alias("n_pairs"), (F.sum("l_linenumber") % 2 == 0).alias("is_variant"))
    return rounded(ev.change_summary(rows, ["f1"]))


@query("""WITH m AS (SELECT (user_id % 12)::INT AS node, (event_id % 8)::INT AS label, list_sort(list(DISTINCT event_type)) AS members FROM events GROUP BY 1, 2) SELECT node, label, unnest(members) AS member FROM m""")
def group_members(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).cast("int").alias("node"), (F.col("event_id") % 8).cast("int").alias("label")).agg(F.array_sort(F.collect_set("event_type")).alias("members"))
    return ev.groups_to_labels(rows, ["node"])


@query(f"""WITH l AS {NODE_LABELS}, m AS (SELECT node, max(label) AS k FROM l GROUP BY 1), g AS (SELECT node, unnest(range(k + 1))::INT AS label FROM m) SELECT g.node, g.label, count(l.context) AS n, coalesce(string_agg(l.context::VARCHAR, ',' ORDER BY l.context), '') AS members FROM g LEFT JOIN l ON l.node = g.node AND l.label = g.label GROUP BY 1, 2""")
def label_groups(spark, sf_dir):
    got = ev.labels_to_groups(_node_labels(spark, sf_dir).withColumnRenamed("context", "member"), ["node"])
    return got.select("node", F.col("label").cast("int").alias("label"), F.size("members").cast("long").alias("n"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"""WITH l AS {NODE_LABELS}, z AS (SELECT b.node, b.context, (a.label <> b.label)::INT AS shift FROM l a JOIN l b ON a.node = b.node AND a.context = 0 AND b.context > 0)
SELECT node, context, (CASE WHEN shift = 0 THEN 0 ELSE sum(shift) OVER (PARTITION BY node ORDER BY context) END)::INT AS label FROM z UNION ALL SELECT DISTINCT node, 0, 0 FROM z""")
def singleton_labels(spark, sf_dir):
    return ev.singleton_labels(DONE["shift_pairs"](spark, sf_dir))


@query(f"WITH {EDGES} SELECT graph, count(*) AS n_edges FROM g GROUP BY 1")
def edge_counts(spark, sf_dir):
    return ev.edge_counts(_edges(spark, sf_dir))


NEAR = "n AS MATERIALIZED (SELECT DISTINCT graph, src AS i, dst AS j FROM h UNION SELECT graph, dst, src FROM h)"


@query(f"WITH {OTHER}, {NEAR} SELECT a.graph, a.i, a.j, b.j AS k FROM n a JOIN n b ON a.graph = b.graph AND a.j = b.i AND a.i < b.j WHERE NOT EXISTS (SELECT 1 FROM n e WHERE e.graph = a.graph AND e.i = a.i AND e.j = b.j)")
def unshielded_triples(spark, sf_dir):
    return ev.unshielded_triples(_edges(spark, sf_dir, True))


@query(f"WITH {OTHER}, {NEAR} SELECT a.graph, a.i, a.j, b.j AS k FROM n a JOIN n b ON a.graph = b.graph AND a.j = b.i AND a.i < a.j AND b.i < b.j JOIN n e ON e.graph = a.graph AND e.i = a.i AND e.j = b.j")
def triangles(spark, sf_dir):
    return ev.triangles(_edges(spark, sf_dir, True))


@query(f"""WITH {OTHER}, {NEAR}, t AS (SELECT a.graph, a.i, a.j AS x, b.j AS l FROM n a JOIN n b ON a.graph = b.graph AND a.j = b.i AND a.i < b.j JOIN n e ON e.graph = a.graph AND e.i = a.i AND e.j = b.j)
SELECT p.graph, p.i, p.x AS j, q.x AS k, p.l FROM t p JOIN t q ON p.graph = q.graph AND p.i = q.i AND p.l = q.l AND p.x < q.x WHERE NOT EXISTS (SELECT 1 FROM n e WHERE e.graph = p.graph AND e.i = p.x AND e.j = q.x)""")
def kites(spark, sf_dir):
    return ev.kites(_edges(spark, sf_dir, True))


@query(f"""WITH {EDGES}, n AS (SELECT graph, src AS i, dst AS j FROM g UNION SELECT graph, dst, src FROM g), p AS (SELECT * FROM n WHERE i < j), s AS (SELECT graph, i, j, i AS a FROM p UNION SELECT graph, i, j, j FROM p),
o AS (SELECT s.graph, s.i, s.j, s.a, n.j AS x FROM s JOIN n ON n.graph = s.graph AND n.i = s.a AND n.j <> s.i AND n.j <> s.j),
c AS (SELECT graph, i, j, '' AS given FROM p UNION SELECT graph, i, j, x::VARCHAR FROM o UNION SELECT u.graph, u.i, u.j, u.x::VARCHAR || ',' || v.x::VARCHAR FROM o u JOIN o v ON u.graph = v.graph AND u.i = v.i AND u.j = v.j AND u.a = v.a AND u.x < v.x)
SELECT graph, count(*) AS n_sets, count(DISTINCT given) AS n_given, min(given) AS least, max(given) AS most FROM c GROUP BY 1""")
def conditioning_sets(spark, sf_dir):
    rows = ev.conditioning_sets(_edges(spark, sf_dir), 2).withColumn("given", F.array_join(F.col("given").cast("array<string>"), ","))
    return rows.groupBy("graph").agg(F.count(F.lit(1)).alias("n_sets"), F.countDistinct("given").alias("n_given"), F.min("given").alias("least"), F.max("given").alias("most"))


@query(f"WITH {EDGES}, k AS (SELECT l_orderkey AS graph, l_linenumber AS node FROM lineitem GROUP BY 1, 2 HAVING max(l_tax) > 0.03) SELECT graph, src, dst FROM g WHERE (graph, src) IN (SELECT * FROM k) AND (graph, dst) IN (SELECT * FROM k)")
def induced_edges(spark, sf_dir):
    nodes = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node")).agg(F.max("l_tax").alias("t")).where("t > 0.03")
    return ev.induced(_edges(spark, sf_dir), nodes)


# the lines of an order with one discount step form a node set
SETS = "k AS (SELECT DISTINCT l_orderkey AS graph, round(l_discount * 100)::INT // 3 AS set_id, l_linenumber AS node FROM lineitem)"
BOTH = "m AS (SELECT DISTINCT a.graph, a.node AS i, b.node AS j FROM k a JOIN k b USING (graph, set_id) WHERE a.node <> b.node)"
TAXED = SETS.replace("k AS", "f AS").replace("l_discount", "l_tax")


def _sets(spark, sf_dir, column: str = "l_discount"):
    return order_lines(spark, sf_dir, F.expr(f"cast(round({column} * 100) as int) div 3").cast("int").alias("set_id"), F.col("l_linenumber").alias("node")).distinct()


@query(f"WITH {EDGES}, {SETS}, {BOTH} SELECT graph, src, dst FROM g UNION SELECT graph, i, j FROM m")
def confounded_adjacency(spark, sf_dir):
    return ev.with_confounded(_edges(spark, sf_dir), _sets(spark, sf_dir))


@query(f"WITH {EDGES}, {OTHER}, u AS (SELECT * FROM g UNION SELECT * FROM h) SELECT graph, least(src, dst) AS src, greatest(src, dst) AS dst, 'bidirected' AS kind FROM u GROUP BY 1, 2, 3 HAVING count(*) = 2 UNION ALL SELECT graph, src, dst, 'directed' FROM u WHERE (graph, dst, src) NOT IN (SELECT * FROM u)")
def mutual_edges(spark, sf_dir):
    return ev.mutual_as_bidirected(_edges(spark, sf_dir).union(_edges(spark, sf_dir, True)))


@query(f"WITH {OTHER} SELECT graph, src, dst FROM h WHERE src < 6 AND dst < 6")
def without_context_node(spark, sf_dir):
    return ev.without_last(_edges(spark, sf_dir, True), _nodes(spark, sf_dir))


KINDS = f"e AS (SELECT graph, least(src, dst) AS src, greatest(src, dst) AS dst, 'undirected' AS kind FROM h WHERE (src + dst) % 3 = 0 UNION SELECT graph, src, dst, 'directed' FROM h WHERE (src + dst) % 3 <> 0)"


@query(f"WITH {OTHER}, {KINDS} SELECT graph, src, dst, max(d)::INT AS directed FROM (SELECT graph, src, dst, (kind = 'directed')::INT AS d FROM e UNION ALL SELECT graph, dst, src, 0 FROM e WHERE kind = 'undirected') GROUP BY 1, 2, 3")
def kind_adjacency(spark, sf_dir):
    h = _edges(spark, sf_dir, True)
    line = (F.col("src") + F.col("dst")) % 3 == 0
    kinds = h.select("graph", F.when(line, F.least("src", "dst")).otherwise(F.col("src")).alias("src"), F.when(line, F.greatest("src", "dst")).otherwise(F.col("dst")).alias("dst"), F.when(line, "undirected").otherwise("directed").alias("kind"))
    return ev.adjacency_kinds(kinds)


@query(f"""WITH {EDGES}, {OTHER}, w AS (SELECT * FROM h UNION SELECT graph, dst, src FROM h WHERE (src + dst) % 3 = 0), o AS (SELECT * FROM w WHERE (graph, dst, src) NOT IN (SELECT * FROM w)),
s AS (SELECT g.graph, count(*) AS n, count(*) FILTER (WHERE (g.graph, g.src, g.dst) IN (SELECT * FROM o)) AS tp, count(*) FILTER (WHERE (g.graph, g.dst, g.src) IN (SELECT * FROM o)) AS fp FROM g GROUP BY 1)
SELECT graph, tp, fp, round(tp / n, 6) AS true_rate, round(fp / n, 6) AS false_rate, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS "precision", round(tp / n, 6) AS recall FROM s""")
def orientation_scores(spark, sf_dir):
    h = _edges(spark, sf_dir, True)
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = F.when((F.col("src") + F.col("dst")) % 3 == 0, F.array(pair("src", "dst"), pair("dst", "src"))).otherwise(F.array(pair("src", "dst")))
    return rounded(ev.orientation_scores(_edges(spark, sf_dir), h.select("graph", F.explode(both).alias("e")).select("graph", "e.*")))


@query("""WITH p AS (SELECT l_suppkey AS graph, l_discount AS threshold, round(avg(l_tax), 4) AS recall, round(avg(l_quantity) / 50, 4) AS "precision" FROM lineitem GROUP BY 1, 2)
SELECT graph, round(sum(s * "precision"), 6) AS average_precision FROM (SELECT *, recall - coalesce(lag(recall) OVER (PARTITION BY graph ORDER BY recall, threshold), 0) AS s FROM p) GROUP BY 1""")
def average_precision(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("graph"), F.col("l_discount").alias("threshold")).agg(F.round(F.avg("l_tax"), 4).alias("recall"), F.round(F.avg("l_quantity") / 50, 4).alias("precision"))
    return rounded(ev.average_precision(rows, ["graph"]))


ORDERS = "r AS (SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY node) - 1 AS a, row_number() OVER (PARTITION BY graph ORDER BY q, node) - 1 AS b FROM (SELECT l_orderkey AS graph, l_linenumber AS node, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2))"


def _orders(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node")).agg(F.max("l_quantity").alias("q"))
    over = W.partitionBy("graph")
    return (rows.select("graph", "node", (F.row_number().over(over.orderBy(*k)) - 1).alias("rank")) for k in (["node"], ["q", "node"]))


@query(f"WITH {ORDERS} SELECT graph, sum(abs(a - b))::BIGINT AS distance, round(CASE WHEN count(*) = 1 THEN 1 ELSE 1 - sum(abs(a - b)) / (count(*) * (count(*) - 1) // 2) END, 6) AS closeness FROM r GROUP BY 1")
def order_distance(spark, sf_dir):
    return rounded(ev.order_distances(*_orders(spark, sf_dir))[1])


@query(f"WITH {ORDERS} SELECT graph, node, abs(a - b) AS rank_error FROM r")
def rank_errors(spark, sf_dir):
    return ev.order_distances(*_orders(spark, sf_dir))[0].withColumn("rank_error", F.col("rank_error").cast("long"))


THIRD = "o AS (SELECT * FROM g WHERE (src + dst) % 2 = 0 UNION SELECT * FROM h WHERE src < dst)"


@query(f"""WITH {EDGES}, {OTHER}, {THIRD}, u AS (SELECT *, ((graph, src, dst) IN (SELECT * FROM g))::INT AS t, ((graph, src, dst) IN (SELECT * FROM h))::INT AS b, ((graph, src, dst) IN (SELECT * FROM o))::INT AS o FROM (SELECT * FROM g UNION SELECT * FROM h UNION SELECT * FROM o)),
c AS (SELECT graph, count(*) AS seen, sum(t * b) AS tpb, sum((1 - t) * b) AS fpb, sum(t * (1 - b)) AS fnb, sum((1 - t) * (1 - b)) AS tnb, sum(t * o) AS tpo, sum((1 - t) * o) AS fpo, sum(t * (1 - o)) AS fno, sum((1 - t) * (1 - o)) AS tno FROM u GROUP BY 1)
SELECT graph, coalesce(tpo - tpb, 0)::BIGINT AS tp, coalesce(fpb - fpo, 0)::BIGINT AS fp, round(coalesce(2 * tpo / nullif(2 * tpo + fpo + fno, 0), 1) - coalesce(2 * tpb / nullif(2 * tpb + fpb + fnb, 0), 1), 6) AS f1,
round(coalesce((tpo + fpo) / seen, 0) - coalesce((tpb + fpb) / seen, 0), 6) AS pr_adjusted, round(coalesce(fpb / nullif(fpb + tnb, 0), 0) - coalesce(fpo / nullif(fpo + tno, 0), 0), 6) AS fpr_adjusted FROM {GRAPHS} LEFT JOIN c USING (graph)""")
def metric_improvement(spark, sf_dir):
    g, h = _edges(spark, sf_dir), _edges(spark, sf_dir, True)
    third = g.where((F.col("src") + F.col("dst")) % 2 == 0).union(h.where("src < dst")).distinct()
    return rounded(ev.improvement(g, h, third, _nodes(spark, sf_dir)))


# links between lines of an order: the lag is the difference of their tax steps
LINKS = "t AS (SELECT DISTINCT a.l_orderkey AS graph, a.l_linenumber AS parent, abs(round(a.l_tax * 100)::INT - round(b.l_tax * 100)::INT) // 3 AS lag, b.l_linenumber AS child FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity <= b.l_quantity)"


def _links(spark, sf_dir):
    """Links of an order, repeated where it has a line number twice."""
    rows = order_lines(spark, sf_dir, "l_linenumber", "l_quantity", F.round(F.col("l_tax") * 100).cast("int").alias("tax"))
    a, b = (rows.select("graph", F.col("l_linenumber").alias(n), F.col("l_quantity").alias(f"q_{n}"), F.col("tax").alias(f"t_{n}")) for n in ("parent", "child"))
    return a.join(b, "graph").where("q_parent <= q_child").select("graph", "parent", F.expr("abs(t_parent - t_child) div 3").cast("int").alias("lag"), "child")


@query(f"WITH {LINKS} SELECT DISTINCT graph, parent AS src, child AS dst FROM t WHERE parent <> child")
def summary_graph(spark, sf_dir):
    return ev.summary_graph(_links(spark, sf_dir))


@query(f"WITH {LINKS} SELECT DISTINCT graph, 8 * lag + parent AS src, child AS dst FROM t WHERE NOT (lag = 0 AND parent = child)")
def window_graph(spark, sf_dir):
    return ev.window_graph(_links(spark, sf_dir), 8)


@query(f"""WITH {LINKS}, c AS (SELECT DISTINCT graph, child AS parent, (lag + 1) % 3 AS lag, parent AS child FROM t UNION SELECT graph, parent, lag, child FROM t WHERE (parent + child) % 2 = 0)
SELECT graph, parent, lag, child, CASE WHEN (graph, parent, lag, child) IN (SELECT * FROM t) THEN 'caus' WHEN parent = child THEN 'auto' WHEN (graph, parent, child) IN (SELECT graph, parent, child FROM t) THEN 'caus-diff-lg'
WHEN (graph, child, parent) IN (SELECT graph, parent, child FROM t) THEN 'rev' ELSE 'spu' END AS kind FROM c""")
def link_kinds(spark, sf_dir):
    links = _links(spark, sf_dir)
    turned = F.struct(F.col("child").alias("parent"), ((F.col("lag") + 1) % 3).alias("lag"), F.col("parent").alias("child"))
    both = F.when((F.col("parent") + F.col("child")) % 2 == 0, F.array(turned, F.struct("parent", "lag", "child"))).otherwise(F.array(turned))
    return ev.link_kinds(links, links.select("graph", F.explode(both).alias("e")).select("graph", "e.*").distinct())


@query("""WITH s AS (SELECT l_suppkey AS graph, l_linenumber AS parent, avg(l_quantity) AS w, min(l_quantity) AS f FROM lineitem GROUP BY 1, 2) SELECT graph, parent, round(w - f, 6) AS strength,
round(CASE WHEN max(w - f) OVER (PARTITION BY graph) = 0 THEN 0 ELSE (w - f) / max(w - f) OVER (PARTITION BY graph) END, 6) AS share FROM s""")
def edge_strengths(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("graph"), F.col("l_linenumber").alias("parent")).agg(F.avg("l_quantity").alias("without"), F.min("l_quantity").alias("with_all"))
    return rounded(ev.edge_strengths(rows).select("graph", "parent", "strength", "share"))


# a decision for every ordered pair of an order's lines
PAIRS = "p AS (SELECT a.l_orderkey AS graph, a.l_linenumber AS i, b.l_linenumber AS j, bool_or(a.l_returnflag = b.l_returnflag) AS found, min((a.l_quantity::INT + b.l_quantity::INT) % 8) AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY 1, 2, 3)"


def _pairs(spark, sf_dir):
    rows = order_lines(spark, sf_dir, "l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").alias("quantity"))
    a, b = (rows.select("graph", F.col("l_linenumber").alias(n), F.col("l_returnflag").alias(f"f_{n}"), F.col("quantity").alias(f"q_{n}")) for n in "ij")
    return a.join(b, "graph").where("i <> j").groupBy("graph", "i", "j").agg(F.bool_or(F.col("f_i") == F.col("f_j")).alias("found"), F.min((F.col("q_i") + F.col("q_j")) % 8).alias("s"))


RATES = 'round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS tpr, round(coalesce(fp / nullif(tn + fp, 0), 0), 6) AS fpr, round(coalesce(fp / nullif(tp + fp, 0), 0), 6) AS fdr'
COUNTS = "count(*) FILTER (WHERE t AND f) AS tp, count(*) FILTER (WHERE NOT t AND f) AS fp, count(*) FILTER (WHERE NOT t AND NOT f) AS tn, count(*) FILTER (WHERE t AND NOT f) AS fn"


@query(f"WITH {SETS}, {BOTH}, {PAIRS}, d AS (SELECT graph, (graph, i, j) IN (SELECT * FROM m) AS t, found AS f FROM p), c AS (SELECT graph, {COUNTS} FROM d GROUP BY 1) SELECT *, {RATES} FROM c")
def confounded_scores(spark, sf_dir):
    return rounded(ev.confounded_scores(_pairs(spark, sf_dir), _sets(spark, sf_dir)))


OUTCOME = "CASE WHEN {0} AND {1} THEN 'tp' WHEN {1} THEN 'fp' WHEN {0} THEN 'fn' ELSE 'tn' END"


@query(f"""WITH {EDGES}, {OTHER}, {SETS}, {BOTH}, {PAIRS}, d AS (SELECT graph, (graph, i, j) IN (SELECT * FROM g) AS t, (graph, i, j) IN (SELECT * FROM h) AS f, (graph, i, j) IN (SELECT * FROM m) AS c, found FROM p)
SELECT graph, {OUTCOME.format('t', 'f')} AS causal, {OUTCOME.format('c', 'found')} AS confounded, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def causal_confounded_counts(spark, sf_dir):
    return ev.causal_confounded_counts(_edges(spark, sf_dir), _edges(spark, sf_dir, True), _pairs(spark, sf_dir), _sets(spark, sf_dir))


NAMES = "['" + "', '".join(ev.STATES) + "']"


@query(f"""WITH {EDGES}, {SETS}, {BOTH}, {PAIRS}, d AS (SELECT ({NAMES})[s + 1] AS s, (graph, i, j) IN (SELECT * FROM g) AS a, (graph, j, i) IN (SELECT * FROM g) AS b, (graph, i, j) IN (SELECT * FROM m) AS c FROM p WHERE i < j),
x AS (SELECT 'dir' AS decision, a OR b AS t, s IN ('caus', 'rev', 'undir', 'caus_confd', 'rev_confd', 'undir_confd') AS f FROM d UNION ALL
SELECT 'cdir', a OR b, CASE WHEN a THEN s IN ('caus', 'caus_confd') WHEN b THEN s IN ('rev', 'rev_confd') ELSE s IN ('caus', 'caus_confd', 'rev', 'rev_confd') END FROM d UNION ALL
SELECT 'cfd', c, s IN ('confd', 'caus_confd', 'rev_confd', 'undir_confd') FROM d UNION ALL SELECT 'coo', c AND NOT (a OR b), s = 'confd' FROM d UNION ALL
SELECT 'coca', c AND (a OR b), s IN ('caus_confd', 'rev_confd', 'undir_confd') FROM d UNION ALL SELECT 'indep', NOT (a OR b) AND NOT c, s = 'indep' FROM d), y AS (SELECT decision, {COUNTS} FROM x GROUP BY 1) SELECT *, {RATES} FROM y""")
def edge_state_scores(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ev.STATES)), F.col("s") + 1)
    states = _pairs(spark, sf_dir).where("i < j").select("graph", "i", "j", state.alias("state"))
    return rounded(ev.edge_state_scores(states, _edges(spark, sf_dir), _sets(spark, sf_dir)))


KEPT = "k AS (SELECT DISTINCT l_orderkey AS graph, l_linenumber AS node, max(l_discount > 0.04) AS t, max(l_tax > 0.04) AS f FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {KEPT}, c AS (SELECT graph, count(*) FILTER (WHERE t AND f) AS b, count(*) FILTER (WHERE t) AS nt, count(*) FILTER (WHERE f) AS nf, count(*) AS n FROM k WHERE t OR f GROUP BY 1),
r AS (SELECT *, CASE WHEN nf = 0 THEN 1 ELSE b / nf END AS p, CASE WHEN nt = 0 THEN 1 ELSE b / nt END AS q, nt + nf - 2 * b AS w FROM c)
SELECT graph, round(p, 6) AS "precision", round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 1 ELSE 2 * p * q / (p + q) END, 6) AS f1, round((n - w) / (n + w), 6) AS "grouping" FROM r""")
def member_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node")).agg(F.max(F.col("l_discount") > 0.04).alias("t"), F.max(F.col("l_tax") > 0.04).alias("f"))
    return rounded(ev.member_scores(rows.where("t"), rows.where("f")))


@query(f"""WITH {SETS}, {TAXED}, c AS (SELECT k.graph, k.set_id AS t, f.set_id AS f, count(*) AS n FROM k JOIN f USING (graph, node) GROUP BY 1, 2, 3), a AS (SELECT graph, set_id AS t, count(*) AS nt FROM k GROUP BY 1, 2), b AS (SELECT graph, set_id AS f, count(*) AS nf FROM f GROUP BY 1, 2)
SELECT graph, t, f, round(n / (nt + nf - n), 6) AS jaccard FROM c JOIN a USING (graph, t) JOIN b USING (graph, f)""")
def set_overlaps(spark, sf_dir):
    return rounded(ev.set_overlaps(_sets(spark, sf_dir), _sets(spark, sf_dir, "l_tax")))


@query("""WITH v AS (SELECT l_suppkey AS g, l_linenumber AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT g, v, lag(v) OVER o AS b, row_number() OVER o AS n FROM v WINDOW o AS (PARTITION BY g ORDER BY k))
SELECT g, coalesce(max(n) FILTER (WHERE abs(v - b) / abs(v) > 0.2), 1)::INT AS components FROM w GROUP BY 1""")
def component_elbow(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("v"))
    return ev.last_elbow(rows, ["g"], "k", "v", 0.2)


@query("""SELECT l_orderkey, l_linenumber, round(cume_dist() OVER (ORDER BY l_quantity), 6) AS l_quantity_u FROM lineitem""")
def rank_uniform(spark, sf_dir):
    return rounded(moments.rank_uniform(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]).drop("l_quantity"))


@query("""SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS o_totalprice_r FROM orders""")
def mean_ranks(spark, sf_dir):
    return moments.ranks(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).drop("o_totalprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE isnan({c}::DOUBLE)) AS nans, count(*) FILTER (WHERE isinf({c}::DOUBLE)) AS infs, count(*) < 3 AS too_few_rows FROM lineitem" for c in ("l_quantity", "l_tax", "l_extendedprice")))
def data_check(spark, sf_dir):
    return moments.data_check(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax", "l_extendedprice"])


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity ** 2), 4) AS square, round(avg(l_quantity ** 3), 2) AS cube, round(avg(exp(l_tax)), 6) AS exponential, round(avg(1 / (CASE WHEN l_tax = 0 THEN 0.0001 ELSE l_tax END)), 3) AS inverse, round(avg(sqrt(l_quantity)), 6) AS root FROM lineitem GROUP BY 1""")
def basis_means(spark, sf_dir):
    q, t = F.col("l_quantity"), F.col("l_tax")
    term = lambda x, k: F.avg(moments.basis_terms(x, k, single=True)[0])
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(term(q, 1), 4).alias("square"), F.round(term(q, 2), 2).alias("cube"), F.round(term(t, 3), 6).alias("exponential"), F.round(term(t, 4), 3).alias("inverse"), F.round(term(q, 7), 6).alias("root")
    )


@query("""WITH o AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
r AS (SELECT k, q, row_number() OVER (ORDER BY ('0x' || substr(md5('1 ' || k), 1, 15))::BIGINT, k) AS a, row_number() OVER (ORDER BY ('0x' || substr(md5('2 ' || k), 1, 15))::BIGINT, k) AS b FROM o)
SELECT x.k, round(y.q, 2) AS q FROM r x JOIN r y ON x.a = y.b""")
def shuffled_column(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return moments.shuffled(rows, "k", "q", 1)


@query(f"""WITH RECURSIVE {EDGES}, {OTHER}, v AS MATERIALIZED (SELECT DISTINCT l_orderkey AS graph, l_linenumber AS node FROM lineitem), gm AS MATERIALIZED (SELECT * FROM g), hm AS MATERIALIZED (SELECT * FROM h),
ag AS (SELECT graph, src AS a, dst AS d FROM gm UNION SELECT c.graph, c.a, e.dst FROM ag c JOIN gm e ON e.graph = c.graph AND e.src = c.d), ah AS (SELECT graph, src AS a, dst AS d FROM hm UNION SELECT c.graph, c.a, e.dst FROM ah c JOIN hm e ON e.graph = c.graph AND e.src = c.d),
p AS MATERIALIZED (SELECT a.graph, a.node AS x, b.node AS y, EXISTS (SELECT 1 FROM hm e WHERE e.graph = a.graph AND ((e.src = a.node AND e.dst = b.node) OR (e.src = b.node AND e.dst = a.node))) AS near,
 EXISTS (SELECT 1 FROM gm e WHERE e.graph = a.graph AND ((e.src = a.node AND e.dst = b.node) OR (e.src = b.node AND e.dst = a.node))) AS near_true,
 EXISTS (SELECT 1 FROM ah e WHERE e.graph = a.graph AND e.a = b.node AND e.d = a.node) AS back FROM v a JOIN v b ON a.graph = b.graph AND a.node < b.node),
z AS MATERIALIZED (SELECT p.graph, p.x, p.y, e.src AS node FROM p JOIN hm e ON e.graph = p.graph AND e.dst = CASE WHEN p.back THEN p.x ELSE p.y END WHERE NOT p.near),
f AS MATERIALIZED (SELECT p.graph, p.x, p.y, v.node, EXISTS (SELECT 1 FROM z WHERE z.graph = p.graph AND z.x = p.x AND z.y = p.y AND z.node = v.node) AS given,
 EXISTS (SELECT 1 FROM z LEFT JOIN ag ON ag.graph = z.graph AND ag.d = z.node WHERE z.graph = p.graph AND z.x = p.x AND z.y = p.y AND (z.node = v.node OR ag.a = v.node)) AS above FROM p JOIN v ON v.graph = p.graph WHERE NOT p.near),
m AS MATERIALIZED (SELECT graph, dst AS node, src AS next, true AS up FROM gm UNION ALL SELECT graph, src, dst, false FROM gm),
r AS (SELECT graph, x, y, x AS node, true AS up FROM p WHERE NOT near UNION SELECT r.graph, r.x, r.y, m.next, m.up FROM r JOIN f ON f.graph = r.graph AND f.x = r.x AND f.y = r.y AND f.node = r.node JOIN m ON m.graph = r.graph AND m.node = r.node
 WHERE CASE WHEN r.up OR NOT m.up THEN NOT f.given ELSE f.above END),
w AS (SELECT DISTINCT graph, x, y FROM r WHERE node = y)
SELECT p.graph, count(*) AS pairs, sum(CASE WHEN near THEN NOT near_true ELSE w.graph IS NOT NULL END::INT)::BIGINT AS wrong FROM p LEFT JOIN w ON w.graph = p.graph AND w.x = p.x AND w.y = p.y GROUP BY 1""")
def separation_distances(spark, sf_dir):
    """Pairs of every order's graph whose separator in another graph over its line items fails, and pairs adjacent there alone."""
    found = separation.distances(_line_numbers(spark, sf_dir), _edges(spark, sf_dir), _edges(spark, sf_dir, True), ("separation",))
    return found.where("nodes > 1").select("graph", (F.col("nodes") * (F.col("nodes") - 1) / 2).cast("long").alias("pairs"), F.col("separation").alias("wrong"))


def adjustment_distances(spark, sf_dir):
    """Ordered pairs of every order's graph whose effect another graph identifies wrongly, by parents and by ancestors, and statements on which both differ."""
    return separation.distances(_line_numbers(spark, sf_dir), _edges(spark, sf_dir), _edges(spark, sf_dir, True), separation.MEASURES[1:])


QUERIES["adjustment_distances"] = adjustment_distances


def _line_numbers(spark, sf_dir):
    return order_lines(spark, sf_dir, F.col("l_linenumber").alias("node"))


#: chances of at most 0, 1, ... copies, as SQL
_COPIES = " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate(resampling.poisson_bounds()))


@query(f"""WITH d AS (SELECT l_returnflag, l_extendedprice AS v, rep, ('0x' || substr(md5('3 ' || (rep // 4) || ' ' || l_orderkey), (1 + 8 * (rep % 4))::INT, 8))::BIGINT / 4294967296.0 AS u FROM lineitem, range(20) r(rep)),
w AS (SELECT l_returnflag, rep, v, CASE {_COPIES} ELSE {resampling.MOST_COPIES} END AS w FROM d)
SELECT l_returnflag, rep::INT AS rep, sum(w)::BIGINT AS n, round(sum(w * v) / sum(w), 4) AS price FROM w GROUP BY 1, 2""")
def bootstrap_means(spark, sf_dir):
    """Mean price per return flag in twenty samples of the orders, drawn with replacement."""
    rows = resampling.bootstrap(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey", ["l_extendedprice"], 20, 3)
    return rows.select("l_returnflag", "rep", F.col("n").cast("long").alias("n"), F.round("mean_l_extendedprice", 4).alias("price"))


@query(f"""WITH d AS (SELECT o_orderpriority, o_totalprice AS v, rep, ('0x' || substr(md5('5 ' || (rep // 4) || ' ' || o_orderkey), (1 + 8 * (rep % 4))::INT, 8))::BIGINT / 4294967296.0 AS u FROM orders, range(40) r(rep)),
w AS (SELECT o_orderpriority, rep, v, CASE {_COPIES} ELSE {resampling.MOST_COPIES} END AS w FROM d), m AS (SELECT o_orderpriority, rep, sum(w * v) / sum(w) AS m FROM w GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS reps, round(avg(m), 2) AS centre, round(stddev_samp(m), 2) AS error, round(quantile_cont(m, 0.025), 2) AS low, round(quantile_cont(m, 0.975), 2) AS high FROM m GROUP BY 1""")
def bootstrap_intervals(spark, sf_dir):
    """Error and interval of the mean order value per priority, from forty samples drawn with replacement."""
    reps = resampling.bootstrap(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", ["o_totalprice"], 40, 5)
    found = resampling.intervals(reps, ["o_orderpriority"], "mean_o_totalprice")
    return found.select("o_orderpriority", "reps", *(F.round(c, 2).alias(c) for c in ("centre", "error", "low", "high")))


@query("""WITH p AS (SELECT c_nationkey, c_custkey AS x, avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS y FROM customer GROUP BY 1, 2),
w AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER l AS xl, last_value(y IGNORE NULLS) OVER l AS yl, first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER r AS xr, first_value(y IGNORE NULLS) OVER r AS yr FROM p
WINDOW l AS (PARTITION BY c_nationkey ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY c_nationkey ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT c_nationkey, x AS c_custkey, round(CASE WHEN y IS NOT NULL THEN y WHEN xl IS NULL THEN yr WHEN xr IS NULL THEN yl ELSE yl + (yr - yl) * (x - xl) / (xr - xl) END, 3) AS balance FROM w""")
def interpolated_balances(spark, sf_dir):
    """Balances of each nation's customers by number, those that are not positive taken from the line between their neighbours."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("y"))
    return resampling.interpolated(rows, "c_custkey", "y", ["c_nationkey"]).select("c_nationkey", "c_custkey", F.round("value", 3).alias("balance"))


@query(f"""WITH {EDGES}, {OTHER}, {SETS}, l AS (SELECT DISTINCT k.graph, k.set_id, i.l_linenumber AS item, i.l_returnflag AS label FROM k JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) i ON i.l_orderkey = k.graph),
s AS (SELECT graph, node, set_id, true AS own FROM k UNION ALL SELECT g.graph, g.dst, k.set_id, false FROM g JOIN k ON k.graph = g.graph AND k.node = g.src WHERE (g.graph, g.src, g.dst) NOT IN (SELECT * FROM h)), t AS (SELECT graph, node, set_id, bool_or(own) AS own FROM s GROUP BY 1, 2, 3)
SELECT t.graph, node, item, coalesce(string_agg(set_id::VARCHAR || ':' || label, '|' ORDER BY set_id) FILTER (WHERE own), '') AS true_label, string_agg(set_id::VARCHAR || ':' || label, '|' ORDER BY set_id) AS observed_label FROM t JOIN l USING (graph, set_id) GROUP BY 1, 2, 3""")
def observed_labels(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    items = order_lines(spark, sf_dir, "l_linenumber", "l_returnflag").groupBy("graph", F.col("l_linenumber").alias("item")).agg(F.min("l_returnflag").alias("label"))
    named = sets.select("graph", "set_id").distinct().join(items, "graph")
    return ev.observed_labels(named, sets, _edges(spark, sf_dir), _edges(spark, sf_dir, True))


@query(f"""WITH {EDGES}, {OTHER}, a AS (SELECT DISTINCT graph, src AS a, dst AS b FROM g), b AS (SELECT DISTINCT graph, least(src, dst) AS a, greatest(src, dst) AS b FROM h), f AS (SELECT graph, coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM (SELECT *, 1 AS t FROM a) FULL JOIN (SELECT *, 1 AS f FROM b) USING (graph, a, b)),
c AS (SELECT graph, coalesce(sum(t * f), 0)::BIGINT AS tp, coalesce(sum(f * (1 - t)), 0)::BIGINT AS fp, coalesce(sum(t * (1 - f)), 0)::BIGINT AS fn FROM {GRAPHS} LEFT JOIN f USING (graph) GROUP BY 1), d AS (SELECT *, 21 - tp - fp - fn AS tn FROM c) SELECT graph, tp, fp, fn, tn, {RATES} FROM d""")
def skeleton_confusion(spark, sf_dir):
    return rounded(ev.skeleton_confusion(_edges(spark, sf_dir), _edges(spark, sf_dir, True), _nodes(spark, sf_dir)))


@query("""WITH r AS (SELECT l_suppkey AS node, l_returnflag AS a, l_linestatus AS b FROM lineitem), c AS (SELECT node, a, b, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY node, a))::DOUBLE AS na, (sum(count(*)) OVER (PARTITION BY node, b))::DOUBLE AS nb, (sum(count(*)) OVER (PARTITION BY node))::DOUBLE AS t FROM r GROUP BY 1, 2, 3),
s AS (SELECT node, sum(n / t * ln(n * t / (na * nb))) AS mi, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb, sum(n * (n - 1) / 2) AS bth, sum(n / na * (na * (na - 1) / 2)) AS ina, sum(n / nb * (nb * (nb - 1) / 2)) AS inb, max(t * (t - 1) / 2) AS ev, count(DISTINCT a) AS ka FROM c GROUP BY 1),
p AS (SELECT *, bth / inb AS p, bth / ina AS r FROM s)
SELECT node, round(mi / sqrt(ha * hb), 6) AS nmi, round((bth - ina * inb / ev) / ((ina + inb) / 2 - ina * inb / ev), 6) AS ari, round(p, 6) AS pair_precision, round(r, 6) AS pair_recall, round(2 * p * r / (p + r), 6) AS pair_f1, ev::BIGINT AS n_pairs, ka > 1 AS is_variant FROM p""")
def partition_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), "l_returnflag", "l_linestatus")
    return rounded(labels.partition_scores(rows, ["node"], "l_returnflag", "l_linestatus"))


@query("""SELECT event_id, 1.0::DOUBLE AS at_label, 1.0::DOUBLE AS total, 7 AS k FROM events""")
def one_hot_posterior(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).cast("int").alias("label"))
    return labels.one_hot_posterior(rows, "label", 7).select("event_id", F.get("posterior", F.col("label")).alias("at_label"), F.aggregate("posterior", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("posterior").alias("k"))


@query(f"""WITH l AS {NODE_LABELS} SELECT l.label AS "group", count(*) AS n, round(avg(value), 4) AS mean FROM events e JOIN l ON l.context = e.event_id % 8 AND l.node = 3 GROUP BY 1""")
def pooled_contexts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select((F.col("event_id") % 8).cast("int").alias("context"), "value")
    pooled = labels.pool_contexts(rows, _node_labels(spark, sf_dir), 3)
    return pooled.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
