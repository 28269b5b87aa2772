"""Queries of the relational operators over the driver's tables, each with SQL that gives the same rows.

Contexts are category columns (return flag, market segment, order priority,
event type); numeric nodes are the lineitem measures; series are the users'
events in order of event_id; an order is a graph over its line numbers.
Floating-point results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shiftscope.operators import graphs, labels, moments, regimes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- moments and regression --------------------------------------------------


@query("""SELECT l_returnflag AS treatment, l_linestatus AS stratum, count(*) AS n, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS hits,
round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def simpson_rates(spark, sf_dir):
    return rounded(moments.simpson_rates(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_discount") > 0.05))


@query("""SELECT o_orderpriority AS context, c_mktsegment AS segment, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, round(var_pop(o_totalprice) / 1e6, 4) AS var_price,
round(covar_pop(o_totalprice, c_acctbal) / 1e6, 4) AS cov FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def context_moments(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = moments.context_moments(rows, ["o_orderpriority", "c_mktsegment"], ["o_totalprice", "c_acctbal"])
    return m.select(
        F.col("o_orderpriority").alias("context"), F.col("c_mktsegment").alias("segment"), "n", F.round("mean_o_totalprice", 4).alias("mean_price"),
        F.round(F.col("var_o_totalprice") / 1e6, 4).alias("var_price"), F.round(F.col("cov_o_totalprice_c_acctbal") / 1e6, 4).alias("cov"),
    )


@query("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def context_ols(spark, sf_dir):
    m = moments.simple_ols(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return m.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


BITS = "(n / 2.0 * log2(2 * pi() * exp(1.0) * (vy - cxy * cxy / vx)))"


@query(f"""SELECT l_returnflag, round({BITS}, 2) AS bits FROM (SELECT l_returnflag, count(*) AS n, var_pop(l_extendedprice) AS vy, var_pop(l_quantity) AS vx,
covar_pop(l_extendedprice, l_quantity) AS cxy FROM lineitem GROUP BY 1)""")
def ols_residual_bits(spark, sf_dir):
    m = moments.simple_ols(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return m.select("l_returnflag", F.round(moments.gaussian_bits(), 2).alias("bits"))


DELTA = f"""WITH s AS (SELECT l_shipmode AS c, count(*) AS n, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS cxy FROM d GROUP BY 1),
p AS (SELECT a.l_shipmode AS c1, b.l_shipmode AS c2, d.x, d.y FROM (SELECT DISTINCT l_shipmode FROM d) a JOIN (SELECT DISTINCT l_shipmode FROM d) b ON a.l_shipmode < b.l_shipmode JOIN d ON d.l_shipmode IN (a.l_shipmode, b.l_shipmode)),
q AS (SELECT c1, c2, count(*) AS n, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS cxy FROM p GROUP BY 1, 2),
delta AS (SELECT c1, c2, q_bits - a_bits - b_bits AS delta_bits FROM (SELECT c1, c2, {BITS} AS q_bits FROM q) JOIN (SELECT c AS c1, {BITS} AS a_bits FROM s) USING (c1) JOIN (SELECT c AS c2, {BITS} AS b_bits FROM s) USING (c2))"""
CONTEXTS = "d AS (SELECT (l_partkey % 6)::INT AS l_shipmode, l_quantity * (1 + (l_partkey % 6) // 2) AS y, l_quantity + l_linenumber AS x FROM lineitem)"


def _contexts(spark, sf_dir):
    c = (F.col("l_partkey") % 6).cast("int")
    return read(spark, sf_dir, "lineitem").select(c.alias("c"), (F.col("l_quantity") * (1 + F.floor(c / 2))).alias("y"), (F.col("l_quantity") + F.col("l_linenumber")).alias("x"))


@query(DELTA.replace("WITH s", f"WITH {CONTEXTS}, s") + " SELECT c1, c2, round(delta_bits, 2) AS delta_bits FROM delta")
def context_delta_bits(spark, sf_dir):
    return moments.context_delta_bits(_contexts(spark, sf_dir), "c", "y", "x").select("c1", "c2", F.round("delta_bits", 2).alias("delta_bits"))


@query(DELTA.replace("WITH s", f"WITH RECURSIVE {CONTEXTS}, s") + """, e AS (SELECT c1 AS a, c2 AS b FROM delta WHERE delta_bits <= 20 UNION SELECT c2, c1 FROM delta WHERE delta_bits <= 20),
r AS (SELECT DISTINCT l_shipmode AS node, l_shipmode AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def context_components(spark, sf_dir):
    rows = _contexts(spark, sf_dir)
    delta = moments.context_delta_bits(rows, "c", "y", "x").where("delta_bits <= 20")
    return graphs.components(delta.select(F.col("c1").alias("a"), F.col("c2").alias("b")), rows.select(F.col("c").alias("node")).distinct())


PARTIAL = "(corr(l_extendedprice, l_discount) - corr(l_extendedprice, l_quantity) * corr(l_discount, l_quantity)) / sqrt((1 - corr(l_extendedprice, l_quantity) ** 2) * (1 - corr(l_discount, l_quantity) ** 2))"


@query(f"SELECT l_returnflag, round({PARTIAL}, 6) AS r FROM lineitem GROUP BY 1")
def partial_corr(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(moments.partial_correlation("l_extendedprice", "l_discount", "l_quantity"), 6).alias("r"))


@query(f"SELECT l_returnflag, round(0.5 * ln((1 + r) / (1 - r)) * sqrt(n - 4), 4) AS z FROM (SELECT l_returnflag, count(*) AS n, {PARTIAL} AS r FROM lineitem GROUP BY 1)")
def fisher_z_stat(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), moments.partial_correlation("l_extendedprice", "l_discount", "l_quantity").alias("r"))
    return rows.select("l_returnflag", F.round(moments.fisher_z(F.col("r"), F.col("n"), 1), 4).alias("z"))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w, 6) AS l_quantity_z,
round((l_tax - avg(l_tax) OVER w) / stddev_pop(l_tax) OVER w, 6) AS l_tax_z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def zscore(spark, sf_dir):
    out = moments.zscore(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], ["l_returnflag"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity_z", "l_tax_z"))


@query("""SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal_u FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def minmax(spark, sf_dir):
    return rounded(moments.minmax(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", "c_acctbal_u"))


@query("""SELECT s.l_orderkey, s.l_linenumber FROM (SELECT *, abs(l_extendedprice - avg(l_extendedprice) OVER w) - 1.5 * stddev_pop(l_extendedprice) OVER w AS a,
abs(l_quantity - avg(l_quantity) OVER w) - 1.5 * stddev_pop(l_quantity) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_linestatus)) s WHERE a <= 0 AND b <= 0""")
def outlier_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice", "l_quantity")
    return moments.inlier_rows(rows, ["l_extendedprice", "l_quantity"], 1.5, ["l_linestatus"]).select("l_orderkey", "l_linenumber")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 4 = 1 THEN 1 ELSE 0 END AS is_1, CASE WHEN c_nationkey % 4 = 2 THEN 1 ELSE 0 END AS is_2, CASE WHEN c_nationkey % 4 = 3 THEN 1 ELSE 0 END AS is_3 FROM customer""")
def one_hot_context(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 4).alias("context"))
    return moments.one_hot(rows, "context", [0, 1, 2, 3]).drop("context")


@query("""WITH v AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag = 'A') AS b FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1)
SELECT round(max(abs(ra / ta - rb / tb)), 6) AS ks, max(ta)::BIGINT AS n0, max(tb)::BIGINT AS n1 FROM (SELECT sum(a) OVER (ORDER BY v) AS ra, sum(b) OVER (ORDER BY v) AS rb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM v)""")
def ks_two_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'A')").select("l_quantity", (F.col("l_returnflag") == "A").cast("int").alias("flag"))
    return rounded(moments.ks_statistic(rows, "l_quantity", "flag"))


# --- labels and partitions ---------------------------------------------------

LABELS = "(SELECT event_type AS a, (user_id % 7)::INT AS b, (event_id % 3)::INT AS c, user_id FROM events)"


def _labels(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("a"), (F.col("user_id") % 7).cast("int").alias("b"), (F.col("event_id") % 3).cast("int").alias("c"), "user_id", "event_id")


@query(f"SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {LABELS} GROUP BY a)")
def label_entropy(spark, sf_dir):
    return rounded(labels.entropy(_labels(spark, sf_dir), "a"))


@query(f"SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {LABELS} GROUP BY a, b, c)")
def joint_entropy(spark, sf_dir):
    return rounded(labels.entropy(_labels(spark, sf_dir), "a", "b", "c"))


@query(f"""WITH h AS (SELECT -sum(p * ln(p)) AS e FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {LABELS} GROUP BY a) UNION ALL SELECT -sum(p * ln(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {LABELS} GROUP BY b)
UNION ALL SELECT sum(p * ln(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {LABELS} GROUP BY a, b)) SELECT round(sum(e), 6) AS total_correlation FROM h""")
def total_correlation(spark, sf_dir):
    return rounded(labels.total_correlation(_labels(spark, sf_dir), ["a", "b"]))


CELLS = f"(SELECT a, b, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY a))::DOUBLE AS na, (sum(count(*)) OVER (PARTITION BY b))::DOUBLE AS nb, (sum(count(*)) OVER ())::DOUBLE AS t FROM {LABELS} GROUP BY a, b)"


@query(f"""SELECT round(mi, 6) AS mi, round(ha, 6) AS h_a, round(hb, 6) AS h_b, round(ha - mi, 6) AS h_a_given_b, round(hb - mi, 6) AS h_b_given_a FROM
(SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb FROM {CELLS})""")
def contingency_mi(spark, sf_dir):
    return rounded(labels.mutual_information(_labels(spark, sf_dir), "a", "b"))


@query(f"""SELECT round(mi / sqrt(ha * hb), 6) AS nmi, round(ha + hb - 2 * mi, 6) AS vi, round((bth - ina * inb / ev) / ((ina + inb) / 2 - ina * inb / ev), 6) AS ari, round(bth / inb, 6) AS pair_precision,
round(bth / ina, 6) AS pair_recall, round(2 * (bth / inb) * (bth / ina) / (bth / inb + bth / ina), 6) AS pair_f1 FROM (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi, sum(-n / t * ln(na / t)) AS ha, sum(-n / t * ln(nb / t)) AS hb,
sum(n * (n - 1) / 2) AS bth, sum(n / na * (na * (na - 1) / 2)) AS ina, sum(n / nb * (nb * (nb - 1) / 2)) AS inb, max(t * (t - 1) / 2) AS ev FROM {CELLS})""")
def label_agreement(spark, sf_dir):
    return rounded(labels.agreement(_labels(spark, sf_dir), "a", "b"))


@query(f"""SELECT round(sum(2 * n * ln(n * nz / (nx * ny))), 4) AS g2, (max(lx) - 1) * (max(ly) - 1) * max(lz) AS dof FROM (SELECT count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY a, c))::DOUBLE AS nx,
(sum(count(*)) OVER (PARTITION BY b, c))::DOUBLE AS ny, (sum(count(*)) OVER (PARTITION BY c))::DOUBLE AS nz FROM {LABELS} GROUP BY a, b, c), (SELECT count(DISTINCT a) AS lx, count(DISTINCT b) AS ly, count(DISTINCT c) AS lz FROM {LABELS})""")
def g2_stat(spark, sf_dir):
    return rounded(labels.g2(_labels(spark, sf_dir), "a", "b", ["c"]), 4)


@query(f"""WITH x AS (SELECT a, c, count(*) AS nx FROM {LABELS} GROUP BY 1, 2), y AS (SELECT b, c, count(*) AS ny FROM {LABELS} GROUP BY 1, 2), z AS (SELECT c, count(*) AS nz FROM {LABELS} GROUP BY 1), o AS (SELECT a, b, c, count(*) AS n FROM {LABELS} GROUP BY 1, 2, 3)
SELECT round(sum((coalesce(n, 0) - nx * ny / nz) ** 2 / (nx * ny / nz)), 4) AS statistic FROM x JOIN y USING (c) JOIN z USING (c) LEFT JOIN o USING (a, b, c)""")
def chi2_stat(spark, sf_dir):
    return rounded(labels.power_divergence(_labels(spark, sf_dir), "a", "b", ["c"]), 4)


@query(f"SELECT a, b, (dense_rank() OVER (ORDER BY a, b) - 1)::INT AS label, count(*) AS n FROM {LABELS} GROUP BY a, b")
def partition_product(spark, sf_dir):
    return labels.partition_product(_labels(spark, sf_dir), "a", "b", "label").groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT b, c, ((b + c) * (b + c + 1) // 2 + c)::BIGINT AS code, count(*) AS n FROM {LABELS} GROUP BY b, c")
def cantor_labels(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy("b", "c", labels.cantor(F.col("b"), F.col("c")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_type, (dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1)::INT AS first_seen, (dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1)::INT AS sorted
FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2)""")
def relabel_first_seen(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    rows = labels.relabel_first_seen(rows, "event_type", "event_id", "first_seen", ["user_id"])
    return labels.relabel_sorted(rows, "event_type", "sorted", ["user_id"]).select("user_id", "event_type", "first_seen", "sorted").distinct()


NODE_LABELS = "(SELECT (user_id % 12)::INT AS node, (event_id % 8)::INT AS context, (sum(CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END + (event_id % 5 = 0)::INT) % 3)::INT AS label FROM events GROUP BY 1, 2)"


def _node_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 12).cast("int").alias("node"), (F.col("event_id") % 8).cast("int").alias("context"), "event_type", "event_id")
    hits = F.when(F.col("event_type") == "purchase", 1).otherwise(0) + (F.col("event_id") % 5 == 0).cast("int")
    return rows.groupBy("node", "context").agg((F.sum(hits) % 3).cast("int").alias("label"))


@query(f"""WITH l AS {NODE_LABELS}, m AS (SELECT node, label AS mode FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, label) AS r FROM l GROUP BY 1, 2) WHERE r = 1)
SELECT node, context, label FROM l JOIN m USING (node) WHERE label <> mode""")
def intervention_targets(spark, sf_dir):
    return labels.intervention_targets(_node_labels(spark, sf_dir))


@query(f"""WITH l AS {NODE_LABELS} SELECT a.node, a.context AS c1, b.context AS c2, (a.label <> b.label)::INT AS shift FROM l a JOIN l b ON a.node = b.node AND a.context < b.context""")
def shift_pairs(spark, sf_dir):
    return labels.map_to_shifts(_node_labels(spark, sf_dir))


@query(f"""WITH l AS {NODE_LABELS}, s AS (SELECT a.node, a.context AS x, b.context AS y, ((a.label + b.label + a.context) % 2)::INT AS s FROM l a JOIN l b ON a.node = b.node AND a.context < b.context), w AS (SELECT * FROM s UNION ALL SELECT node, y, x, s FROM s),
bad AS (SELECT DISTINCT w1.node, least(w1.x, w2.y) AS x, greatest(w1.x, w2.y) AS y FROM w w1 JOIN w w2 ON w1.node = w2.node AND w1.y = w2.x AND w1.x <> w2.y JOIN w w3 ON w3.node = w1.node AND w3.x = w1.x AND w3.y = w2.y WHERE w1.s + w2.s + w3.s = 1)
SELECT s.node, s.x AS c1, s.y AS c2, greatest(s.s, CASE WHEN bad.x IS NULL THEN 0 ELSE 1 END)::INT AS shift FROM s LEFT JOIN bad USING (node, x, y)""")
def transitivity_repair(spark, sf_dir):
    l = _node_labels(spark, sf_dir)
    a, b = l.select("node", F.col("context").alias("c1"), F.col("label").alias("l1")), l.select("node", F.col("context").alias("c2"), F.col("label").alias("l2"))
    pairs = a.join(b, "node").where("c1 < c2").select("node", "c1", "c2", ((F.col("l1") + F.col("l2") + F.col("c1")) % 2).cast("int").alias("shift"))
    return labels.repair_transitivity(pairs)


@query("""WITH d AS (SELECT least(greatest(floor((l_quantity - 0) / 60 * 12), 0), 11) AS a, least(greatest(floor((l_quantity + l_linenumber * 2 - 0) / 60 * 12), 0), 11) AS b FROM lineitem),
k AS (SELECT count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY a))::DOUBLE AS na, (sum(count(*)) OVER (PARTITION BY b))::DOUBLE AS nb, (sum(count(*)) OVER ())::DOUBLE AS t FROM d GROUP BY a, b) SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) AS mi FROM k""")
def binned_mi(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") + F.col("l_linenumber") * 2).alias("y"))
    return rounded(labels.binned_mi(rows, "l_quantity", "y", 0.0, 60.0, 12))


# --- time series -------------------------------------------------------------


def _series(spark, sf_dir):
    """The users' events numbered from 0."""
    t = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return read(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type", t.alias("t"))


SERIES = "s AS (SELECT user_id, event_id, value, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS t FROM events)"


@query("""SELECT * FROM (SELECT event_id, round(value, 4) AS value, round(lag(value, 1) OVER w, 4) AS value_lag1, round(lag(value, 3) OVER w, 4) AS value_lag3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE value_lag3 IS NOT NULL""")
def lag_features(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return rounded(regimes.lag_features(rows, ["user_id"], "event_id", {"value": [1, 3]}).drop("user_id"), 4)


CUTS = "k AS (SELECT user_id, t AS cut FROM s WHERE t % 17 = 0)"


@query(f"""WITH {SERIES}, {CUTS}, n AS (SELECT user_id, cut AS a, lead(cut) OVER w AS b, lead(cut, 2) OVER w AS c FROM k WINDOW w AS (PARTITION BY user_id ORDER BY cut)) SELECT user_id, (a + 2)::INT AS t0, (CASE WHEN c IS NULL THEN b ELSE b - 1 END)::INT AS tn FROM n WHERE b IS NOT NULL""")
def windows_from_cuts(spark, sf_dir):
    cuts = _series(spark, sf_dir).where("t % 17 = 0").select("user_id", F.col("t").alias("cut"))
    return regimes.cuts_to_windows(cuts, 2, ["user_id"])


@query(f"""WITH {SERIES}, p AS (SELECT DISTINCT user_id, (t // 10 * 10)::INT AS b FROM s), n AS (SELECT user_id, (b + 2)::INT AS t0, (b + 10)::INT AS tn FROM p) SELECT user_id, (t0 - 2)::INT AS begin, coalesce(lead(t0) OVER (PARTITION BY user_id ORDER BY t0) - t0, tn - t0 + 2)::INT AS duration FROM n""")
def partition_from_windows(spark, sf_dir):
    begin = _series(spark, sf_dir).select("user_id", (F.floor(F.col("t") / 10) * 10).cast("int").alias("begin")).distinct()
    windows = regimes.partition_to_windows(begin.withColumn("duration", F.lit(10)), 2).select("user_id", "t0", "tn")
    return regimes.windows_to_partition(windows, 2, ["user_id"])


@query(f"""WITH {SERIES}, w AS (SELECT DISTINCT user_id, (t // 20 * 20 + 3)::INT AS t0, (t // 20 * 20 + 20)::INT AS tn, ((t // 20) % 2)::INT AS regime FROM s) SELECT user_id, regime, count(*) AS n, round(avg(value), 4) AS mean FROM s JOIN w USING (user_id) WHERE t >= t0 AND t < tn GROUP BY 1, 2""")
def regime_rows(spark, sf_dir):
    rows = _series(spark, sf_dir)
    block = F.floor(F.col("t") / 20)
    parts = rows.select("user_id", (block * 20).alias("begin"), (block % 2).cast("int").alias("regime")).distinct().withColumn("duration", F.lit(20))
    windows = regimes.partition_to_windows(parts, 3).select("user_id", "t0", "tn", "regime")
    return regimes.rows_in_windows(rows, windows, ["user_id"], "t").groupBy("user_id", "regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("""SELECT user_id, event_type, min(event_id) AS "begin", max(event_id) AS "end", count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM
(SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, event_type, run""")
def regime_islands(spark, sf_dir):
    return regimes.islands(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(f"""WITH {SERIES}, x AS (SELECT user_id, t AS cp FROM s WHERE event_type = 'purchase'), f AS (SELECT user_id, t AS cp FROM s WHERE t % 9 = 4), m AS (SELECT x.user_id, x.cp, min(abs(x.cp - f.cp)) AS d FROM x LEFT JOIN f USING (user_id) GROUP BY 1, 2),
h AS (SELECT user_id, count(*) AS n_true, sum(CASE WHEN d <= 2 THEN 1 ELSE 0 END) AS hits, avg(CASE WHEN d <= 2 THEN d END) AS distance FROM m GROUP BY 1), c AS (SELECT user_id, count(*) AS n_found FROM f GROUP BY 1)
SELECT user_id, coalesce(n_true, 0)::BIGINT AS n_true, coalesce(n_found, 0)::BIGINT AS n_found, round(CASE WHEN coalesce(n_true, 0) = 0 THEN (CASE WHEN coalesce(n_found, 0) = 0 THEN 1.0 ELSE 0.0 END) ELSE coalesce(hits / nullif(coalesce(n_found, 0), 0), 0.0) END, 6) AS "precision",
round(CASE WHEN coalesce(n_true, 0) = 0 THEN (CASE WHEN coalesce(n_found, 0) = 0 THEN 1.0 ELSE 0.0 END) ELSE hits / n_true END, 6) AS recall, round(distance, 6) AS distance FROM h FULL JOIN c USING (user_id)""")
def cp_precision_recall(spark, sf_dir):
    rows = _series(spark, sf_dir)
    true, found = rows.where("event_type = 'purchase'").select("user_id", F.col("t").alias("cp")), rows.where("t % 9 = 4").select("user_id", F.col("t").alias("cp"))
    return rounded(regimes.changepoint_scores(true, found, ["user_id"], 2))


@query(f"""WITH {SERIES} SELECT t, round(sum(0.5 * ln(2 * pi()) + (r * r) / 2), 4) AS nll, count(*) AS n FROM (SELECT t, (value - avg(value) OVER (PARTITION BY event_type)) / 50 AS r FROM s) GROUP BY t""")
def nll_series(spark, sf_dir):
    rows = _series(spark, sf_dir)
    means = rows.groupBy("event_type").agg(F.avg("value").alias("m"))
    rows = rows.join(F.broadcast(means), "event_type").select("t", ((F.col("value") - F.col("m")) / 50).alias("r"))
    return rows.groupBy("t").agg(F.round(F.sum(regimes.unit_nll(F.col("r"))), 4).alias("nll"), F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, round(m, 4) AS moving_avg FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""")
def moving_avg(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return rounded(regimes.moving_average(rows, ["user_id"], "event_id", "value", 5).select("event_id", "moving_avg"), 4)


@query("""SELECT o_custkey, arg_min(y, abs(y - 2) * 10 + y)::INT AS nearest FROM (SELECT o_custkey, (o_orderkey % 7)::INT AS y FROM orders) GROUP BY 1""")
def nearest_year(spark, sf_dir):
    return regimes.nearest(read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 7).cast("int").alias("y")), ["o_custkey"], "y", 2)


@query(f"""WITH {SERIES}, b AS (SELECT DISTINCT user_id FROM (SELECT user_id, t // 30 AS k, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS n FROM s GROUP BY 1, 2) WHERE n > 8) SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM b)""")
def missing_gate(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, -9999.0).otherwise(F.col("value")).alias("value"))
    return regimes.block_gate(rows, ["user_id"], "event_id", "value")


@query("""SELECT event_type, count(*) AS n, round(sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END), 2) AS total FROM events GROUP BY 1""")
def sentinel_to_zero(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 == 0, -9999.0).otherwise(F.col("value"))
    rows = read(spark, sf_dir, "events").withColumn("value", value).withColumn("value", F.when(F.col("value") < -9000, 0.0).otherwise(F.col("value")))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


# --- scores, cases, graphs ---------------------------------------------------


@query("""SELECT l_suppkey AS target, arg_max(l_partkey, l_extendedprice * 1000000 - l_partkey) AS parent, max(l_extendedprice) AS gain FROM lineitem GROUP BY 1""")
def best_candidate(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("target")).agg(F.max_by("l_partkey", F.col("l_extendedprice") * 1000000 - F.col("l_partkey")).alias("parent"), F.max("l_extendedprice").alias("gain"))


@query("""SELECT target, parent, gain FROM (SELECT l_suppkey AS target, l_partkey AS parent, sum(l_quantity) AS gain, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 3""")
def topk_gain(spark, sf_dir):
    gains = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("parent")).agg(F.sum("l_quantity").alias("gain"))
    best = F.row_number().over(W.partitionBy("target").orderBy(F.desc("gain"), "parent"))
    return gains.withColumn("r", best).where("r <= 3").drop("r")


@query("""SELECT c_mktsegment AS method, o_orderpriority AS attribute, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(var_samp(x) / 1e6, 4) AS var, round(stddev_samp(x), 4) AS std, round(sum(x * w) / sum(w), 4) AS weighted
FROM (SELECT c_mktsegment, o_orderpriority, o_totalprice AS x, (o_orderkey % 5)::DOUBLE AS w FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2""")
def case_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x, w = F.col("o_totalprice"), (F.col("o_orderkey") % 5).cast("double")
    return rounded(rows.groupBy(F.col("c_mktsegment").alias("method"), F.col("o_orderpriority").alias("attribute")).agg(
        F.avg(x).alias("mean"), F.median(x).alias("median"), (F.var_samp(x) / 1e6).alias("var"), F.stddev_samp(x).alias("std"), (F.sum(x * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("weighted")
    ), 4)


# every order is a graph over its line numbers; all line items take part
PAIR = "SELECT DISTINCT a.l_orderkey AS graph, a.l_linenumber AS src, b.l_linenumber AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey"
EDGES = f"g AS ({PAIR} AND a.l_linenumber < b.l_linenumber AND abs(a.l_quantity - b.l_quantity) <= 12)"
OTHER = f"h AS ({PAIR} AND a.l_linenumber <> b.l_linenumber AND b.l_quantity > a.l_quantity AND b.l_quantity - a.l_quantity <= 15)"
GRAPHS = "(SELECT DISTINCT l_orderkey AS graph FROM lineitem)"
NODES = 7


#: line items that a task holds when orders are dealt out, and the least number of tasks
PART_ROWS, LEAST_PARTS = 300_000, 16


def order_lines(spark, sf_dir, *columns):
    """Columns of the line items with their order as ``graph``, dealt by it.

    The number of parts grows with the table, so a part does not; what is joined or
    grouped by keys with the graph among them can stay in its part.
    """
    rows = read(spark, sf_dir, "lineitem")
    parts = max(LEAST_PARTS, -(-rows.count() // PART_ROWS))
    return rows.select(F.col("l_orderkey").alias("graph"), *columns).repartition(parts, "graph")


def _edges(spark, sf_dir, other: bool = False):
    rows = order_lines(spark, sf_dir, "l_linenumber", "l_quantity")
    a, b = (rows.select("graph", F.col("l_linenumber").alias(n), F.col("l_quantity").alias(f"q_{n}")) for n in ("src", "dst"))
    near = "src <> dst and q_dst > q_src and q_dst - q_src <= 15" if other else "src < dst and abs(q_src - q_dst) <= 12"
    return a.join(b, "graph").where(near).select("graph", "src", "dst").distinct()


def _nodes(spark, sf_dir):
    return order_lines(spark, sf_dir).select("graph", F.lit(NODES).alias("n_nodes")).distinct()


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT graph, dst AS node, src AS ancestor FROM g UNION SELECT r.graph, r.node, g.src FROM r JOIN g ON g.graph = r.graph AND g.dst = r.ancestor) SELECT graph, node, ancestor FROM r")
def ancestors(spark, sf_dir):
    return graphs.ancestors(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT graph, src AS node, 0 AS level FROM g UNION SELECT graph, dst, 0 FROM g UNION SELECT r.graph, g.dst, r.level + 1 FROM r JOIN g ON g.graph = r.graph AND g.src = r.node) SELECT graph, node, max(level)::INT AS level FROM r GROUP BY 1, 2")
def topological_levels(spark, sf_dir):
    return graphs.levels(_edges(spark, sf_dir))


@query(f"""WITH {EDGES} SELECT DISTINCT a.graph, a.src AS "left", a.dst AS mid, b.src AS "right" FROM g a JOIN g b ON a.graph = b.graph AND a.dst = b.dst AND a.src < b.src WHERE NOT EXISTS (SELECT 1 FROM g e WHERE e.graph = a.graph AND ((e.src = a.src AND e.dst = b.src) OR (e.src = b.src AND e.dst = a.src)))""")
def v_structures(spark, sf_dir):
    return graphs.v_structures(_edges(spark, sf_dir))


@query(f"WITH {OTHER} SELECT DISTINCT graph, least(src, dst) AS a, greatest(src, dst) AS b FROM h")
def skeleton(spark, sf_dir):
    return graphs.skeleton(_edges(spark, sf_dir, True))


@query(f"""WITH {EDGES} SELECT DISTINCT * FROM (SELECT graph, dst AS node, src AS member FROM g UNION SELECT graph, src, dst FROM g UNION SELECT a.graph, a.src, b.src FROM g a JOIN g b ON a.graph = b.graph AND a.dst = b.dst) WHERE node <> member""")
def markov_blankets(spark, sf_dir):
    return graphs.markov_blankets(_edges(spark, sf_dir))


@query(f"""WITH {EDGES}, {OTHER}, o AS (SELECT graph, src, dst, 0 AS side FROM (FROM g EXCEPT FROM h) UNION ALL SELECT graph, src, dst, 1 FROM (FROM h EXCEPT FROM g)), p AS (SELECT graph, least(src, dst) AS p, greatest(src, dst) AS q, count(*) AS n FROM o GROUP BY 1, 2, 3)
SELECT graph, coalesce(sum(n), 0)::BIGINT AS shd, count(n) AS shd_single, round(coalesce(sum(n), 0) / 21.0, 6) AS shd_share FROM {GRAPHS} LEFT JOIN p USING (graph) GROUP BY 1""")
def shd(spark, sf_dir):
    return rounded(graphs.shd(_edges(spark, sf_dir), _edges(spark, sf_dir, True), _nodes(spark, sf_dir)))


@query(f"""WITH {EDGES}, {OTHER}, f AS (SELECT graph, coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM (SELECT *, 1 AS t FROM g) FULL JOIN (SELECT *, 1 AS f FROM h) USING (graph, src, dst)),
c AS (SELECT graph, coalesce(sum(t * f), 0)::BIGINT AS tp, coalesce(sum(f * (1 - t)), 0)::BIGINT AS fp, coalesce(sum(t * (1 - f)), 0)::BIGINT AS fn FROM {GRAPHS} LEFT JOIN f USING (graph) GROUP BY 1), d AS (SELECT *, 42 - tp - fp - fn AS tn FROM c)
SELECT graph, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fn, 0), 1), 6) AS tpr, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS "precision", round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 1), 6) AS f1,
round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 1), 6) AS mcc FROM d""")
def edge_confusion(spark, sf_dir):
    return rounded(graphs.edge_confusion(_edges(spark, sf_dir), _edges(spark, sf_dir, True), _nodes(spark, sf_dir)))


@query(f"WITH {OTHER} SELECT graph, count(*) FILTER (WHERE src > dst) AS backward, round(avg(CASE WHEN src < dst THEN 1.0 ELSE 0.0 END), 6) AS forward_share FROM h GROUP BY 1")
def order_divergence(spark, sf_dir):
    order = _nodes(spark, sf_dir).select("graph", F.explode(F.sequence(F.lit(1), F.lit(NODES))).alias("node")).withColumn("rank", F.col("node"))
    return rounded(graphs.order_scores(_edges(spark, sf_dir, True), order))


@query("""WITH n AS (SELECT n_regionkey AS graph, n_nationkey AS node, n_nationkey AS ra, (n_nationkey * 7) % 25 AS rb FROM nation) SELECT a.graph, round(avg(sign(a.ra - b.ra) * sign(a.rb - b.rb)), 6) AS tau FROM n a JOIN n b ON a.graph = b.graph AND a.node < b.node GROUP BY 1""")
def kendall_orders(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("node"))
    return rounded(graphs.kendall(rows.withColumn("rank", F.col("node")), rows.withColumn("rank", F.col("node") * 7 % 25)))


@query("""WITH c AS (SELECT p_size AS s, count(*) AS n, sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS p FROM part GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM c)
SELECT round((sum(rk * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))), 6) AS auroc FROM r""")
def ranking_auroc(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_size", F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0).alias("hit"))
    return rounded(graphs.rank_scores(rows, "p_size", "hit", 10).select("auroc"))


@query("""SELECT avg(j) AS jaccard, count(*) AS n FROM (SELECT node, round(count(*) FILTER (WHERE x AND y) / count(*) FILTER (WHERE x OR y), 6) AS j FROM (SELECT (user_id % 12)::INT AS node, (event_id % 8)::INT AS context, bool_or(event_type = 'purchase') AS x, bool_or(value > 90) AS y FROM events GROUP BY 1, 2) GROUP BY node)""".replace("avg(j)", "round(avg(j), 5)"))
def target_jaccard(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).cast("int").alias("node"), (F.col("event_id") % 8).cast("int").alias("context"))
    rows = rows.agg(F.bool_or(F.col("event_type") == "purchase").alias("x"), F.bool_or(F.col("value") > 90).alias("y"))
    per = rows.groupBy("node").agg(F.round(F.count_if(F.col("x") & F.col("y")) / F.count_if(F.col("x") | F.col("y")), 6).alias("j"))
    return per.agg(F.round(F.avg("j"), 5).alias("jaccard"), F.count(F.lit(1)).alias("n"))


