"""Queries of the model-based operators over the driver's tables; the iterative ones have no SQL equivalent.

Discovery runs on columns with known structure: quantity, a multiple of it with
the line number as noise, that again with the tax as noise, and the discount.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from shiftscope.functions import independence as ci, scores
from shiftscope.functions.changepoints import pelt
from shiftscope.operators import em, kernel_tests, neighbours, row_tests, scoring
from shiftscope.plans import confounding, constraint, mechanism_shifts, mixtures, ordering, window_tests
from shiftscope.plans.hybrid import HybridLagged
from shiftscope.plans.lagged import LaggedRegimes
from shiftscope.plans.topological import Topological

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CHAIN = ["q", "w", "v", "l_discount"]
ORACLE_SQL: dict[str, str] = {}


def sql(text: str):
    def register(f):
        ORACLE_SQL[f.__name__] = text
        return f

    return register


def _lineitem(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", *COLS)


def _chain(spark, sf_dir: str) -> DataFrame:
    """Columns with structure: q -> w -> v, and the discount apart."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = 2 * F.col("l_quantity") + 5 * F.col("l_linenumber")
    return rows.select("l_returnflag", F.col("l_quantity").alias("q"), w.alias("w"), (w + 300 * F.col("l_tax")).alias("v"), "l_discount", F.col("l_linenumber").cast("double").alias("line"))


def _hours(spark, sf_dir: str) -> DataFrame:
    """Hourly sums of the values of three event types, by group of users: every event counts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    kind = F.when(F.col("event_type").isin("view", "click"), "browse").when(F.col("event_type") == "purchase", "buy").otherwise("other")
    rows = events.select((F.col("user_id") % 2).cast("int").alias("context"), hour.alias("t"), kind.alias("kind"), "value")
    return rows.groupBy("context", "t").pivot("kind", ["browse", "buy", "other"]).agg(F.sum("value")).fillna(0.0)


def _planted_hours(spark, sf_dir: str) -> DataFrame:
    """Series with structure made of the hourly sums: y follows x with a sign that turns at hour 216, z follows y with one that turns at hour 432."""
    order = W.partitionBy("context").orderBy("t")
    hours = _hours(spark, sf_dir).select("context", "t", F.col("browse").alias("x"), "buy", "other")
    hours = hours.withColumn("y", F.when(F.col("t") < 216, 2.0).otherwise(-2.0) * F.coalesce(F.lag("x").over(order), F.lit(0.0)) + F.col("buy"))
    return hours.select("context", "t", "x", "y", (F.when(F.col("t") < 432, 1.5).otherwise(-1.5) * F.coalesce(F.lag("y").over(order), F.lit(0.0)) + F.col("other")).alias("z"))


@sql("""WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx FROM lineitem), r AS (SELECT l_returnflag, (l_quantity - mx) / sx AS z, l_extendedprice AS y FROM lineitem, s),
g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(z) AS sz, sum(z * z) AS szz, sum(y) AS sy, sum(z * y) AS szy, sum(y * y) AS syy FROM r GROUP BY 1),
w AS (SELECT *, (n * szy - sz * sy) / (n * (szz + 0.001 * n) - sz * sz) AS b FROM g), v AS (SELECT *, (sy - b * sz) / n AS a FROM w),
e AS (SELECT l_returnflag, n, syy - 2 * (a * sy + b * szy) + a * a * n + 2 * a * b * sz + b * b * szz AS rss FROM v)
SELECT l_returnflag, n::BIGINT AS n, round(n / 2 * log2(2 * pi() * exp(1.0) * rss / n) + 1.5 * log2(n), 3) AS bits FROM e""")
def linear_bits(spark, sf_dir):
    """Mergeable score of price given quantity per return flag, with a linear basis."""
    df = _lineitem(spark, sf_dir)
    stats = scoring.column_stats(df, COLS)
    table = scoring.grams(df, COLS, ["l_returnflag"], [(1, (0,))], scores.Basis("lin", *stats))[1, (0,)]
    return spark.createDataFrame([(k[0], int(g[0, 0]), round(float(scores.gram_bits(g)), 3)) for k, g in table.items()], "l_returnflag string, n long, bits double")


@sql("""WITH d AS (SELECT l_returnflag, l_quantity AS a, l_quantity + 5 * l_linenumber AS b, l_linenumber::DOUBLE AS c FROM lineitem), m AS (SELECT l_returnflag AS graph, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM d GROUP BY 1),
p AS (SELECT graph, n, 'q' AS x, 's' AS y, 'line' AS w, ab AS r, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) AS t FROM m UNION ALL SELECT graph, n, 'q', 'line', 's', ac, (ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)) FROM m
UNION ALL SELECT graph, n, 's', 'line', 'q', bc, (bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)) FROM m),
z AS (SELECT *, abs(0.5 * ln((1 + r) / (1 - r))) * sqrt(n - 3) < 1.959963984540054 AS free, abs(0.5 * ln((1 + t) / (1 - t))) * sqrt(n - 4) < 1.959963984540054 AS given FROM p),
k AS (SELECT z.*, EXISTS (SELECT 1 FROM z o WHERE o.graph = z.graph AND NOT o.free AND z.w IN (o.x, o.y) AND (z.x IN (o.x, o.y) OR z.y IN (o.x, o.y))) AS near FROM z),
e AS (SELECT *, NOT free AND NOT (given AND near) AS edge, NOT free AND given AND near AS through FROM k),
c AS (SELECT graph, w AS mid FROM e h WHERE NOT edge AND NOT through AND (SELECT count(*) FROM e o WHERE o.graph = h.graph AND o.edge) = 2)
SELECT e.graph, CASE WHEN mid = x THEN y ELSE x END AS src, CASE WHEN mid = x THEN x ELSE y END AS dst, CASE WHEN mid IS NULL THEN 'undirected' ELSE 'directed' END AS kind FROM e LEFT JOIN c ON c.graph = e.graph WHERE edge""")
def pc_by_flag(spark, sf_dir):
    """PC graphs of a collider per return flag: quantity and line number make up their sum."""
    rows = _chain(spark, sf_dir).select("l_returnflag", "q", (F.col("q") + 5 * F.col("line")).alias("s"), "line")
    return constraint.discover_by(rows, ["q", "s", "line"], "l_returnflag")


def gp_bits(spark, sf_dir):
    """Exact kernel score of price given quantity per return flag, over all rows: they meet in few quantities."""
    rows = _lineitem(spark, sf_dir).dropna(subset=["l_quantity", "l_extendedprice"]).groupBy("l_returnflag", "l_quantity")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"), F.var_pop("l_extendedprice").alias("var"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("l_quantity")
        x, n, mean, var = (part[c].to_numpy(dtype=float) for c in ("l_quantity", "n", "mean", "var"))
        centre = n @ mean / n.sum()
        bits = scores.gp_bits_repeated(x[:, None], n, mean, n * var)
        null = scores.null_bits_of(int(n.sum()), float(n @ (var + (mean - centre) ** 2) / n.sum()))
        return pd.DataFrame({"l_returnflag": [key[0]], "n": [int(n.sum())], "bits": [bits], "null_bits": [null]})

    return rows.groupBy("l_returnflag").applyInPandas(run, "l_returnflag string, n long, bits double, null_bits double")


def spline_bits(spark, sf_dir):
    """Mergeable scores of all rows: bits per basis and return flag."""
    df = _lineitem(spark, sf_dir)
    stats, out = scoring.column_stats(df, COLS), []
    for kind in ("lin", "cub", "spline", "rff"):
        table = scoring.grams(df, COLS, ["l_returnflag"], [(1, (0,)), (1, (0, 2, 3))], scores.Basis(kind, *stats))
        out += [(kind, flag[0], len(ps), float(scores.gram_bits(g))) for (_, ps), groups in table.items() for flag, g in groups.items()]
    return spark.createDataFrame(out, "basis string, l_returnflag string, parents int, bits double")


def independence_tests(spark, sf_dir):
    """p values of several tests of discount and tax given quantity per return flag.

    All tests see all rows but ``cmi``, whose permutations of nearest neighbours see a
    sample.  Two-sample tests compare every other row in the order of the measures.
    """
    flag, x, y, z = "l_returnflag", "l_discount", "l_tax", "l_quantity"
    rows = row_tests.ranked(_lineitem(spark, sf_dir).drop("l_shipdate").dropna(subset=COLS), flag, COLS).withColumn("half", F.col("rank") % 2).persist()

    def permuted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        stat, p = ci.cmi_permutation(*(part.sort_values("rank")[[n]].to_numpy() for n in (x, y, z)))
        return pd.DataFrame([(key[0], "cmi", float(stat), float(p))], columns=[flag, "test", "stat", "p"])

    schema = "l_returnflag string, test string, stat double, p double"
    some = scoring.sampled(rows, [flag], ci.MOST)
    out = [tuple(r) for r in some.groupBy(flag).applyInPandas(permuted, schema).collect()]
    tests = {
        "kci": kernel_tests.kci(rows, flag, [x], [y], [z]),
        "mmd": kernel_tests.mmd(rows, flag, [y], "half"),
        "kcd": kernel_tests.kcd(rows, flag, [z], [y], "half"),
        "residuals": row_tests.residual_test(rows, flag, z, y, "half"),
        "classifier": row_tests.classifier(rows, flag, x, y, z),
    }
    for g, found in row_tests.regression_tests(rows, flag, x, y, z, "half").items():
        for name, result in found.items():
            tests.setdefault(name, {})[g] = result
    rows.unpersist()
    out += [(g, t, float(s), float(p)) for t, found in tests.items() for g, (s, p) in found.items()]
    return spark.createDataFrame(sorted(out), schema)


def neighbour_information(spark, sf_dir):
    """Nearest-neighbour information, over all line items of a return flag, of discount and tax given the quantity, and of quantity and tax."""
    rows = _lineitem(spark, sf_dir)
    pairs = {"discount, tax | quantity": (["l_discount"], ["l_tax"], ["l_quantity"]), "quantity, tax": (["l_quantity"], ["l_tax"], [])}
    out = [(name, *r) for name, cols in pairs.items() for r in neighbours.information(rows, "l_returnflag", *cols).collect()]
    return spark.createDataFrame(sorted(out), "pair string, l_returnflag string, n long, nats double")


def pelt_changepoints(spark, sf_dir):
    """Changepoints of every user's daily mean value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("day")
        return pd.DataFrame({"user_id": key[0], "cut": pelt(part["value"].to_numpy(), 5)})

    return rows.groupBy("user_id").applyInPandas(run, "user_id long, cut long")


def topological_contexts(spark, sf_dir):
    """Graph over a chain of curved mechanisms, one of which turns with a return flag, by process scores of all line items."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = F.when(F.col("l_returnflag") == "R", -20.0).otherwise(20.0) * F.sin(F.col("l_quantity") / 8) + 3 * F.col("l_linenumber")
    rows = rows.select("l_returnflag", F.col("l_quantity").alias("q"), w.alias("w"), (w * w / 40 + 200 * F.col("l_tax")).alias("v"))
    return Topological(["q", "w", "v"], "l_returnflag", "gp").fit(rows).edges(spark)


def topological_changes(spark, sf_dir):
    """Which return flags share each lineitem measure's mechanism."""
    return Topological(COLS, "l_returnflag", "lin").fit(_lineitem(spark, sf_dir)).changes(spark)


LINKS = {"browse": [("browse", 1)], "buy": [("browse", 0), ("buy", 1)], "other": [("other", 1)]}
PLANTED = {"x": [("x", 1)], "y": [("x", 1)], "z": [("y", 1)]}


def lagged_regime_edges(spark, sf_dir):
    """Lagged graph of the planted series, with regimes of three days at least."""
    return LaggedRegimes(["x", "y", "z"], max_lag=1, min_duration=72).fit(_planted_hours(spark, sf_dir)).edges(spark)


def own_segments(spark, sf_dir):
    """Segments of each mechanism of the planted series, found with the graph: every child has cuts of its own."""
    return HybridLagged(["x", "y", "z"], max_lag=2, grain=36, min_duration=72).fit(_planted_hours(spark, sf_dir)).segments(spark)


def _length(series: DataFrame) -> int:
    """Steps of the longest series."""
    return int(series.agg(F.max("t")).first()[0]) + 1


def window_strengths(spark, sf_dir):
    """Strength of each link between the hourly sums, by group of users and week."""
    hours = _hours(spark, sf_dir)
    return window_tests.link_strengths(hours, "context", "t", LINKS, window_tests.fixed_windows(_length(hours), 168, 1))


def window_regimes(spark, sf_dir):
    """Weeks of one regime by description length."""
    hours = _hours(spark, sf_dir)
    found = window_tests.known_windows(hours, "context", "t", LINKS, window_tests.fixed_windows(_length(hours), 168, 1), 1)
    return spark.createDataFrame(found, "begin int, duration int, regime int")


def cut_search(spark, sf_dir):
    """Cuts of the planted series on a grid of three days, as long as they save bits."""
    cuts, bits = window_tests.greedy_cuts(_planted_hours(spark, sf_dir), "context", "t", PLANTED, 72)
    return spark.createDataFrame([(int(c), float(bits)) for c in cuts], "cut int, bits double")


def confounder_pairs(spark, sf_dir):
    """Pairs of mechanisms that change between the same line numbers: those of a and b do, that of c changes elsewhere."""

    def by_line(slopes: dict[int, float], rest: float):
        return F.coalesce(*(F.when(F.col("l_linenumber") == k, s) for k, s in slopes.items()), F.lit(rest))

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_linenumber",
        F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("d"),
        (by_line({2: 3.0, 5: -2.0}, 1.0) * F.col("l_quantity") + 100 * F.col("l_tax")).alias("a"),
        (by_line({2: -300.0, 5: 500.0}, 100.0) * F.col("l_discount") + 10 * F.col("l_tax")).alias("b"),
        (by_line({3: 2.0, 6: 3.0, 7: -1.0}, 0.5) * F.col("l_quantity") + 300 * F.col("l_discount")).alias("c"),
    )
    return confounding.confounders(rows, "l_linenumber", {"a": ["q"], "b": ["d"], "c": ["q"]})


def mixture_labels(spark, sf_dir):
    """Hidden populations of the retail price given the part's place in its hundred, by size."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 100).cast("double").alias("place"))
    found = mixtures.node_mixtures(parts, "p_partkey", {"p_retailprice": ["place"]}, block="p_size", k_max=2)
    return found.groupBy("block", "node", "label").agg(F.count(F.lit(1)).alias("n"))


@sql("""WITH r AS (SELECT l_returnflag AS f, l_quantity AS q, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN -2 ELSE 0.5 END * l_quantity + 3 * l_tax AS y FROM lineitem)
SELECT count(*) AS n, round(regr_slope(y, q), 3) AS slope, round(regr_intercept(y, q), 3) AS intercept FROM r GROUP BY f""")
def hidden_slopes(spark, sf_dir):
    """Populations with slopes of their own, found without their flag: a mixture of regressions over all line items."""
    slope = F.when(F.col("l_returnflag") == "A", 3.0).when(F.col("l_returnflag") == "N", -2.0).otherwise(0.5)
    rows = _lineitem(spark, sf_dir).select(F.col("l_quantity").alias("q"), (slope * F.col("l_quantity") + 3 * F.col("l_tax")).alias("y"))
    models = em.fit(rows, "y", ["q"], "lin", k_max=4)
    model = em.assigned(rows, "y", ["q"], models[0]) if models else None
    found = [(int(round(share * model.n)), round(b, 3), round(a, 3)) for share, (a, b) in zip(model.shares.tolist(), model.lines(), strict=True)] if model else []
    return spark.createDataFrame(found, "n long, slope double, intercept double")


def minimal_shifts(spark, sf_dir):
    """Mechanism changes between return flags that each graph of the chain's class needs."""
    from shiftscope.functions.mixed_graph import MixedGraph

    model = mechanism_shifts.MinimalShifts(MixedGraph(3, {(0, 1), (1, 2)}).cpdag()).fit(_chain(spark, sf_dir), CHAIN[:3], "l_returnflag")
    rows = [(" ".join(f"{CHAIN[a]}>{CHAIN[b]}" for a, b in sorted(g.directed)), float(h), float(s)) for g, h, s in zip(model.dags, model.scores(), model.scores(True), strict=True)]
    return spark.createDataFrame(rows, "dag string, changes double, soft double")


def flag_shifts(spark, sf_dir):
    """p values of each mechanism of the chain being the same in each pair of return flags."""
    return mechanism_shifts.pair_p_values(_chain(spark, sf_dir), CHAIN[:3], "l_returnflag", [(0, ()), (1, (0,)), (2, (1,))], "params")


def setting_marks(spark, sf_dir):
    """Marks of the ancestral graph over the measures, return flags as settings."""
    marks = constraint.psi_fci(4, *constraint.setting_tests(_chain(spark, sf_dir), CHAIN, "l_returnflag"))
    return spark.createDataFrame([(int(a), int(b), int(m)) for (a, b), m in sorted(marks.items())], "a int, b int, mark int")


def missing_value_graph(spark, sf_dir):
    """PC graph where values are missing depending on another column."""
    rows = _chain(spark, sf_dir).withColumn("v", F.when(F.col("q") > 40, None).otherwise(F.col("v")))
    return constraint.edge_table(spark, constraint.missing_value_pc(rows, CHAIN), CHAIN)


def pc_graph(spark, sf_dir):
    return constraint.edge_table(spark, constraint.discover(_chain(spark, sf_dir), CHAIN), CHAIN)


def joint_context_graph(spark, sf_dir):
    graph, names = constraint.joint(_chain(spark, sf_dir), CHAIN, "l_returnflag")
    return constraint.edge_table(spark, graph, names)


def cam_edges(spark, sf_dir):
    found = ordering.discover(_chain(spark, sf_dir), CHAIN, "cam")
    return spark.createDataFrame([(CHAIN[a], CHAIN[b]) for a, b in sorted(found)], "src string, dst string")


def sort_regress_edges(spark, sf_dir):
    df = _chain(spark, sf_dir)
    corr, n = scoring.correlation(df, CHAIN)
    _, scale = scoring.column_stats(df, CHAIN)
    rows = [(name, CHAIN[a], CHAIN[b]) for name, s in (("variance", scale**2), ("r2", constraint.r2_scores(corr))) for a, b in sorted(constraint.sort_regress(corr, n, s))]
    return spark.createDataFrame(rows, "method string, src string, dst string")


QUERIES = {
    f.__name__: f
    for f in (
        linear_bits, pc_by_flag, gp_bits, spline_bits, independence_tests, neighbour_information, pelt_changepoints, topological_contexts, topological_changes, lagged_regime_edges, own_segments, window_strengths, window_regimes, cut_search,
        confounder_pairs, mixture_labels, hidden_slopes, minimal_shifts, flag_shifts, setting_marks, missing_value_graph, pc_graph, joint_context_graph, cam_edges, sort_regress_edges,
    )
}
