"""Queries that write the driver's tables in the known file layouts and read them back, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shiftscope.operators import graphs
from shiftscope.plans.table_queries import read
from shiftscope.sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _folder(spark, name: str) -> str:
    return f"{graphs.shared_folder(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


#: daily order values of each priority; a day's value is missing where it is small
DAYS = "d AS (SELECT left(o_orderpriority, 1) AS site, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS price, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)"


def _days(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("site"), F.to_date("o_orderdate").alias("day"))
    return rows.agg(F.round(F.sum("o_totalprice"), 2).alias("price"), F.count(F.lit(1)).cast("double").alias("n"))


@query(f"""WITH {DAYS}, r AS (SELECT site, year(day)::INT AS year, day, CASE WHEN price >= 20000 THEN price END AS price, n FROM d),
c AS (SELECT site, arg_min(year, abs(year - 1995) * 10000 + year) AS year FROM r GROUP BY 1), k AS (SELECT r.* FROM r JOIN c USING (site, year)),
g AS (SELECT site FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE price IS NULL) <= 20)
SELECT site AS location, year, (row_number() OVER (PARTITION BY site ORDER BY day) - 1)::INT AS t, coalesce(price, 0) AS price, n FROM k WHERE site IN (FROM g)""")
def basin_files(spark, sf_dir):
    """Daily files of basins, one per priority: the year next to 1995 of those with few gaps."""
    path = _folder(spark, "basins")
    rows = _days(spark, sf_dir).select(F.concat("site", F.lit(".csv")).alias("file"), F.col("day").cast("string").alias("time"), F.when(F.col("price") >= 20000, F.col("price")).alias("price"), "n")
    sinks.write_named(rows, path, "file", "time", ["time", "n", "price"])
    return readers.river_basins(spark, f"{path}/*.csv", ["price", "n"], 1995)


@query(f"""WITH {DAYS}, r AS (SELECT site, year(day)::INT AS year, day, CASE WHEN price < 30000 THEN -9999.0 ELSE price END AS price, n FROM d WHERE year(day) BETWEEN 1993 AND 1996 + site::INT % 2),
c AS (SELECT site, arg_min(year, abs(year - 1997) * 10000 + year) AS year FROM r GROUP BY 1), k AS (SELECT r.*, row_number() OVER (PARTITION BY site ORDER BY day) - 1 AS t FROM r JOIN c USING (site, year)),
b AS (SELECT site, t // 30 AS block, count(*) FILTER (WHERE price < -9000) AS bad FROM k GROUP BY 1, 2), g AS (SELECT site FROM b GROUP BY 1 HAVING max(bad) <= 8)
SELECT site, year, t::INT AS t, CASE WHEN price < -9000 THEN 0 ELSE price END AS price, n FROM k WHERE site IN (FROM g)""")
def flux_files(spark, sf_dir):
    """Daily files of flux sites, one per priority: the year next to 1997 within each site's years, sites with long gaps left out."""
    path = _folder(spark, "flux")
    rows = _days(spark, sf_dir)
    named = rows.select(
        F.concat(F.lit("FLX_"), "site", F.lit("_FLUXNET2015_FULLSET_DD_1992-1998_1-3.csv")).alias("file"), F.date_format("day", "yyyyMMdd").alias("TIMESTAMP"), F.when(F.col("price") < 30000, -9999.0).otherwise(F.col("price")).alias("price"), "n"
    )
    sinks.write_named(named, path, "file", "TIMESTAMP", ["TIMESTAMP", "price", "n"])
    years = rows.select("site").distinct().select("site", F.lit(1993).alias("start_year"), (1996 + F.col("site").cast("int") % 2).alias("end_year"))
    return readers.flux_sites(spark, path, years, ["price", "n"], 1997)


@query("""SELECT l_linenumber::INT AS context, l_quantity AS x0, l_discount AS x1, l_tax AS x2 FROM lineitem""")
def context_files(spark, sf_dir):
    """One file of rows per line number, read as contexts; every other file has its columns in another order."""
    path = _folder(spark, "contexts")
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("rows_context_"), "l_linenumber", F.lit(".tsv")).alias("file"), "l_linenumber", "l_orderkey", F.col("l_quantity").alias("0"), F.col("l_discount").alias("1"), F.col("l_tax").alias("2"))
    for odd, columns in ((0, ["0", "1", "2"]), (1, ["2", "0", "1"])):
        sinks.write_named(rows.where(F.col("l_linenumber") % 2 == odd), path, "file", "l_orderkey", columns, "\t")
    return readers.context_tables(spark, f"{path}/rows_context_*.tsv")


#: link strengths of each priority by year and month: two nodes, lags 0 and 1
LINKS = "s AS (SELECT left(o_orderpriority, 1) AS loc, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(sum(o_totalprice), 2) AS a, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2, 3)"


def _strengths(spark, sf_dir):
    path = _folder(spark, "strengths")
    rows = read(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("loc"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    rows = rows.agg(F.round(F.sum("o_totalprice"), 2).alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    cells = F.posexplode(F.array(F.struct((F.col("a") * 0).alias("c0"), F.col("a").alias("c1")), F.struct(F.col("n").alias("c0"), (F.col("n") * 0).alias("c1")), F.struct((F.col("a") + F.col("n")).alias("c0"), F.col("n").alias("c1")), F.struct(F.col("a").alias("c0"), (F.col("a") - F.col("n")).alias("c1"))))
    named = rows.select(F.concat_ws("_", "loc", "year", F.lit("0"), F.concat("month", F.lit(".csv"))).alias("file"), cells.alias("row", "cells")).select("file", "row", "cells.*")
    sinks.write_named(named, path, "file", "row", ["c0", "c1"], header=False)
    return readers.strength_matrices(spark, f"{path}/*.csv", 2)


@query(f"""WITH {LINKS} SELECT loc, year, month, parent, lag, child, round(w, 3) AS w FROM s, LATERAL (SELECT unnest([0, 0, 1, 1, 0, 0, 1, 1]) AS parent, unnest([0, 0, 0, 0, 1, 1, 1, 1]) AS lag, unnest([0, 1, 0, 1, 0, 1, 0, 1]) AS child, unnest([a * 0, a, n, n * 0, a + n, n, a, a - n]) AS w)""")
def strength_files(spark, sf_dir):
    """Strength matrices, a file per place, year and month, as links."""
    return _strengths(spark, sf_dir).withColumn("w", F.round("w", 3))


@query(f"""WITH {LINKS}, m AS (SELECT loc, year, month, unnest([a, n]) AS w FROM s), y AS (SELECT loc, avg(w) AS w FROM m GROUP BY 1)
SELECT loc, 'all' AS span, round(w, 5) AS w FROM y UNION ALL SELECT loc, '1995', round(avg(w), 5) FROM m WHERE year = 1995 GROUP BY 1 UNION ALL SELECT loc, '1995-03', round(avg(w), 5) FROM m WHERE year = 1995 AND month = 3 GROUP BY 1""")
def strength_file_means(spark, sf_dir):
    """Mean strength of one link per place: over all files, a year, and a month."""
    rows = _strengths(spark, sf_dir)
    spans = {"all": (None, None), "1995": (1995, None), "1995-03": (1995, 3)}
    parts = [readers.strength_means(rows, 0, 1, *span).select("loc", F.lit(name).alias("span"), F.round("w", 5).alias("w")) for name, span in spans.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: graphs over line numbers, one per return flag: lines that stand next to each other in many orders
MODES = """p AS (SELECT a.l_returnflag AS graph, a.l_linenumber - 1 AS src, b.l_linenumber - 1 AS dst, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber GROUP BY 1, 2, 3),
e AS (SELECT graph, src, dst FROM (SELECT *, avg(n) OVER (PARTITION BY graph) AS mean FROM p) WHERE n > mean)"""


def _modes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("graph"), (F.col("l_linenumber") - 1).alias("line"))
    pairs = rows.withColumnRenamed("line", "src").join(rows.withColumnRenamed("line", "dst"), ["l_orderkey", "graph"]).where("src < dst").groupBy("graph", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    mean = pairs.groupBy("graph").agg(F.avg("n").alias("mean"))
    return pairs.join(mean, "graph").where("n > mean").select("graph", "src", "dst")


@query(f"WITH {MODES} SELECT graph, src::INT AS src, dst::INT AS dst FROM e")
def graph_files(spark, sf_dir):
    """Graphs written as matrix files, one folder each, and read back as edges."""
    path = _folder(spark, "graphs")
    edges = _modes(spark, sf_dir)
    sinks.write_graph(edges.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")}), path, [str(i) for i in range(7)])
    names = [r[0] for r in edges.select("graph").distinct().orderBy("graph").collect()]  # three flags
    found = None
    for name in names:
        part = readers.adjacency(spark, f"{path}/graph={name}").select(F.lit(name).alias("graph"), "src", "dst")
        found = part if found is None else found.unionByName(part)
    return edges if found is None else found


@query(f"WITH {MODES} SELECT src::INT AS src, dst::INT AS dst, count(*) AS n FROM e GROUP BY 1, 2")
def edge_list_file(spark, sf_dir):
    """Edges of all graphs as a list that counts from one, read back and counted."""
    path = _folder(spark, "edges")
    _modes(spark, sf_dir).select(F.col("src") + 1, F.col("dst") + 1).write.option("sep", "\t").csv(path)
    return readers.edge_list(spark, path).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders), r AS (SELECT year, year % 3 AS regime, (make_date(year, 1, 1) - DATE '1992-01-01')::INT AS begin FROM y)
SELECT begin, coalesce(lead(begin) OVER (ORDER BY begin) - begin, 365)::INT AS duration, regime::INT AS regime FROM r""")
def partition_file(spark, sf_dir):
    """Segments of the years written as a changepoint file and read back."""
    from pyspark.sql import Window as W

    years = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()  # one row per year
    rows = years.select((F.col("year") % 3).alias("regime"), F.datediff(F.make_date("year", F.lit(1), F.lit(1)), F.lit("1992-01-01")).alias("begin"))
    rows = rows.select("begin", F.coalesce(F.lead("begin").over(W.orderBy("begin")) - F.col("begin"), F.lit(365)).alias("duration"), "regime")
    path = _folder(spark, "cuts")
    sinks.write_partition(rows, path)
    return spark.read.option("sep", "\t").csv(path, header=True, schema="begin int, duration int, regime int")


CASES = "c AS (SELECT o_orderpriority AS method, 'price' AS metric, 'N_' || (c_nationkey % 5) || '_K_' || left(c_mktsegment, 1) AS name, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"


def _cases(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.lit("N_"), F.col("c_nationkey") % 5, F.lit("_K_"), F.substring("c_mktsegment", 1, 1))
    return rows.select(F.col("o_orderpriority").alias("method"), F.lit("price").alias("metric"), name.alias("case"), F.col("o_totalprice").alias("value"))


@query(f"""WITH {CASES} SELECT method, metric, split_part(name, '_', 2)::DOUBLE AS "N", count(*) AS n_rows, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_samp(value), 3) AS std FROM c WHERE name LIKE '%K_B' GROUP BY 1, 2, 3""")
def sweep_table(spark, sf_dir):
    """Summaries of the cases of one base setting by the varied attribute."""
    rows = sinks.sweep(_cases(spark, sf_dir), {"K": "B"}, "N").toDF("method", "metric", "N", "n_rows", "mean", "median", "var", "std")
    return rows.select("method", "metric", "N", "n_rows", *(F.round(c, 3).alias(c) for c in ("mean", "median", "std")))


@query(f"""WITH {CASES}, m AS (SELECT method, avg(value) AS mean, stddev_samp(value) AS std FROM c GROUP BY 1) SELECT method, format('{{:,.5f}}', round(mean, 5)) AS mean, format('{{:,.5f}}', round(std, 5)) AS std FROM m""")
def metric_file(spark, sf_dir):
    """Metrics with five digits as a tab-separated file, read back as text."""
    path = _folder(spark, "metrics")
    table = sinks.summary(_cases(spark, sf_dir), ["method"]).select("method", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))
    sinks.rounded_tsv(table, path)
    return spark.read.option("sep", "\t").csv(path, header=True, schema="method string, mean string, std string")


@query(f"""WITH {CASES}, m AS (SELECT method, left(name, 3) AS setting, format('{{:,.2f}} $\\pm$ {{:,.2f}}', round(avg(value), 2), round(coalesce(stddev_samp(value), 0), 2)) AS cell FROM c GROUP BY 1, 2),
n AS (SELECT DISTINCT setting FROM m), b AS (SELECT o.method, string_agg(coalesce(m.cell, '-'), ' & ' ORDER BY n.setting) AS cells FROM (SELECT DISTINCT method FROM m) o CROSS JOIN n LEFT JOIN m ON m.method = o.method AND m.setting = n.setting GROUP BY 1)
SELECT 'method & ' || string_agg(setting, ' & ' ORDER BY setting) || ' \\\\' AS line FROM n UNION ALL SELECT method || ' & ' || cells || ' \\\\' FROM b""")
def tex_table(spark, sf_dir):
    """Lines of a LaTeX table of means and deviations, methods by settings."""
    return sinks.tex_rows(_cases(spark, sf_dir).withColumn("setting", F.substring("case", 1, 3)), "method", "setting").select("line")


@query("""WITH i AS (SELECT DISTINCT n_name AS id FROM nation), k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM i), c AS (SELECT c_nationkey AS number, count(*) AS customers FROM customer GROUP BY 1), m AS (SELECT n_name AS id, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
SELECT c.number, c.customers, k.id, m.r_name AS region FROM c JOIN k USING (number) LEFT JOIN m USING (id)""")
def located_clusters(spark, sf_dir):
    """Numbers of places with their names, in order, and what is known of them."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    known = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(F.col("n_name").alias("id"), F.col("r_name").alias("region"))
    clusters = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("number")).agg(F.count(F.lit(1)).alias("customers"))
    return readers.clustered_locations(nation.select(F.col("n_name").alias("id")), clusters, known).select("number", "customers", "id", "region")


@query("""SELECT l_linenumber::INT AS experiment, l_linenumber IN (1, 2) AS observational, CASE l_linenumber WHEN 3 THEN 'raf' WHEN 4 THEN 'mek' END AS target, l_quantity AS raf, l_discount AS mek FROM lineitem""")
def cytometry_file(spark, sf_dir):
    """Pooled cells of all experiments as one file, with what was done to them."""
    path = _folder(spark, "cells")
    sinks.write_table(read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("raf"), F.col("l_linenumber").alias("experiment"), F.col("l_discount").alias("mek")), path, kind="tsv")
    return readers.cytometry(spark, f"{path}/*.csv", ["raf", "mek"], (1, 2), {3: "raf", 4: "mek"})


@query("""SELECT count(*) AS rows, round(sum(l_quantity), 2) AS x0, round(sum(l_tax), 4) AS x1 FROM lineitem WHERE l_discount > 0.02""")
def headless_file(spark, sf_dir):
    """Rows of numbers after a line with their count of columns; rows with a gap are dropped."""
    path = _folder(spark, "plain")
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws(",", "l_quantity", F.when(F.col("l_discount") > 0.02, F.col("l_tax").cast("string")).otherwise(F.lit("NaN"))).alias("line"))
    rows.unionByName(spark.createDataFrame([("2",)], "line string")).write.text(path)
    found = readers.headless_text(spark, path, 2)
    return found.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("x0"), 2).alias("x0"), F.round(F.sum("x1"), 4).alias("x1"))
