"""Readers that turn the known file layouts into typed tables.

All go through Spark's own readers, so paths may be globs in any store that
Spark reads, and every file is a separate split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from shiftscope.operators.regimes import block_gate

SENTINEL, SENTINEL_BELOW = -9999.0, -9000.0
BLOCK_ROWS, BLOCK_BAD, MOST_NULLS = 30, 8, 20


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def by_header(spark: SparkSession, pattern: str, columns: list[str] | None, sep: str = ",", glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, columns as text) of delimited files that may each have their columns in another order.

    Every file's heading is its first line; a column that a file lacks is null
    there.  Without ``columns`` the result has file, names and cells.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    cells = F.transform(F.split(F.rtrim("value"), re.escape(sep)), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    # ids grow along a file's first block, whose first line they find
    lines = reader.text(pattern).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), cells.alias("cells"))
    first = lines.where("block = 0").groupBy("file").agg(F.min("id").alias("head"))  # numbers alone: lines would be sorted to find the least
    heads = lines.join(F.broadcast(first), "file").where("block = 0 and id = head").select("file", "head", F.col("cells").alias("names"))
    rows = lines.join(F.broadcast(heads), "file").where((F.col("block") > 0) | (F.col("id") > F.col("head"))).where(F.size("cells") >= F.size("names"))  # a row per file
    if columns is None:
        return rows.select("file", "names", "cells")
    return rows.select("file", *(F.get("cells", F.array_position("names", c).cast("int") - 1).alias(c) for c in columns))


def _number(column: str) -> Column:
    return F.col(column).try_cast("double")


def numeric_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True, names: list[str] | None = None) -> DataFrame:
    """A delimited file of doubles; a heading of numbers (column positions) becomes x0, x1, ..."""
    df = spark.read.csv(path, sep=sep, header=header)
    names = names or [f"x{c}" if c.isdigit() else c for c in df.columns]
    return df.toDF(*names).select(*(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names))


def headless_text(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Comma-separated rows after a first line with the column count; rows with a NaN or a missing field are dropped."""
    schema = T.StructType([T.StructField(f"x{i}", T.DoubleType()) for i in range(columns)])
    df = spark.read.csv(path, schema=schema, mode="PERMISSIVE").where(F.col(f"x{columns - 1}").isNotNull())
    return df.where(F.forall(F.array(*df.columns), lambda v: v.isNotNull() & ~F.isnan(v)))


def context_tables(spark: SparkSession, pattern: str, number: str = r"_(\d+)\.\w+$", sep: str = "\t") -> DataFrame:
    """One file per context, numbered in its name: (context, x0, ...); a file's columns may be in any order."""
    columns = spark.read.csv(pattern, sep=sep, header=True).columns
    rows = by_header(spark, pattern, columns, sep)
    values = [_number(c).alias(f"x{c}" if c.isdigit() else c) for c in columns]
    return rows.select(F.regexp_extract("file", number, 1).cast("int").alias("context"), *values)


def edge_list(spark: SparkSession, path: str, sep: str = "\t", first: int = 1) -> DataFrame:
    """(src, dst) pairs, renumbered from 0 if they count from ``first``."""
    df = spark.read.csv(path, sep=sep, schema="src int, dst int")
    return df.dropna().select((F.col("src") - first).alias("src"), (F.col("dst") - first).alias("dst"))


def adjacency(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A 0/1 matrix file (row points to column) as (src, dst); rows are numbered in file order."""
    df = spark.read.csv(path, sep=sep, header=header)
    # a graph's matrix is one small file: its rows keep their order within the single split
    rows = df.coalesce(1).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select(F.col("_id").cast("int").alias("src"), F.array(*(F.expr(f"try_cast(`{c}` as double)") for c in df.columns)).alias("cells"))
    return rows.select("src", F.posexplode("cells").alias("dst", "w")).where("w <> 0").select("src", "dst")


def _year(column: str) -> Column:
    return F.substring(F.col(column).cast("string"), 1, 4).try_cast("int")


def flux_sites(spark: SparkSession, pattern: str, metadata: DataFrame, variables: list[str], target_year: int = 2006, time: str = "TIMESTAMP") -> DataFrame:
    """Daily flux files: (site, year, t, variables) of each site's year closest to the target.

    Keeps file names with DD and FULLSET; the site is the second part of the
    name; metadata (site, start_year, end_year) bounds the years; a site goes if a
    30-row block of the chosen year has over 8 sentinels in one variable; the
    sentinels that are left become 0.
    """
    df = by_header(spark, pattern, [time, *variables], glob="*FULLSET*", recursive=True)
    name = F.element_at(F.split("file", "/"), -1)
    rows = df.select(name.alias("file"), F.split(name, "_")[1].alias("site"), _year(time).alias("year"), F.col(time).alias("stamp"), *(_number(v).alias(v) for v in variables))
    rows = rows.where(F.col("file").contains("DD") & F.col("file").contains("FULLSET")).drop("file")
    rows = rows.join(metadata, "site").where(F.col("year").between(F.col("start_year"), F.col("end_year")))
    chosen = rows.groupBy("site").agg(F.min_by("year", F.struct(F.abs(F.col("year") - target_year), "year")).alias("year"))
    rows = rows.join(chosen, ["site", "year"])
    good = None
    for v in variables:
        passed = block_gate(rows, ["site"], "stamp", v, SENTINEL_BELOW, BLOCK_ROWS, BLOCK_BAD)
        good = passed if good is None else good.join(passed, "site")
    rows = rows.join(good, "site")
    t = F.row_number().over(W.partitionBy("site").orderBy("stamp")) - 1
    return rows.select("site", "year", t.alias("t"), *(F.when(F.col(v) < SENTINEL_BELOW, 0.0).otherwise(F.col(v)).alias(v) for v in variables))


def river_basins(spark: SparkSession, pattern: str, variables: list[str], target_year: int = 2010, most: int | None = None) -> DataFrame:
    """Daily basin files: (location, year, t, variables) of the year closest to the target, where no variable has over 20 nulls."""
    df = by_header(spark, pattern, ["time", *variables])
    location = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    rows = df.select(location.alias("location"), _year("time").alias("year"), F.col("time").alias("stamp"), *(_number(v).alias(v) for v in variables))
    chosen = rows.groupBy("location").agg(F.min_by("year", F.struct(F.abs(F.col("year") - target_year), "year")).alias("year"))
    rows = rows.join(chosen, ["location", "year"])
    gaps = rows.groupBy("location").agg(F.greatest(*(F.count_if(F.col(v).isNull()) for v in variables), F.lit(0)).alias("gaps")).where(F.col("gaps") <= MOST_NULLS)
    if most is not None:
        gaps = gaps.orderBy("location").limit(most)
    rows = rows.join(gaps.select("location"), "location")
    t = F.row_number().over(W.partitionBy("location").orderBy("stamp")) - 1
    return rows.select("location", "year", t.alias("t"), *(F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in variables))


def strength_matrices(spark: SparkSession, pattern: str, nodes: int) -> DataFrame:
    """Files loc_year_0_month.csv of (2N x N) strengths, row = N * lag + parent: (loc, year, month, parent, lag, child, w)."""
    df = spark.read.csv(pattern, schema=", ".join(f"c{i} double" for i in range(nodes)))
    name = F.split(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1), "_")
    # a matrix of 2N rows is a single split, so the id's low bits are the row's place in its file
    rows = df.select(name[0].alias("loc"), name[1].cast("int").alias("year"), name[3].cast("int").alias("month"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"), F.array(*df.columns).alias("cells"))
    place = F.row_number().over(W.partitionBy("file").orderBy("id")) - 1
    rows = rows.withColumn("row", place)
    return rows.select("loc", "year", "month", (F.col("row") % nodes).alias("parent"), F.floor(F.col("row") / nodes).cast("int").alias("lag"), F.posexplode("cells").alias("child", "w"))


def strength_means(strengths: DataFrame, parent: int, child: int, year: int | None = None, month: int | None = None) -> DataFrame:
    """Mean strength of one link per location, over everything, a year, or one month."""
    rows = strengths.where((F.col("parent") == parent) & (F.col("child") == child))
    for name, value in (("year", year), ("month", month)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.groupBy("loc").agg(F.avg("w").alias("w"))


def cytometry(spark: SparkSession, path: str, proteins: list[str], observational: tuple[int, ...] = (1, 2), targets: dict[int, str] | None = None) -> DataFrame:
    """Pooled cells with their experiment, whether it is observational, and the intervened protein."""
    df = by_header(spark, path, ["experiment", *proteins], "\t")
    e = F.col("experiment").cast("int")
    target = F.create_map(*[F.lit(x) for kv in (targets or {0: ""}).items() for x in kv])[e]
    return df.select(e.alias("experiment"), e.isin(*observational).alias("observational"), target.alias("target"), *(_number(p).alias(p) for p in proteins))


def perturbation_counts(counts: DataFrame, genes: list[str]) -> DataFrame:
    """log(1 + count) of every gene, perturbation column kept."""
    return counts.select("perturbation", *(F.log1p(F.col(g)).alias(g) for g in genes))


def located(index: DataFrame, ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Location numbers to ids (by order of ids) to metadata; numbers without metadata stay."""
    numbered = ids.distinct().withColumn("number", F.row_number().over(W.orderBy("id")) - 1)  # one row per location
    return index.join(numbered, "number").join(metadata, "id", "left")


def numpy_matrices(spark: SparkSession, pattern: str) -> DataFrame:
    """Two-dimensional ``.npy`` files of numbers as (file, row, cells): each file is read by one task."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                for i in range(0, len(table), 4096):
                    part = table[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(i, i + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, "file string, row long, cells array<double>")


def perturbation_matrices(spark: SparkSession, pattern: str, genes: list[str]) -> DataFrame:
    """Expression matrices, one ``.npy`` file per perturbation (rows are cells): (perturbation, row, log(1 + count) per gene)."""
    name = F.regexp_extract("file", r"([^/]+)\.npy$", 1)
    return numpy_matrices(spark, pattern).select(name.alias("perturbation"), "row", *(F.log1p(F.col("cells")[i]).alias(g) for i, g in enumerate(genes)))


def clustered_locations(index: DataFrame, clusters: DataFrame, metadata: DataFrame) -> DataFrame:
    """Clusters of location numbers (number, cluster) with the locations' ids and metadata."""
    return located(clusters, index.select("id"), metadata)
