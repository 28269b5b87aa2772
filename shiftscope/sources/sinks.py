"""Result writers: graphs, partitions, metric summaries, sweeps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, by: list[str] = (), kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write one table, in folders by the given columns; ``kind``: parquet, csv, tsv or json."""
    writer = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    if kind == "tsv":
        writer.option("header", True).option("sep", "\t").csv(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


#: rows that a task sorts and writes as pieces of files, and bytes that are copied at a time
PIECE_ROWS, COPY_BYTES = 300_000, 1 << 23


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_named(df: DataFrame, path: str, name: str, order: str, columns: list[str], sep: str = ",", header: bool = True) -> int:
    """One delimited file for each value of ``name`` (a file name), its rows in order; the number of files.

    Tasks write ranges of the rows as pieces, batch by batch, so a large file is many tasks'
    work; one task per file then copies the bytes of its pieces.  A file takes its name once
    it is whole, so a task that runs twice leaves the same file.  Null fields are empty.
    """
    parts = max(1, -(-df.count() // PIECE_ROWS))
    pieces = f"{path}/_pieces-{uuid.uuid4().hex}"
    by = [F.col(f"`{name}`"), F.col(f"`{order}`").asc_nulls_last()]
    whole = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")}  # as text: with nulls, pandas would make floats of them
    rows = df.select(name, *dict.fromkeys([order, *columns])).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    rows = rows.select(F.col(f"`{name}`").alias("_file"), *(F.col(f"`{c}`").cast("string").alias(c) if c in whole else F.col(f"`{c}`") for c in columns))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(pieces)
        store.create_dir(root, recursive=True)
        part, made, out = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for file, rows in batch.groupby("_file", sort=False, dropna=False):
                file = None if pd.isna(file) else file
                if not made or made[-1][0] != file:
                    if out is not None:
                        out.close()
                    made.append((file, part, uuid.uuid4().hex))
                    out = store.open_output_stream(f"{root}/{made[-1][2]}", compression=None)
                out.write(rows[columns].to_csv(sep=sep, header=False, index=False, lineterminator="\n").encode())
        if out is not None:
            out.close()
        yield pd.DataFrame(made, columns=["file", "part", "piece"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (store, root), (_, source) = _store(path), _store(pieces)
        for batch in batches:
            for file, own in zip(batch["file"], batch["own"], strict=True):
                made = f"{source}/{uuid.uuid4().hex}"
                with store.open_output_stream(made, compression=None) as out:
                    if header:
                        out.write(pd.DataFrame(columns=columns).to_csv(sep=sep, index=False, lineterminator="\n").encode())
                    for piece in own:
                        with store.open_input_stream(f"{source}/{piece['piece']}", compression=None) as part:
                            while block := part.read(COPY_BYTES):
                                out.write(block)
                store.move(made, f"{root}/{file}")
            yield batch[["file"]]

    found = rows.mapInPandas(write, "file string, part int, piece string").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("own"))
    files = found.mapInPandas(join, "file string").count()
    store, root = _store(pieces)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        store.delete_dir(root)
    return files


def summary(results: DataFrame, keys: list[str], value: str = "value", weight: str | None = None, missing: float = -1.0) -> DataFrame:
    """Count, mean, median, variance and deviation of the present values per key; weighted mean if a weight is named."""
    present = F.when(F.col(value) != missing, F.col(value))
    stats = [F.count(present).alias("n"), F.avg(present).alias("mean"), F.median(present).alias("median"), F.var_samp(present).alias("var"), F.stddev_samp(present).alias("std")]
    if weight:
        w = F.when(present.isNotNull(), F.col(weight))
        stats.append((F.sum(present * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("weighted"))
    return results.groupBy(*keys).agg(*stats)


def sweep(results: DataFrame, base: dict[str, str], varied: str) -> DataFrame:
    """Cases whose name (``key_value`` parts) has all base attributes, with the varied attribute's value, by method and value."""
    number = lambda k: F.regexp_extract("case", rf"(?:^|_){k}_([^_]+)", 1)
    rows = results
    for k, v in base.items():
        rows = rows.where(number(k) == v)
    rows = rows.withColumn(varied, number(varied).cast("double")).where(F.col(varied).isNotNull())
    return summary(rows, ["method", "metric", varied]).orderBy("method", "metric", varied)


def wide(results: DataFrame, rows: str, columns: str, value: str = "mean") -> DataFrame:
    return results.groupBy(rows).pivot(columns).agg(F.first(value))


def rounded_tsv(df: DataFrame, path: str, digits: int = 5) -> None:
    """Doubles with a fixed number of digits, tab-separated."""
    write_table(df.select(*(F.format_number(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)), path, kind="tsv")


def write_graph(edges: DataFrame, path: str, names: list[str]) -> None:
    """A 0/1 matrix per graph (row points to column), tab-separated with the names as heading, one folder per graph."""
    table = edges.groupBy("graph", "src").pivot("dst", names).agg(F.lit(1))
    graphs = edges.select("graph").distinct()
    rows = graphs.crossJoin(F.broadcast(edges.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "row int, src string")))  # as many as nodes
    full = rows.join(table, ["graph", "src"], "left").fillna(0, names).orderBy("graph", "row").select("graph", *names)
    write_table(full, path, ["graph"], "tsv")


def write_partition(partition: DataFrame, path: str) -> None:
    """Changepoints: begin, duration and regime of every segment, in order."""
    write_table(partition.orderBy("begin").coalesce(1), path, kind="tsv")


def tex_rows(results: DataFrame, rows: str, columns: str, value: str = "value", digits: int = 2) -> DataFrame:
    """One line of a LaTeX table per row label, with ``mean $\\pm$ deviation`` per column label, and the heading first: (line_no, line)."""
    names = [r[0] for r in results.select(columns).distinct().orderBy(columns).collect()]  # a table's columns
    cell = F.concat(F.format_number(F.avg(value), digits), F.lit(" $\\pm$ "), F.format_number(F.coalesce(F.stddev_samp(value), F.lit(0.0)), digits))
    table = results.groupBy(rows).pivot(columns, names).agg(cell)
    body = table.orderBy(rows).select(F.concat_ws(" & ", F.col(rows).cast("string"), *(F.coalesce(F.col(f"`{n}`"), F.lit("-")) for n in names)).alias("line"))
    head = results.sparkSession.createDataFrame([(-1, " & ".join([rows, *map(str, names)]) + " \\\\")], "line_no long, line string")
    return head.union(body.select(F.monotonically_increasing_id().alias("line_no"), F.concat("line", F.lit(" \\\\")).alias("line")))
