"""Helpers shared by the operators: durable tables, batches, keyed blobs."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a session of one machine without any gets one in its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master or ""):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Give back what finished steps held on the driver.

    A collection in the JVM lets Spark's cleaner drop the broadcasts, shuffles and
    plans of finished steps, on the executors too, and shrinks the heap; freed
    memory of Python's own allocations goes back to the system.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: rows of an Arrow batch: texts are long, and a worker holds a batch several times over
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` rows, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name like each of these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def text_groups(texts: list[bytes | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; a longer text stands alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type, from_pandas=False) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def group_count(df: DataFrame, rows_each: int, least: int = 16) -> int:
    """How many exchange groups keep about ``rows_each`` input rows in each."""
    return max(least, -(-df.count() // rows_each))


def to_blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def folder(spark: SparkSession, name: str) -> str:
    """A new path for a table under the session's checkpoint folder."""
    return f"{_checkpoint_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and read it again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


SIEVE_BITS = 1 << 26


def sieve(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size (8 MB) with the hashed bit of every value of ``column`` set."""
    bit = F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))
    parts = keys.select(bit.alias("_bit")).groupBy(F.expr("_bit div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(_bit % 32768)").alias("bits"))
    out = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for row in parts.collect():  # at most 2048 rows of 4 KB
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def in_sieve(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sifted(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """(id, text) of the documents whose id is among ``keys.id``: a bitmap first, then an exact join.

    The bitmap keeps most other texts out of the shuffle while it is sparse; over
    a corpus too large for it, more texts pass and the join decides alone.
    ``docs`` has the columns id and text, ``keys`` has id and may have others.
    With ``once``, a task passes each id a single time (where the id is that of
    the text, so that a much repeated text isn't shuffled again and again).
    """
    bits = docs.sparkSession.sparkContext.broadcast(sieve(keys, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held = in_sieve(bits.value, batch.column(2).to_numpy())
            if once:
                for k in np.flatnonzero(held).tolist():
                    key = batch.column(0)[k].as_py()
                    held[k] = key not in seen
                    seen.add(key)
            yield batch.filter(pa.array(held)).select([0, 1])

    rows = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(SIEVE_BITS)).alias("bit"))
    return rows.mapInArrow(run, "id long, text string").join(keys, "id")


def most_frequent(counted: DataFrame, value: str, limit: int) -> np.ndarray:
    """The most frequent values and their counts (column n), by value: at most ``limit`` of them.

    The least count that keeps within the limit comes from a histogram of the
    counts, so no sort or top-k runs over the values.
    """
    counted = durable(counted)
    kept, least = 0, None
    for row in sorted(counted.groupBy("n").count().collect(), key=lambda r: -r["n"]):
        kept += row["count"]
        if kept > limit:
            break
        least = row["n"]
    if least is None:
        return np.zeros((2, 0), dtype=np.uint64)
    top = counted.where(F.col("n") >= least).toPandas()
    order = np.argsort(top[value].to_numpy(dtype=np.int64).view(np.uint64))
    return np.stack([top[c].to_numpy(dtype=np.int64).view(np.uint64)[order] for c in (value, "n")])
