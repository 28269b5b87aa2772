"""Operator 2: proportional stratified interleaving of sources over shards.

Rows of each source are put in a seeded random order and given the fractional
rank ``(2 * rank + 1) / (2 * rows of the source)``.  Sorted by it, every stretch
of the sequence holds the sources in their overall proportions, so cutting it
into equal runs gives every shard the mixture.

Global ranks need no single sorted partition: rows are dealt to buckets that
are ordered among themselves (by the leading bits of the shuffled key, then by
ranges of the whole final order), a small table of bucket counts gives each bucket's
offset, and ``row_number`` numbers the rows inside a bucket.  A source with a
third of all rows is spread over as many buckets as any other rows, and so are
many sources of one size.

The texts are read once: doc_id, source, size and checksum are stored, and all
else runs over them.  Equal rows are interchangeable, so they are counted before the
first ranking and dealt out again after it; one row that a third of the table repeats
is then no hot key, since its copies' fractional ranks lie apart.

Nulls: a null source is a stratum of its own, a null text has size 1 and the
checksum of the empty string, a null doc_id takes part like any other value.
Repeated rows are rows of their own.  Ties in the shuffled key go by doc_id, checksum
and size, ties in the fractional rank by source.  A very long text counts as one row
like any other.  An empty table gives an empty result.  Only the named columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shiftscope.llm.common import durable

SEED = 20240
#: copies of a row that one step deals out
COPIES = 1 << 16


def _ranked(rows: DataFrame, strata: list[str], bucket: str, order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """Add the 0-based place of each row within its stratum, and the stratum's size; a row takes ``weight`` places."""
    counts = rows.groupBy(*strata, bucket).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    if strata:
        ahead = W.partitionBy(*strata).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        total = W.partitionBy(*strata)
    else:  # a table of bucket counts, of bounded size
        ahead = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
        total = W.partitionBy()
    offsets = counts.select(
        *strata, bucket, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(total).alias(f"{name}_total")
    )
    within = W.partitionBy(*strata, bucket).orderBy(*order)
    before = F.sum(weight).over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col(weight) if weight else F.row_number().over(within) - 1
    return (
        rows.withColumn("_row", before)
        .join(offsets, [*strata, bucket])
        .withColumn(name, F.col("_ahead") + F.col("_row"))
        .drop("_row", "_ahead")
    )


def interleave(docs: DataFrame, shards: int = 16, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """Shard and slot of every document.

    Returns doc_id, source, size, text_crc32, frac (fractional rank), shard and
    slot.  Shard sizes in rows differ by one at most; slots are gapless from 0.
    ``buckets``: ordered buckets per stratum, by default one per 4096 rows (32
    or more); it changes speed alone, never the result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = durable(rows)
    if buckets is None:
        buckets = max(32, rows.count() // 4096)
    rows = rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.select(
        "*",
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("_stratum"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32")).alias("_key"),
    )
    # the leading bits of the key, read as unsigned, in order
    rows = rows.withColumn("_bucket", ((F.shiftrightunsigned("_key", 32) * buckets).cast("long") / F.lit(float(1 << 32))).cast("int"))
    rows = rows.withColumn("_key", F.shiftrightunsigned("_key", 1))
    inner = [F.col("_key"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _ranked(rows, ["_stratum"], "_bucket", inner, "_rank", "_copies")
    # copies are dealt out in two steps, each of bounded width
    ranked = ranked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_copies") - 1).cast("long"), F.lit(COPIES).cast("long"))))
    ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.col("_part"), F.least(F.col("_part") + COPIES, F.col("_copies")) - 1)))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_copy")).drop("_part", "_copy", "_copies")
    ranked = ranked.withColumn("frac", (F.col("_rank") * 2 + 1) / (F.col("_rank_total") * 2)).drop("_bucket")
    order = [F.col("frac"), F.col("_stratum"), *inner]
    # ranges of the whole order, not of the fraction alone: many sources of one size share their fractions
    ranked = durable(ranked.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()))
    placed = _ranked(ranked, [], "_bucket", order, "_place")
    # whole-number division, so that the cuts are exact at any size
    shard = F.expr(f"cast((_place * {shards}L) div _place_total as int)")
    first = F.expr(f"(shard * _place_total + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_place") - first).select(
        "doc_id", "source", "size", "text_crc32", "frac", "shard", "slot"
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "frac",
    )
