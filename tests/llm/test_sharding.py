import zlib
from collections import Counter

from shiftscope.llm import sharding


def test_laws(spark, sf_dir, texts):
    rows = sharding.query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    by_id = {r.doc_id: r for r in rows}
    for doc_id, text, *_ in texts:
        raw = (text or "").encode()
        assert (by_id[doc_id].size, by_id[doc_id].text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_matches_brute_force_and_mixture(table):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    got = sharding.interleave(table(rows, wide=True), 8, buckets=7).collect()
    other = sharding.interleave(table(rows), 8, buckets=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, other))  # buckets change nothing
    order = [(r.frac, r.doc_id) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert [f for f, _ in order] == sorted(f for f, _ in order)
    total, hot = len(rows), sum(r[3] == "hot" for r in rows)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert abs(sum(r.source == "hot" for r in own) - len(own) * hot / total) <= 2


def brute(rows, shards):
    """(doc_id, shard, slot) by ranking all rows on the driver, from the law as the docstring states it."""
    spark_hash = {}

    def rank(group):
        return sorted(group, key=lambda r: (spark_hash[r], r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))

    def run(hashes):
        spark_hash.update(hashes)
        sequence = []
        for source in {r[3] for r in rows}:
            own = rank([r for r in rows if r[3] == source])
            sequence += [((2 * i + 1) / (2 * len(own)), "0" if source is None else "1" + source, spark_hash[r], r[0] is not None, r[0] or 0, r) for i, r in enumerate(own)]
        sequence.sort(key=lambda x: x[:5])
        out, used = [], Counter()
        for place, (*_, r) in enumerate(sequence):
            shard = place * shards // len(rows)
            out.append((r[0], shard, used[shard]))
            used[shard] += 1
        return out

    return run


def test_equals_ranking_on_the_driver(spark, table):
    from pyspark.sql import functions as F

    rows = [(i % 90 if i % 7 else None, f"text {i % 60}" if i % 11 else None, "en", None if i % 13 == 0 else "hot" if i % 3 else f"s{i % 4}", 0) for i in range(300)]
    rows += [(5, "again", "en", "hot", 0)] * 150  # a row that a third of the table repeats
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(sharding.SEED), "doc_id", crc), 1)
    hashes = {tuple(r)[:5]: r._key for r in table(rows).withColumn("_key", key).collect()}
    want = brute(rows, 8)(hashes)
    for buckets in (None, 3, 500):
        got = [(r.doc_id, r.shard, r.slot) for r in sharding.interleave(table(rows), 8, buckets=buckets).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_copies_are_dealt_out_in_steps(table, monkeypatch):
    rows = [(1, "a", "en", "x")] * 23 + [(2, "b", "en", "y")] * 10
    want = sorted(map(tuple, sharding.interleave(table(rows), 4).collect()))
    monkeypatch.setattr(sharding, "COPIES", 3)
    assert sorted(map(tuple, sharding.interleave(table(rows), 4).collect())) == want


def test_edge_cases(table):
    rows = [(1, None), (1, None), (None, "x", None, None), (2, "", "en", "a"), (2, "y" * 100_000, "en", "a")]
    got = sharding.interleave(table(rows, wide=True)).collect()
    assert len(got) == 5 and sorted(r.size for r in got) == [1, 1, 1, 2, 100_001]
    assert all(r.slot == 0 for r in got) and len({r.shard for r in got}) == 5
    assert sharding.interleave(table([])).collect() == []


def test_many_sources_of_one_row_are_spread(spark):
    from pyspark.sql import functions as F

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("source "), "id").alias("source"))
    rows = sharding.interleave(docs.repartition(8), 16)
    counts = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert sorted(counts) == [2500] * 16 and rows.select("frac").distinct().count() == 1
    # the one fraction is no hot key of the ranking
    ranges = docs.withColumn("frac", F.lit(0.5)).repartitionByRange(8, "frac", "source").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 20_000
