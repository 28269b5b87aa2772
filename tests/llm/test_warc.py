import gzip
import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import datasource as ds, functions as F, types as T

from shiftscope.llm import warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("first", "_key", "_probe", "payload"))])


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], PAGES)


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        first = min(same, default=None) if len(data) >= least else None
        revisit = first is not None and page_id != first
        out.append((page_id, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def round_trip(spark, frame, path, **options):
    warc.archive(frame, path, **options)
    return sorted((tuple(r) for r in warc.archived_pages(spark, path).collect()), key=str)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.query(spark, sf_dir)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(warc.ORACLE_SQL).fetchall(), key=str)


def test_copies_nulls_and_clashing_names(spark, pages, tmp_path):
    rows = [(9, "http://a/", "same"), (3, None, "same"), (3, "http://b/ c\r\nWARC-Type: x", "same"), (None, "u", "same"), (4, "u", None), (5, "u", ""), (7, "u", "é" * 50_000), (8, "u", "one"), (None, None, "nobody"), (None, None, "nobody")]
    assert round_trip(spark, pages(rows), str(tmp_path / "a")) == expected(rows)
    assert round_trip(spark, pages(rows), str(tmp_path / "b"), least=4) == expected(rows, 4)
    targets = {r["target_uri"] for r in warc.read_archives(spark, str(tmp_path / "a"), "none").collect()}
    assert "http://b/%20c%0D%0AWARC-Type:%20x" in targets and None in targets


def test_no_rows(spark, pages, tmp_path):
    assert round_trip(spark, pages([]), str(tmp_path / "a")) == []
    assert warc.read_archives(spark, str(tmp_path / "nothing")).collect() == []


def test_hot_payloads(spark, pages, tmp_path):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"own {i}") for i in range(9000, 0, -1)]
    got = round_trip(spark, pages(rows), str(tmp_path / "a"))
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h, i)
    want = [(i, len(h), warc.base32_sha1(h.encode()), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in rows]
    assert got == sorted(want, key=str)


def some_records(n=60):
    return [("revisit" if k % 5 == 4 else "response", f"urn:x:{k}", f"http://h{k % 3}/{k}", "2020-01-01T00:00:00Z", None, os.urandom(7 * k) + b"\r\n\r\n" * (k % 3)) for k in range(n)]


def check_records(got, records, payload=True):
    assert [(r["record_id"], r["payload_bytes"]) for r in got] == [(r[1], len(r[5])) for r in records]
    for r, x in zip(got, records, strict=True):
        assert r["payload_digest"] == "sha1:" + warc.base32_sha1(x[5])
        if payload:
            assert (r["payload_sha1"], r["payload"]) == ((warc.base32_sha1(x[5]), x[5]) if x[0] == "response" else (None, None))


@pytest.mark.parametrize("form", ["own", "gzip", "one member each, no field", "plain"])
def test_archives_of_others(spark, tmp_path, form):
    records = some_records()
    raw = [warc.record(*r) for r in records]
    pack = {"own": lambda x: warc.member(x, 6), "gzip": gzip.compress, "plain": lambda x: x}.get(form, lambda x: zlib.compress(x, 9, wbits=31))
    name = "a.warc" if form == "plain" else "a.warc.gz"
    (tmp_path / name).write_bytes(b"".join(map(pack, raw)))
    (tmp_path / "notes.txt").write_text("not an archive")
    check_records(warc.read_archives(spark, str(tmp_path)).collect(), records)
    check_records(warc.read_archives(spark, f"file://{tmp_path}/{name}", "none").collect(), records, False)


def test_lines_as_others_write_them(spark, tmp_path):
    block = b"hello"
    text = b"WARC/1.0\r\nwarc-type:warcinfo\r\nWARC-Record-ID:  <urn:a>\r\nX-Long: a\r\n\tb\r\nContent-Type: text/plain\r\ncontent-length: 5\r\n\r\n" + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(text * 3)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r["record_type"], r["record_id"], r["payload"]) for r in got] == [("warcinfo", "urn:a", block)] * 3
    assert warc.headers(text)["x-long"] == "a b"


@pytest.mark.parametrize("split", [500, 3000, 10_000, 1 << 26])
def test_cuts_of_files(spark, tmp_path, split):
    records = some_records()
    for f in range(2):
        (tmp_path / f"{f}.warc.gz").write_bytes(b"".join(warc.member(warc.record(*r), 1) for r in records))
    df = warc.read_archives(spark, str(tmp_path), splitBytes=split)
    parts = warc.WarcReader({"path": str(tmp_path), "splitBytes": str(split)}, df.schema).partitions()
    assert (len(parts) == 1) == (split == 1 << 26)
    assert sorted(r["record_id"] for r in df.collect()) == sorted(2 * [r[1] for r in records])


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path, monkeypatch):
    records = some_records()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(warc.record(*r), 1) for r in records))
    df = warc.read_archives(spark, str(tmp_path))
    for test in (
        "record_type = 'revisit'",
        "record_type IN ('revisit', 'x') AND target_uri LIKE 'http://h1%'",
        "target_uri LIKE '%7' AND payload_bytes > 50",
        "refers_to IS NULL AND content_length >= 200",
        "NOT (record_type = 'revisit') AND record_id <=> 'urn:x:5'",
        "NOT (refers_to = 'a')",
        "record_id IN ('urn:x:1', NULL)",
        "record_id > 'urn:x:5' OR record_type = 'revisit'",
    ):
        want = [r["record_id"] for r in spark.createDataFrame(df.collect(), df.schema).where(test).collect()]
        once = warc.read_archives(spark, str(tmp_path), pushdown="any").where(test)
        assert [r["record_id"] for r in once.collect()] == want, test
        assert (" OR " in test or "payload_bytes" in test) == (" Filter " in once._jdf.queryExecution().executedPlan().toString()), test
    some = warc.read_archives(spark, str(tmp_path), where={"record_type": "response", "target_uri": ["http://h1/7", "http://h2/8", "http://h1/4"]})
    assert " Filter " not in some._jdf.queryExecution().executedPlan().toString()
    for test, ids in (("true", ["urn:x:7", "urn:x:8"]), ("record_id = 'urn:x:7'", ["urn:x:7"]), ("true", ["urn:x:7", "urn:x:8"]), ("payload_bytes > 55", ["urn:x:8"])):
        assert [r["record_id"] for r in some.where(test).collect()] == ids
    # a record that is passed over is inflated no further than its headers
    inflated = []
    more = warc.Stream.more
    monkeypatch.setattr(warc.Stream, "more", lambda self, step: inflated.append(step) or more(self, step))
    big = [("response", f"urn:x:{k}", "u", "d", None, os.urandom(1 << 20)) for k in range(4)]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(warc.member(warc.record(*r), 1) for r in big))
    window = warc.Window(*warc.place(str(tmp_path / "b.warc.gz")))
    rows = list(warc.records(window, 0, window.size, [ds.EqualTo(("record_id",), "urn:x:3")], "none"))
    assert [r[1] for r in rows] == ["urn:x:3"] and rows[0][-3] == 1 << 20 and len(inflated) == 4 and max(inflated) <= 1024


def test_rolled_files_and_strays(spark, pages, tmp_path):
    rows = [(i, "u", "".join(hashlib.sha256(b"%d %d" % (i, k)).hexdigest() for k in range(10))) for i in range(200)]
    path = str(tmp_path / "a")
    warc.archive(pages(rows).repartition(3), path, fileBytes=20_000)
    archives = [f for f in os.listdir(path) if f.endswith(".warc.gz")]
    assert len(archives) > 6
    # what a lost task has left is in no manifest
    (tmp_path / "a" / "part-00000-lost-000.warc.gz").write_bytes(warc.member(warc.record("response", "urn:page:7", None, "d", None, b"x"), 1)[:-9])
    assert sorted(r[0] for r in warc.archived_pages(spark, path).collect()) == list(range(200))


@pytest.mark.parametrize("form", [lambda x: warc.member(x, 6), lambda x: x])
def test_damage_raises(tmp_path, form):
    data = form(warc.record("response", "urn:a", None, "d", None, os.urandom(5000)))
    for name, bad in (("cut", data[:-3000]), ("junk", form(b"NOT A RECORD\r\n\r\n")), ("tail", data + form(b"GARBAGE\r\n\r\n"))):
        (tmp_path / name).write_bytes(bad)
        window = warc.Window(*warc.place(str(tmp_path / name)))
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(window, 0, window.size, [], "bytes"))


def test_own_columns(spark, tmp_path):
    frame = spark.createDataFrame([("conversion", "text", 5), (None, None, 6)], "record_type string, payload string, extra int")
    warc.write_archives(frame, str(tmp_path / "a"))
    warc.write_archives(frame.select("payload"), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).groupBy("record_type", F.col("payload").cast("string").alias("p")).count().collect()
    assert {tuple(r) for r in got} == {("conversion", "text", 1), ("response", "text", 1), ("response", "", 2)}
