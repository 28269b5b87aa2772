"""WARC archives as a Python data source: records are written, and read with header predicates pushed down.

``WarcSource`` ("warc") writes a frame of records into compressed archives, one
member per record, and plans reads by files: small ones share a task, and large
ones are cut where a member begins.  A reader inflates the headers of a record
first and tests the pushed predicates on them; the payload of a record that they
reject, or of any with the option ``payload`` at ``none``, stays compressed: the
member's length stands in its own gzip header ("sl"), so the reader steps over it.
Archives of other writers, without that field or uncompressed, are read too.

A write lists its files in a manifest that is written last; where there are
manifests only the files that they list are read, so what a lost or repeated task
has left is never seen.  Files are named by task and a random part, and reading a
partition again gives the same rows.

Defined cases: a null payload is an empty one; a null record id or target has no
header and is read as null; characters of a target or an id that would break a
header line are percent-encoded; extra columns of a written frame are ignored;
a record that is cut off or isn't WARC raises; a folder without archives and a
write without rows give an empty table.  See ``archived_pages`` for copies.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds

from shiftscope.llm.common import discard, folder, small_batches

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: rows and bytes of a batch that a reader passes on
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24
CHUNK = 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
HEADS = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_type string, content_length long"
#: columns known from a record's headers alone, and the header of each
HEADER_OF = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_type": "content-type",
    "content_length": "content-length",
}
WRITTEN = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: str | None, form: str = "{}") -> str:
    """A header line; nothing for null."""
    if value is None:
        return ""
    return f"{name}: {form.format(re.sub(r'[\x00-\x20\x7f<>]', lambda m: f'%{ord(m[0]):02X}', value))}\r\n"


def record(kind: str, record_id: str | None, target: str | None, date: str, refers_to: str | None, payload: bytes) -> bytes:
    """One record with its HTTP head; a revisit keeps the head and the digest of the payload, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        f"{VERSION.decode()}\r\nWARC-Type: {kind}\r\n",
        _line("WARC-Record-ID", record_id, "<{}>"),
        f"WARC-Date: {date}\r\n",
        _line("WARC-Target-URI", target),
        _line("WARC-Refers-To", refers_to, "<{}>"),
        f"WARC-Profile: {REVISIT_PROFILE}\r\n" if kind == "revisit" else "",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}\r\nWARC-Block-Digest: sha1:{base32_sha1(block)}\r\n",
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n",
    ]
    return b"".join([*(x.encode() for x in lines), block, b"\r\n\r\n"])


def member(data: bytes, level: int) -> bytes:
    """A gzip member that tells its own length and that of its data, where 32 bits hold them."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 14 + len(body) + 8
    if max(size, len(data)) >> 32:
        head = b"\x1f\x8b\x08\x00\0\0\0\0\0\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + size.to_bytes(4, "little") + len(data).to_bytes(4, "little")
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path, re.I) else (fs.LocalFileSystem(), path)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, names: list[str], overwrite: bool):
        self.path = options["path"]
        self.level, self.roll = int(options.get("level", 4)), int(options.get("fileBytes", 1 << 28))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.columns = [names.index(c) if c in names else None for c in WRITTEN]
        if self.columns[-1] is None:
            raise ValueError("records need a payload")
        if overwrite:
            raise ValueError("archives are only added to")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            lists = [batch.column(i).cast(pa.large_binary()).to_pylist() if i is not None else [None] * len(batch) for i in self.columns]
            for kind, record_id, target, date, refers_to, payload in zip(*lists, strict=True):
                if out is None:
                    files.append(f"{stem}-{len(files):03d}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None, buffer_size=CHUNK), 0
                text = [None if x is None else x.decode() for x in (kind, record_id, target, date, refers_to)]
                data = member(record(text[0] or "response", text[1], text[2], text[3] or self.date, text[4], payload or b""), self.level)
                out.write(data)
                size += len(data)
                if size >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = place(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{root}/{f}")


class Window:
    """Bytes of a file by their place, read in chunks; what a step leaps over isn't read."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self.begin, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from this place on."""
        n = max(0, min(n, self.size - at))
        if at < self.begin or at + n > self.begin + len(self.data):
            self.begin, self.data = at, self.file.read_at(min(max(n, CHUNK), self.size - at), at) if n else b""
        return self.data[at - self.begin : at - self.begin + n]


class Stream:
    """The data of one record from a place in a file on; inflated as far as it is asked for."""

    def __init__(self, window: Window, at: int):
        self.window, self.at = window, at
        head = window.get(at, 12)
        self.packed = head[:2] == b"\x1f\x8b"
        self.end: int | None = None  # of the member, where its header tells it
        if self.packed and len(head) == 12 and head[3] & 4:
            extra = window.get(at + 12, int.from_bytes(head[10:12], "little"))
            if extra[:4] == b"sl\x08\0":
                self.end = at + int.from_bytes(extra[4:8], "little")
        self.inflate = zlib.decompressobj(31) if self.packed else None
        self.data, self.fed, self.done = b"", at, False

    def more(self, step: int) -> bool:
        """Some more data; False at the end of the record's member or file."""
        if self.done:
            return False
        if self.inflate is None:
            got = self.window.get(self.fed, step)
            self.fed += len(got)
            self.done = not got
            self.data += got
            return bool(got)
        rest = self.inflate.unconsumed_tail or self.window.get(self.fed, min(step, CHUNK))
        if not self.inflate.unconsumed_tail:
            self.fed += len(rest)
        if not rest:
            raise ValueError(f"the record at {self.at} is cut off")
        self.data += self.inflate.decompress(rest, 4 * step)
        if self.inflate.eof:
            self.fed -= len(self.inflate.unused_data)
            self.done = True
        return True

    def until(self, mark: bytes, begin: int = 0) -> int:
        """Where the mark ends, -1 if it never comes."""
        step = 1 << 10
        while (found := self.data.find(mark, begin)) < 0:
            if not self.more(step):
                return -1
            step = min(4 * step, CHUNK)
        return found + len(mark)

    def drop(self, n: int) -> None:
        self.data = self.data[n:]


def headers(lines: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with a space goes on with the one before."""
    unfolded = re.sub(rb"\r?\n[ \t]+", b" ", lines).decode("utf-8", "replace")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in unfolded.splitlines()[1:]) if name.strip()}


def heads_of(found: dict[str, str]) -> dict:
    row: dict = {c: found.get(h) for c, h in HEADER_OF.items()}
    for c in ("record_id", "refers_to"):
        if row[c] and row[c].startswith("<") and row[c].endswith(">"):
            row[c] = row[c][1:-1]
    row["content_length"] = int(row["content_length"])
    return row


def holds(test: ds.Filter, row: dict) -> bool | None:
    """Whether a row's header columns pass; None where SQL's answer is unknown."""
    if isinstance(test, ds.Not):
        inner = holds(test.child, row)
        return None if inner is None else not inner
    value = row[test.attribute[0]]
    if isinstance(test, ds.IsNull):
        return value is None
    if isinstance(test, ds.IsNotNull):
        return value is not None
    if isinstance(test, ds.EqualNullSafe):
        return value == test.value
    if value is None:
        return None
    if isinstance(test, ds.In):
        return value in test.value or (None if None in test.value else False)
    if test.value is None:
        return None
    return {
        ds.EqualTo: lambda: value == test.value,
        ds.GreaterThan: lambda: value > test.value,
        ds.GreaterThanOrEqual: lambda: value >= test.value,
        ds.LessThan: lambda: value < test.value,
        ds.LessThanOrEqual: lambda: value <= test.value,
        ds.StringStartsWith: lambda: value.startswith(test.value),
        ds.StringEndsWith: lambda: value.endswith(test.value),
        ds.StringContains: lambda: test.value in value,
    }[type(test)]()


def supported(test: ds.Filter) -> bool:
    if isinstance(test, ds.Not):
        return supported(test.child)
    simple = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
    return isinstance(test, simple) and len(test.attribute) == 1 and test.attribute[0] in HEADER_OF


def records(window: Window, begin: int, end: int, tests: list[ds.Filter], payload: str) -> Iterator[tuple]:
    """Header columns, length and digest of the payload and, if asked for, its bytes, of the records that begin here."""
    at = begin
    while at < end:
        stream = Stream(window, at)
        if (split := stream.until(b"\r\n\r\n")) < 0:
            if not stream.data.strip(b"\r\n"):
                return
            raise ValueError(f"no record at {at}")
        lines = stream.data[:split].lstrip(b"\r\n")
        if not lines.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        row = heads_of(headers(lines))
        stream.drop(split)
        length = row["content_length"]
        size = digest = body = None
        if all(holds(t, row) for t in tests):
            http = (row["content_type"] or "").startswith("application/http")
            split = max(0, stream.until(b"\r\n\r\n")) if http else 0
            size = length - split
            if http and row["record_type"] == "revisit":
                size = int(headers(stream.data[:split]).get("content-length", 0))
            elif payload != "none":
                sha, kept, left = hashlib.sha1(), [], size
                stream.drop(split)
                while left:
                    if not stream.data and not stream.more(CHUNK):
                        raise ValueError(f"the record at {at} is cut off")
                    part = stream.data[:left]
                    sha.update(part)
                    if payload == "bytes":
                        kept.append(part)
                    left -= len(part)
                    stream.drop(len(part))
                digest = base64.b32encode(sha.digest()).decode()
                body = b"".join(kept) if payload == "bytes" else None
            yield (*row.values(), size, digest, body)
        if not stream.packed:
            at += window_gap(window, at, lines, length)
        elif stream.end is not None:
            at = stream.end
        else:
            while not stream.done:
                stream.data = b""
                stream.more(CHUNK)
            at = stream.fed


def window_gap(window: Window, at: int, lines: bytes, length: int) -> int:
    """Bytes from the place of an uncompressed record, with any empty lines before it, to the next one."""
    lead = window.get(at, 64)
    return len(lead) - len(lead.lstrip(b"\r\n")) + len(lines) + length + 4


def first_member(window: Window, at: int) -> int:
    """The first member from here on that tells its length and holds the beginning of a record; the file's end if there is none."""
    mark = b"\x1f\x8b\x08\x04"
    while at < window.size:
        data = window.get(at, CHUNK)
        if (found := data.find(mark)) < 0:
            at += max(1, len(data) - 3)
            continue
        at += found
        stream = Stream(window, at)
        if stream.end is not None and stream.end <= window.size:
            try:
                stream.until(VERSION[:5])
                if stream.data.startswith(VERSION[:5]):
                    return at
            except (zlib.error, ValueError):
                pass
        at += 1
    return window.size


class WarcReader(ds.DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.split = int(options.get("splitBytes", 1 << 26))
        self.names = [f.name for f in schema.fields]
        self.tests: list[ds.Filter] = []

    def files(self) -> list[fs.FileInfo]:
        store, root = place(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [info]
        found = {x.base_name: x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.File}
        if manifests := [x for name, x in found.items() if name.startswith("_manifest-")]:
            listed = [name for x in manifests for name in json.loads(store.open_input_stream(x.path, compression=None).read())]
            return [found[name] for name in sorted(listed)]
        return [x for name, x in sorted(found.items()) if re.search(r"\.warc(\.gz)?$", name)]

    def partitions(self) -> list[ds.InputPartition]:
        """Lists of (path, begin, end): files of up to ``splitBytes`` together, larger ones in cuts."""
        out: list[list[tuple[str, int, int]]] = []
        room = 0
        for info in self.files():
            cuts = [(0, info.size)]
            if info.size > self.split and Stream(Window(place(self.path)[0], info.path), 0).end is not None:
                cuts = [(a, min(a + self.split, info.size)) for a in range(0, info.size, self.split)]
            for begin, end in cuts:
                if end - begin > room or not out:
                    out.append([])
                    room = self.split
                out[-1].append((info.path, begin, end))
                room -= end - begin
        return [ds.InputPartition(x) for x in out] or [ds.InputPartition([])]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if kind == "long" else pa.binary() if kind == "binary" else pa.string()) for c, kind in (x.split() for x in columns(self.payload).split(", "))])
        store, rows, size = place(self.path)[0], [], 0

        def batch() -> pa.RecordBatch:
            arrays = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema).select(self.names)

        for path, begin, end in partition.value:
            window = Window(store, path)
            for row in records(window, first_member(window, begin) if begin else 0, end, self.tests, self.payload):
                rows.append(row)
                size += len(row[-1] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class FilteringReader(WarcReader):
    """Takes predicates on header columns: the stated ones, or any.

    Spark keeps what a frame's first query has pushed for all later queries on the
    same frame, so by default only predicates that are part of the frame are taken.
    """

    def __init__(self, options, schema):
        super().__init__(options, schema)
        self.any = options.get("pushdown", "stated") == "any"
        self.stated: dict[str, list[str]] = json.loads(options.get("stated", "{}"))

    def takes(self, test: ds.Filter) -> bool:
        if self.any or not supported(test):
            return supported(test)
        values = self.stated.get(getattr(test, "attribute", ("",))[0])
        if values is None:
            return False
        return isinstance(test, ds.IsNotNull) or isinstance(test, ds.EqualTo) and values == [test.value] or isinstance(test, ds.In) and set(values) == set(test.value)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for test in filters:
            if self.takes(test):
                self.tests.append(test)
            else:
                yield test


def columns(payload: str) -> str:
    return {"bytes": f"{HEADS}, payload_bytes long, payload_sha1 string, payload binary", "digest": f"{HEADS}, payload_bytes long, payload_sha1 string", "none": f"{HEADS}, payload_bytes long"}[payload]


class WarcSource(ds.DataSource):
    """Options: path; for reads payload (bytes, digest, none), splitBytes, stated (JSON: values by column), pushdown (stated, any); for writes level, fileBytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return columns(self.options.get("payload", "bytes"))

    def reader(self, schema) -> WarcReader:
        pushes = self.options.get("pushdown") == "any" or self.options.get("stated", "{}") != "{}"
        return (FilteringReader if pushes else WarcReader)(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, [f.name for f in schema.fields], overwrite)


def read_archives(spark: SparkSession, path: str, payload: str = "bytes", where: dict[str, str | list[str]] | None = None, **options) -> DataFrame:
    """Records of a folder or file of archives, those with the values of ``where`` in header columns.

    With ``pushdown="any"`` all later predicates on header columns are pushed too; such
    a frame is for one query.  The session's switch for pushed predicates is turned on.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set(PUSHDOWN, "true")
    stated = {c: v if isinstance(v, list) else [v] for c, v in (where or {}).items()}
    df = spark.read.format("warc").options(payload=payload, stated=json.dumps(stated), **options).load(path)
    for c, values in stated.items():
        df = df.where(F.col(c).isin(values))
    return df


def write_archives(records: DataFrame, path: str, **options) -> None:
    """Add records (columns of ``WRITTEN``, all but the payload optional) to a folder of archives."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").options(**options).mode("append").save(path)


#: a payload of at least one in so many rows is hot; there can be no more such payloads than that
HOT = 1000


def with_first(pages: DataFrame, kept: str, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``first``: the smallest page_id of its payload, null if no other row has that payload.

    Payloads are told apart by SHA-256, and only those that occur twice or more are
    joined.  Hot ones, ``HOT`` at most, are broadcast; no other key holds more than a
    thousandth of the rows.  Payloads under ``least`` bytes are never shared.  The
    shared payloads are stored at ``kept``, which the result reads.
    """
    spark = pages.sparkSession
    keyed = pages.withColumn("_key", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    keyed.where("_key is not null").groupBy("_key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").write.parquet(kept)
    shared, total = spark.read.parquet(kept), pages.count()
    hot = shared.where(F.col("_n") * HOT >= total).select("_key", F.col("first").alias("_hot"), F.lit(True).alias("_found"))
    rare = shared.where(F.col("_n") * HOT < total).select(F.col("_key").alias("_probe"), F.col("first").alias("_rare"))
    # rows that have their answer, or no key, are dealt out evenly
    spread = F.concat(F.lit("~"), F.pmod(F.monotonically_increasing_id(), F.lit(8192)).cast("string"))
    rows = keyed.join(F.broadcast(hot), "_key", "left").withColumn("_probe", F.when(F.col("_found") | F.col("_key").isNull(), spread).otherwise(F.col("_key")))
    return rows.join(rare, "_probe", "left").select("page_id", "url", "html", F.coalesce("_hot", "_rare").alias("first"))


RECORD = "urn:page:"


def archive(pages: DataFrame, path: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html", **options) -> None:
    """Write a response or revisit record for every page.

    A null text is an empty payload.  Of rows with one payload of at least ``least``
    bytes, those with the smallest id are responses (rows that repeat an id too), and
    so are all if every id is null; the others, null ids among them, revisit it.
    """
    spark = pages.sparkSession
    small_batches(spark)
    kept = folder(spark, "payloads")
    rows = with_first(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")), kept, least)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(RECORD), F.col(c).cast("string"))
    write_archives(
        rows.select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            urn("page_id").alias("record_id"),
            F.col("url").alias("target_uri"),
            F.when(revisit, urn("first")).alias("refers_to"),
            F.encode("html", "UTF-8").alias("payload"),
        ),
        path,
        **options,
    )
    discard(spark, kept)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of an archive: responses by their payload, revisits by their headers alone."""
    number = lambda c: F.substring_index(F.col(c), ":", -1).cast("long")
    responses = read_archives(spark, path, "digest", {"record_type": "response"})
    revisits = read_archives(spark, path, "none", {"record_type": "revisit"}).withColumn("payload_sha1", F.substring_index("payload_digest", ":", -1))
    read = [
        df.select(number("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
        for df in (responses, revisits)
    ]
    return read[0].unionByName(read[1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = folder(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return archived_pages(spark, path)


ORACLE_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), keyed AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM payloads
), marked AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM keyed
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM marked
"""
