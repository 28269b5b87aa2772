"""Operator 6: best-fit decreasing packing of tokenized documents.

Best-fit decreasing depends on the lengths alone, and there are at most
``capacity`` different ones.  So the corpus is reduced to its length histogram,
the driver packs the histogram exactly as best-fit decreasing would pack the
single documents, and the resulting plan is applied to the rows where they are.

The packer keeps bins in runs of consecutive bin numbers with equal room left.
A segment tree over the remaining capacities finds the tightest one that takes
a length in logarithmic time.  A run shrinks by the lengths put in it, so it is
met by at most sqrt(2 * capacity) different lengths, and each length splits at
most two runs: the plan has fewer than 400,000 rows for 2048 tokens, whatever
the input, which is why it may be broadcast.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shiftscope.llm.common import documents, durable, fresh
from shiftscope.llm.textops import SECOND, HashIndex, distinct_pairs, span_hashes

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: pretokens that an encoder remembers before it starts afresh
MEMO = 250_000


class CapacityTree:
    """Segment tree over capacities 0..n that finds the least marked one not under a bound."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.marked = bytearray(2 * self.leaves)

    def mark(self, capacity: int, on: bool) -> None:
        i = capacity + self.leaves
        self.marked[i] = on
        while i > 1:
            i >>= 1
            both = self.marked[2 * i] or self.marked[2 * i + 1]
            if self.marked[i] == both:
                return
            self.marked[i] = both

    def tightest(self, need: int) -> int | None:
        """Least marked capacity >= need."""
        i = need + self.leaves
        if self.marked[i]:
            return need
        while i > 1:  # climb until a right sibling holds a mark, then go down its left edge
            if not i & 1 and self.marked[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.marked[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram.

    Returns moves (length, first rank, items per bin, first bin, offset): items
    of that length from that rank on fill consecutive bins from ``first bin``,
    each taking ``items per bin``, from ``offset`` on.  Items of a length are
    ranked from 0 and a move ends where the next one of its length begins.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    moves: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if not runs.setdefault(room, []):
                tree.mark(room, True)
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, bins
                each = capacity // length
                count = -(-left // each)
                bins += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.mark(room, False)
                each = room // length
            full = min(count, left // each)
            if full:
                moves.append((length, rank, each, first, capacity - room))
                put(room - full_length if (full_length := each * length) < room else 0, first, full)
                rank, left = rank + full * each, left - full * each
                first, count = first + full, count - full
            if left and count:  # fewer items than one bin takes
                moves.append((length, rank, left, first, capacity - room))
                rest = room - left * length
                first, count, left = first + 1, count - 1, 0
                put(rest, first - 1, 1)
            if count:
                put(room, first, count)
    return moves


#: The vocabulary's splitter for lower-case text of ASCII (but ' and <) and Latin-1 letters.
PLAIN = re.compile("[ \\t\\n\\r\\x0b\\x0c!-&(-;=-~À-ÖØ-öø-ÿ]*")
PRETOKEN = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


#: kinds of bytes in plain lower-case text: 0 white space, 1 letters, 2 digits (each alone), 3 the rest
KINDS = np.full(256, 3, dtype=np.int8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[48:58] = 2
KINDS[97:123] = KINDS[128:] = 1


def _byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, with a bounded memo of what the splitter yields.

    The vocabulary's normalizer and splitter never join text across ASCII white
    space, so a text's ids are those of its chunks one after another.  Plain
    texts are split here as the vocabulary's rule says: the pretokens' spans
    and 128-bit hashes are computed for a whole group of texts at once and
    looked up.  Any other chunk goes through the whole tokenizer.
    """

    def __init__(self, name: str = TOKENIZER, memo: int = MEMO):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.limit = memo
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex(2 * self.limit)
        self.ends = np.zeros(1025, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)

    def _pretoken(self, key: str) -> list[int]:
        if not key.isascii():
            key = "".join(self.alphabet[b] for b in key.encode())
        return [t.id for t in self.model.tokenize(key)]

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, keys: list[str]) -> None:
        found = [self._pretoken(k) for k in keys]
        known = self.index.known
        n = known + len(keys)
        while n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[known + 1 : n + 1] = self.ends[known] + np.cumsum([len(x) for x in found])
        while self.ends[n] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.ends[known] : self.ends[n]] = [i for x in found for i in x]
        self.index.add(hashes, checks)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        kinds = KINDS[data]
        edge = np.empty(len(data), dtype=bool)
        edge[:1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:])
        edge |= kinds == 2
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        inside = kinds[starts] != 0
        starts, ends = starts[inside], ends[inside]
        bounds = np.cumsum([0, *(len(t) + 1 for t in raw)])
        hashes, checks = span_hashes(data, starts, ends), span_hashes(data, starts, ends, SECOND)
        at = self.index.get(hashes, checks)
        if (missing := np.flatnonzero(at < 0)).size:
            where = missing[distinct_pairs(hashes[missing], checks[missing])]
            if self.index.known + len(where) > self.limit and self.index.known:
                self.clear()
                return self._plain(texts)
            if self.index.known + len(where) > 2 * self.limit:  # one group that no memo holds
                return [x for t in texts for x in self._plain([t])] if len(texts) > 1 else [self._chunks(texts[0])]
            self._learn(hashes[where], checks[where], [data[s:e].tobytes().decode() for s, e in zip(starts[where], ends[where], strict=True)])
            at[missing] = self.index.get(hashes[missing], checks[missing])
        begins = self.ends[at]
        lengths = self.ends[at + 1] - begins
        sums = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(lengths, out=sums[1:])
        ids = self.flat[np.arange(sums[-1]) + np.repeat(begins - sums[:-1], lengths)]
        cuts = sums[np.searchsorted(starts, bounds)]
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _chunks(self, text: str) -> np.ndarray:
        """Ids of any text, chunk by chunk."""
        out: list[int] = []
        for chunk in re.split("[ \t\n\r\x0b\x0c]+", text):
            if PLAIN.fullmatch(chunk):
                for key in PRETOKEN.findall(chunk.lower()):
                    out += self._pretoken(key)
            else:
                out += self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(out, dtype=np.uint32)

    def encode_batch(self, texts: list[str], group: int = 1 << 20) -> Iterator[np.ndarray]:
        waiting: list[str] = []
        size = 0
        for text in texts:
            plain = bool(PLAIN.fullmatch(text))
            if waiting and (not plain or size > group):
                yield from self._plain(waiting)
                waiting, size = [], 0
            if plain:
                waiting.append(text)
                size += len(text)
            else:
                yield self._chunks(text)
        if waiting:
            yield from self._plain(waiting)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_batch([text]))


@functools.lru_cache(maxsize=1)
def _encoder() -> Encoder:
    """The tokenizer, held by a worker from task to task; its memo is bounded and changes no result."""
    return Encoder()


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder()
    for batch in batches:
        doc, piece, start, length, crc = [], [], [], [], []
        texts = (t or "" for t in batch.column(1).to_pylist())
        for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode_batch(texts), strict=True):
            ids = np.append(found, np.uint32(0)).astype("<u4")
            for k, i in enumerate(range(0, len(ids), capacity)):
                part = ids[i : i + capacity]
                doc.append(doc_id)
                piece.append(k)
                start.append(i)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize every document, end it with id 0 and cut those over the capacity."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(lambda it: _cut(it, capacity), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Best-fit decreasing over rows with a ``length`` of 1..capacity.

    Adds sequence_id (gapless from 0) and offset.  ``pieces`` is read several
    times, so it must be a durable table, whose partitions stay as they are.  Rows
    of one length are ranked partition by partition, so neither a length nor a
    row that a third of all rows share meets in one task.
    """
    spark = pieces.sparkSession
    keys = [c for c in pieces.columns if c != "length"]
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = sorted(plan_bins(histogram, capacity))
    bucket, count, before, row, place = fresh(pieces, "_bucket", "_n", "_ahead", "_row", "_rank")
    rows = pieces.withColumn(bucket, F.spark_partition_id())
    ahead = W.partitionBy("length").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(count))
    offsets = offsets.select("length", bucket, F.coalesce(F.sum(count).over(ahead), F.lit(0)).alias(before))
    ranked = rows.withColumn(row, F.row_number().over(W.partitionBy("length", bucket).orderBy(*keys)))
    ranked = ranked.join(offsets, ["length", bucket]).withColumn(place, F.col(before) + F.col(row) - 1)
    table = np.array(moves, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, each, first, offset = shared.value.T
        at = (length << 44) + rank
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", place))
            k = np.searchsorted(at, (n << 44) + r, side="right") - 1
            beyond = r - rank[k]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[k] + beyond // each[k]), pa.array(offset[k] + beyond % each[k] * n)], names=[*columns, "sequence_id", "offset"])

    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*columns, place).mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their sequence and place in it.

    A null text counts as empty: one piece that holds id 0 alone.  A null
    doc_id is kept.  Repeated rows are packed each for itself.  Ties: pieces of
    one length are interchangeable, and the bin that was closed last among those
    with equal room is filled first.  Very long texts are tokenized whole and cut.
    An empty table gives an empty result.  Other columns are not read.
    """
    return pack(durable(cut_pieces(docs, capacity)), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
