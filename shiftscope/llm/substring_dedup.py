"""Operator 9: substring deduplication with a compressed FM-index per shard.

Every word covered by a run of 35 words that starts anywhere else too, in
another document or in the same one, is removed.

Sharding by content keeps equal runs together: a window of 35 words has as its
anchor the eight-word run with the least hash (the leftmost one on ties), so
equal windows have equal anchors.  The windows of one text with the same anchor
place are consecutive and form a segment of at most 62 words.  Segments whose
anchor occurs once in the corpus cannot repeat and go no further.  Equal
segments are one, with a weight, and one text supplies its words.  Each shard
holds the segments of some anchors in an FM-index (suffix order, wavelet matrix
over the Burrows-Wheeler transform, block ranks), and the segments are streamed
against it: backward search gives the matching statistics, and windows whose
match of 35 words has a weight of two or more are reported.

Texts are known by a 64-bit hash, so copies of a text share all work; segments
are one where two hashes agree, that of their words and that of their anchor.

An anchor that ``HOT`` or more segments share (on a list of fixed length, counted
over all documents) would bring them all into one shard, such as a line that stands
in many documents between ever different words.  Its windows are segments of their
own with the hash of all 35 words as anchor: the border windows, which differ from
document to document, then occur once and go no further, and what does repeat
spreads over all shards.  A window that repeats within a task's slab is known to
repeat; its rows are dealt out by text, and only a mark goes to the window's group.

Nulls: a null text has no words; a null doc_id is kept.  Repeated rows are
documents of their own, so all windows of a repeated text repeat.  Texts under
35 words stay whole; very long ones are cut by windows like any other.  Ties: the
leftmost of equal anchors in a window.  An empty table gives an empty result.  Extra
columns are not read; ``deduplicated`` keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import SIEVE_BITS, byte_rows, documents, durable, group_count, in_sieve, most_frequent, sieve, sifted, small_batches, text_groups, to_blob
from shiftscope.llm.fm_index import FMIndex
from shiftscope.llm.textops import U, distinct_pairs, hash_words, mix, ngram_hashes, radix_split, run_hashes, split_words

WINDOW, ANCHOR = 35, 8
#: the list of common anchors: its length, the count within one slab from which an anchor is reported, and the share of all others that is
COMMON, LOCAL, SAMPLED = 1 << 18, 8, 256
#: anchors that so many segments share have each window for itself
HOT = 1024
SLAB = 1 << 17
SEGMENTS_EACH = 4000

NONE = np.zeros((2, 0), dtype=U)


def segments(words: np.ndarray, first: np.ndarray, common: np.ndarray = NONE) -> np.ndarray:
    """Segments of all texts, columns: text, first window, windows, anchor hash, hash of the words, shard key."""
    spans = WINDOW - ANCHOR + 1
    grams = ngram_hashes(words, ANCHOR)
    if len(grams) < spans:
        return np.zeros((0, 6), dtype=U)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(owner[WINDOW - 1 :] == owner[: len(words) - WINDOW + 1])
    views = np.lib.stride_tricks.sliding_window_view(grams, spans)
    place = np.empty(len(start), dtype=np.int64)
    for i in range(0, len(start), 1 << 15):
        place[i : i + (1 << 15)] = views[start[i : i + (1 << 15)]].argmin(axis=1)
    place += start
    hot = _hot(grams[place], common)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[start[1:]] != owner[start[:-1]]) | hot[1:]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    begin = start[head]
    end = begin + count + WINDOW - 1
    content = run_hashes(words, begin, end)
    anchor = grams[place[head]]
    # the second hash of a window on its own is made of other runs of its words
    key = np.where(hot[head], mix(content + mix(anchor)), anchor)
    text = owner[begin]
    return np.stack([text.astype(U), (begin - first[text]).astype(U), count.astype(U), anchor, content, key], axis=1)


def _hot(anchors: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which anchors are on the list."""
    if not common.shape[1]:
        return np.zeros(len(anchors), dtype=bool)
    at = np.minimum(np.searchsorted(common[0], anchors), common.shape[1] - 1)
    return common[0][at] == anchors


def _texts(docs: DataFrame) -> DataFrame:
    """(id, text) of all texts, the id being a hash of the text."""
    return docs.select(F.xxhash64("text").alias("id"), "text").where("text is not null")


def _slabs(batches: Iterator[pa.RecordBatch], common: np.ndarray = NONE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of distinct texts in slabs: text ids, their counts in the slab, and segments."""
    numbers: dict[int, int] = {}
    counts: list[int] = []
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), byte_rows(batch.column(1))
        for i, j in text_groups(texts):
            fresh = []
            for k in range(i, j):
                at = numbers.setdefault(ids[k], len(counts))
                if at == len(counts):
                    counts.append(1)
                    fresh.append(k)
                else:
                    counts[at] += 1
            if fresh:
                found = segments(*hash_words([texts[k] for k in fresh]), common)
                found[:, 0] += U(len(counts) - len(fresh))
                held.append(found)
                rows += len(found)
            if rows > SLAB:
                yield np.array(list(numbers), dtype=np.int64), np.array(counts, dtype=np.int64), np.concatenate(held)
                numbers, counts, held, rows = {}, [], [], 0
    if held:
        yield np.array(list(numbers), dtype=np.int64), np.array(counts, dtype=np.int64), np.concatenate(held)


def _common(texts: DataFrame) -> np.ndarray:
    """The anchors that ``HOT`` or more segments share and their counts, by anchor: at most ``COMMON`` of them, the most common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _slabs(batches):
            values, counts = np.unique(found[:, 3], return_counts=True)
            often = counts >= LOCAL
            # an anchor that is spread thin over all slabs is met in a sample of places, each standing for SAMPLED
            place = mix(ids[found[:, 0].astype(np.int64)].view(U) + mix(found[:, 1])) % U(SAMPLED) == 0
            thin = found[place, 3]
            thin = thin[~often[np.searchsorted(values, thin)]]
            anchors = np.concatenate([values[often], thin])
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(np.concatenate([counts[often], np.full(len(thin), SAMPLED)]))], names=["anchor", "n"])

    counted = texts.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return most_frequent(counted.where(F.col("n") >= HOT), "anchor", COMMON)


OCCURRENCES = "content long, key long, id long, begin int, windows int, copies long"
KNOWN, MARK = U(1 << 16), U(1 << 17)


def _occurrences(texts: DataFrame, common, groups: int) -> DataFrame:
    """Segments whose key occurs twice or more, by text; ``copies``: equal texts seen by the task."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, found in _slabs(batches, common.value):
            text = found[:, 0].astype(np.int64)
            own, copies, key = ids[text].view(U), counts[text].astype(U), found[:, 5]
            keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            twice = np.bincount(inverse, weights=copies, minlength=len(keys)) >= 2
            known = twice[inverse]
            place = found[:, 1] << U(32) | known.astype(U) * KNOWN | found[:, 2]
            rows = np.stack([key, found[:, 4], own, place, copies])
            marks = np.stack([keys, found[first, 4], own[first], np.full(len(keys), MARK, dtype=U), np.full(len(keys), 2, dtype=U)])[:, twice]
            packed = np.concatenate([rows, marks], axis=1)
            order, cuts = radix_split(mix(np.concatenate([np.where(known, mix(own + place), key), marks[0]])), groups)
            packed = packed[:, order]
            used = np.flatnonzero(np.diff(cuts))
            blobs = [to_blob(packed[:, cuts[g] : cuts[g + 1]]) for g in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["grp", "blob"])

    def repeated(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b, dtype=U).reshape(5, -1) for b in table.column("blob").to_pylist()], axis=1)
        rows = rows[:, np.argsort(rows[0], kind="stable")]
        begin = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
        total = np.add.reduceat(rows[4], begin)
        again = np.repeat(total >= 2, np.diff(np.append(begin, rows.shape[1]))) | (rows[3] & KNOWN > 0)
        key, content, own, place, copies = (x[again & (rows[3] & MARK == 0)] for x in rows)
        return pa.table(
            {
                "content": pa.array(content.view(np.int64)),
                "key": pa.array(key.view(np.int64)),
                "id": pa.array(own.view(np.int64)),
                "begin": pa.array((place >> U(32)).astype(np.int32)),
                "windows": pa.array((place & U(0xFFFF)).astype(np.int32)),
                "copies": pa.array(copies.astype(np.int64)),
            }
        )

    return texts.mapInArrow(post, "grp int, blob binary").groupBy("grp").applyInArrow(repeated, OCCURRENCES)


def report(weights: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each segment of a shard a mask of its windows that occur with a weight of two or more."""
    begins = np.cumsum(lengths) - lengths
    names, numbers = np.unique(words, return_inverse=True)
    text = np.zeros(len(words) + len(lengths), dtype=np.int64)  # symbol 0 ends each segment
    owner = np.repeat(np.arange(len(lengths)), lengths)
    text[np.arange(len(words)) + owner] = numbers + 1
    begins = begins + np.arange(len(lengths))
    ends = begins + lengths
    weight = np.repeat(weights, lengths + 1)
    index = FMIndex(text, len(names) + 1, weight, int(lengths.max()))
    windows = lengths - WINDOW + 1
    # a segment that repeats as a whole needs one search; of the others every window's end is searched
    whole = index.matching(text, ends, lengths, 2)
    mask = np.where(whole == lengths, (1 << windows) - 1, 0)
    rest = np.flatnonzero(whole < lengths)
    lane = np.repeat(rest, windows[rest])
    number = np.arange(len(lane)) - np.repeat(np.cumsum(windows[rest]) - windows[rest], windows[rest])
    found = index.matching(text, begins[lane] + number + WINDOW, np.full(len(lane), WINDOW), 2) == WINDOW
    np.add.at(mask, lane[found], 1 << number[found])
    return mask


def _masks(texts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(content, key, mask) of every distinct segment with a window that repeats."""
    distinct = occurrences.groupBy("content", "key").agg(F.sum("copies").alias("weight"), F.min(F.struct("id", "begin", "windows")).alias("rep"))
    wanted = durable(distinct.groupBy(F.col("rep.id").alias("id")).agg(
        F.collect_list("content").alias("content"),
        F.collect_list("weight").alias("weight"),
        F.collect_list("rep.begin").alias("begin"),
        F.collect_list("rep.windows").alias("windows"),
        F.collect_list("key").alias("key"),
    ))
    shards = max(16, -(-(wanted.agg(F.sum(F.size("content")).alias("n")).collect()[0]["n"] or 0) // SEGMENTS_EACH))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_rows(batch.column("text"))
            lists = {c: batch.column(c).to_pylist() for c in ("content", "weight", "begin", "windows", "key")}
            for i, j in text_groups(texts):
                words, first = hash_words(texts[i:j])
                sizes = [len(lists["content"][k]) for k in range(i, j)]
                flat = {c: np.array([v for k in range(i, j) for v in x[k]], dtype=np.int64) for c, x in lists.items()}
                begin = np.repeat(first[:-1], sizes) + flat["begin"]
                length = flat["windows"] + WINDOW - 1
                order, cuts = radix_split(mix(flat["key"].view(U)), shards)
                meta = np.stack([flat["content"], flat["key"], flat["weight"], length], axis=1)
                used = np.flatnonzero(np.diff(cuts))
                bodies = []
                for s in used:
                    own = order[cuts[s] : cuts[s + 1]]
                    at = np.arange(length[own].sum()) + np.repeat(begin[own] - np.cumsum(length[own]) + length[own], length[own])
                    bodies.append((to_blob(meta[own]), to_blob(words[at])))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([m for m, _ in bodies], pa.binary()), pa.array([w for _, w in bodies], pa.binary())], names=["shard", "meta", "words"])

    def search(table: pa.Table) -> pa.Table:
        meta = np.concatenate([np.frombuffer(b, dtype=np.int64).reshape(-1, 4) for b in table.column("meta").to_pylist()])
        words = np.concatenate([np.frombuffer(b, dtype=U) for b in table.column("words").to_pylist()])
        # a text that several tasks have passed on brings its segments again
        kept = np.sort(distinct_pairs(meta[:, 0].astype(U), meta[:, 1].astype(U)))
        begins = np.cumsum(meta[:, 3]) - meta[:, 3]
        length = meta[kept, 3]
        at = np.arange(length.sum()) + np.repeat(begins[kept] - np.cumsum(length) + length, length)
        mask = report(meta[kept, 2], length, words[at])
        some = mask > 0
        return pa.table({"content": pa.array(meta[kept, 0][some]), "key": pa.array(meta[kept, 1][some]), "mask": pa.array(mask[some])})

    held = sifted(texts, wanted, once=True).select("text", "content", "weight", "begin", "windows", "key")
    shipped = held.mapInArrow(ship, "shard int, meta binary, words binary")
    return shipped.groupBy("shard").applyInArrow(search, "content long, key long, mask long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(id, begin, mask): for each text with a repeated window, its segments' first windows and masks, as lists."""
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    common = context.broadcast(_common(texts))  # at most COMMON pairs of numbers, 4 MB
    occurrences = durable(_occurrences(texts, common, group_count(docs, 4000)))
    found = occurrences.select("content", "key", "id", "begin").join(_masks(texts, occurrences), ["content", "key"])
    per = found.groupBy("id").agg(F.collect_set(F.struct("begin", "mask")).alias("found"))
    return durable(per.select("id", F.col("found.begin").alias("begin"), F.col("found.mask").alias("mask")))


def covered_words(count: int, begin: list[int] | None, mask: list[int] | None) -> np.ndarray:
    """Which of a text's words a reported window covers."""
    steps = np.zeros(count + 1, dtype=np.int64)
    for b, m in zip(begin or (), mask or (), strict=True):
        while m:
            s = b + (m & -m).bit_length() - 1
            if s + WINDOW <= count:
                steps[s] += 1
                steps[s + WINDOW] -= 1
            m &= m - 1
    return np.cumsum(steps[:-1]) > 0


def without_words(text: bytes, begin: list[int] | None, mask: list[int] | None) -> bytes:
    """The text without its covered words; what stands between kept words stays as it was."""
    data, starts, ends, _ = split_words([text])
    gone = covered_words(len(starts), begin, mask)
    if not gone.any():
        return text
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    return b"".join([*out, text[at:]])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digests(doc_ids: pa.Array, texts: list[bytes | None], begins: list, masks: list) -> pa.RecordBatch:
    words, removed, digest = [], [], []
    for text, begin, mask in zip(texts, begins, masks, strict=True):
        found = (text or b"").split()
        gone = covered_words(len(found), begin, mask) if begin else None
        kept = found if gone is None else [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
        words.append(len(found))
        removed.append(len(found) - len(kept))
        digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])


def _parted(docs: DataFrame, found: DataFrame, schema: str, finish) -> tuple[DataFrame, DataFrame]:
    """``docs`` split by a bitmap of the found texts: what ``finish`` makes of batches that surely have no window, and the other rows, columns by place, with begin and mask after them."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve(found, "id"))
    width = len(docs.columns)

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = in_sieve(bits.value, batch.column(width + 1).to_numpy())
            kept = batch.filter(pa.array(~held)).columns[:width]
            yield finish(pa.RecordBatch.from_arrays(kept, names=names))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = in_sieve(bits.value, batch.column(width + 1).to_numpy())
            yield batch.filter(pa.array(held)).select(list(range(width + 1)))

    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(width)))  # a caller's names cannot clash with those added here
    at = names.index("text")
    rows = plain.withColumn("_id", F.xxhash64(f"c{at}"))
    rows = rows.withColumn("_bit", F.pmod(F.xxhash64("_id"), F.lit(SIEVE_BITS)))
    inner = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    lists = found.select(F.col("id").alias("_id"), F.col("begin").alias("_begin"), F.col("mask").alias("_mask"))
    return rows.mapInArrow(free, schema), rows.mapInArrow(touched, f"{inner}, _id long").join(lists, "_id", "left").drop("_id")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = [None] * batch.num_rows
        return _digests(batch.column(0), byte_rows(batch.column(1)), none, none)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digests(batch.column(0), byte_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())

    free, touched = _parted(rows, repeated_windows(docs), RESULT, plain)
    return free.unionByName(touched.mapInArrow(cut, RESULT))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered words taken out of ``text`` and ``n_chars`` counted anew; all columns kept."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    free, touched = _parted(docs, repeated_windows(docs), own, lambda batch: batch)
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    width, docs_names = len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, masks = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            texts = [None if t is None else without_words(t, b, m).decode("utf-8", "replace") for t, b, m in zip(byte_rows(batch.column(at)), begins, masks, strict=True)]
            columns = list(batch.columns[:width])
            columns[at] = pa.array(texts, pa.string())
            if counted >= 0:
                old = batch.column(counted).to_pylist()
                columns[counted] = pa.array([n if not b or t is None else len(t) for n, b, t in zip(old, begins, texts, strict=True)], batch.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    return free.unionByName(touched.mapInArrow(run, own))


def query(spark, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))
