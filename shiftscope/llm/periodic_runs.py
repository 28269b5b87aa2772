"""Maximal runs of repeated word sequences: aligned power-of-two blocks, found again by an automaton, extended exactly.

A run is a stretch of words with smallest period q, at least ``LEAST_POWER`` q and
``LEAST_LENGTH`` words long, that no neighbouring word extends.  With
B <= q < 2 B for a power of two B, a run of 4 q words holds an aligned block of B
words that comes again q and 2 q words later.  So for each B the document is
searched for all aligned blocks with an Aho-Corasick automaton, and occurrences at
a distance from B to 2 B - 1 are seeds.  Its keys are sequences of integers: the
numbers of a block's halves, found by the search before.  (Keys of whole blocks
would be right too, but in repetitive texts the automaton walks down all suffixes
of a block at every word.)  Each seed is extended to both sides as far as words at
its distance agree; of several seeds in one stretch the first is extended.

In a run every word but the last q has its next occurrence at most q words on.
Only around blocks all of whose words come again within 2 B words is anything
searched; most prose has none.

Defined cases: a null or empty text has no words and no runs; a null id alters no
text; equal rows give equal rows; of equally long runs the earliest counts, then
that of the least period; a long text is searched whole, in memory in proportion
to its words; extra columns are ignored whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.llm.common import byte_rows, documents

LEAST_POWER, LEAST_LENGTH = 4, 6
_HIT = np.dtype((np.int64, 2))
Run = tuple[int, int, int]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Words numbered in order of their first appearance."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def next_distance(ids: np.ndarray) -> np.ndarray:
    """Words from each word to its next occurrence; the number of words where there is none."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    out = np.full(n, n, dtype=np.int64)
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out[order[same]] = order[same + 1] - order[same]
    return out


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two arrays of one length."""
    at, step = 0, 64
    while at < len(a):
        unlike = a[at : at + step] != b[at : at + step]
        if (first := int(unlike.argmax())) or unlike[0]:
            return at + first
        at, step = at + step, 4 * step
    return len(a)


def extended(ids: np.ndarray, at: int, distance: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``distance`` apart agree: its first word and its end."""
    right = _agreeing(ids[at : len(ids) - distance], ids[at + distance :])
    left = _agreeing(ids[:at][::-1], ids[distance : at + distance][::-1])
    return at - left, at + distance + right


def primitive(unit: np.ndarray) -> bool:
    """Whether no shorter sequence, repeated, gives this one."""
    n, rest, factor = len(unit), len(unit), 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        if np.array_equal(unit[: n - n // factor], unit[n // factor :]):
            return False
        while rest % factor == 0:
            rest //= factor
    return True


def candidates(near: np.ndarray) -> dict[int, np.ndarray]:
    """Starts of the aligned blocks of each size all of whose words come again within twice the size."""
    n, out, block = len(near), {}, 1
    while LEAST_POWER * block <= n:
        full = n // block
        starts = np.flatnonzero((near[: full * block] < 2 * block).reshape(full, block).all(1)) * block
        if len(starts := starts[starts + 3 * block <= n]):
            out[block] = starts
        block *= 2
    return out


def stretches(blocks: dict[int, np.ndarray], n: int) -> list[tuple[int, int]]:
    """What lies within six sizes of the blocks' starts, as disjoint stretches."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for block, starts in blocks.items():
        np.add.at(edges, starts, 1)
        np.add.at(edges, np.minimum(starts + 6 * block, n), -1)
    inside = np.concatenate([[False], np.cumsum(edges[:n]) > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True))


def doubled(names: np.ndarray, first: int, block: int) -> np.ndarray:
    """Numbers of the aligned blocks of this size wherever their words stand, -1 elsewhere; ``names`` has those of half the size.

    The first aligned block starts at ``first``.  A key of the automaton is the pair
    of a block's halves; the words are searched once for each residue of half the size.
    """
    half, n = block // 2, len(names)
    starts = np.arange(first, n - block + 1, block)
    out = np.full(n, -1, dtype=np.int64)
    pairs = np.unique(np.stack([names[starts], names[starts + half]], axis=1), axis=0) + 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, pair in enumerate(pairs.tolist()):
        automaton.add_word(tuple(pair), number)
    if not len(pairs):
        return out
    automaton.make_automaton()
    rows = -(-n // half)
    padded = np.zeros((rows + 1) * half, dtype=np.int64)  # zeros are in no key and part the residues
    padded[:n] = names + 1
    walk = tuple(padded.reshape(rows + 1, half).T.ravel().tolist())
    end, number = np.fromiter(automaton.iter(walk), dtype=_HIT).T
    out[(end % (rows + 1) - 1) * half + end // (rows + 1)] = number
    return out


def _seeds(names: np.ndarray, block: int, starts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances from ``block`` to 2 ``block`` - 1 at which the block comes again, twice at least.

    ``names`` begins at the word ``base``.  Three distances from the start on, words a
    distance apart must agree as far as their blocks have numbers.
    """
    known = np.zeros(len(names) // block + 3, dtype=bool)
    shift = -base % block
    known[(starts - base - shift) // block] = True
    at = np.flatnonzero(names >= 0)
    behind = (at - block - shift) // block  # the one aligned block that starts one to two sizes before
    good = (at >= block + shift) & known[behind]
    at, behind = at[good], behind[good] * block + shift
    distance = at - behind
    good = (names[behind] == names[at]) & (behind + 3 * distance <= len(names))
    behind, distance = behind[good], distance[good]
    good = np.ones(len(behind), dtype=bool)
    for at in (behind + block, behind + distance, behind + 2 * distance - block):
        good &= names[at] == names[at + distance]
    return behind[good] + base, distance[good]


def runs(ids: np.ndarray) -> list[Run]:
    """Start, length and period of every run, by start, then period."""
    n = len(ids)
    if n < LEAST_LENGTH or not (blocks := candidates(next_distance(ids))):
        return []
    found: set[Run] = set()
    cover = np.zeros(n, dtype=np.int64)  # the furthest end of a known stretch that starts at a word
    for base, stop in stretches(blocks, n):
        names, block = ids[base:stop], 1
        own = {b: s[(s >= base) & (s < stop)] for b, s in blocks.items()}
        largest = max((b for b, s in own.items() if len(s)), default=0)
        while True:
            if len(own.get(block, ())):
                starts, distances = _seeds(names, block, own[block], base)
                # what lies in a stretch of a period up to the block's size only repeats that period
                hidden = np.maximum.accumulate(cover)[starts] >= starts + distances + block
                starts, distances = starts[~hidden], distances[~hidden]
                order = np.lexsort((starts, distances))
                last, end = 0, 0
                for start, distance in zip(starts[order].tolist(), distances[order].tolist(), strict=True):
                    if distance == last and start + distance + block <= end:
                        continue
                    begin, end = extended(ids, start, distance)
                    last = distance
                    cover[begin] = max(cover[begin], end)
                    if end - begin >= max(LEAST_LENGTH, LEAST_POWER * distance) and primitive(ids[begin : begin + distance]):
                        found.add((begin, end - begin, distance))
            block *= 2
            if block > largest:
                break
            names = doubled(names, -base % block, block)
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def altered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the test's repetition: from word a on, those of a tenth of all ids repeat with period p."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[: n - a]


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string()]


def summary(words: list[bytes]) -> tuple:
    """Number of runs, the longest one with its exponent, and digests of all runs and of the words that stay."""
    found = runs(word_numbers(words))
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    if not found:
        return 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]))
    kept = kept_words(len(words), found)
    digest = hashlib.sha256(b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)).hexdigest()
    return len(found), start, length, period, 1000 * length // period, listed, digest


def collapsed(docs: DataFrame) -> DataFrame:
    """``text`` with single spaces and each run cut to its first period, and the runs as (start, length, period)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))])
        for batch in batches:
            texts, spans = [], []
            for text in byte_rows(batch.column(1)):
                words = text.split() if text else []
                found = runs(word_numbers(words))
                kept = kept_words(len(words), found).tolist()
                texts.append(None if text is None else b" ".join(w for w, k in zip(words, kept, strict=True) if k).decode())
                spans.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate((texts, spans)))], schema=schema)

    return _rows(docs).mapInArrow(run, "doc_id long, text string, runs array<struct<start: long, length: long, period: long>>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def repeated_runs(docs: DataFrame, change=None) -> DataFrame:
    """The runs of each text, after ``change`` of its words by its id if given, in a row of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                words = text.split() if text else []
                rows.append(summary(change(doc_id, words) if change else words))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=names)

    return _rows(docs).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, a tenth of which get a repetition."""
    return repeated_runs(documents(spark, sf_dir), altered)
