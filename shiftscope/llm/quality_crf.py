"""Operator 1: line sequence labelling with a linear-chain conditional random field.

A document is the sequence of its lines that hold a word.  Each line has a short
vector of shape features (symbols, digits, capitals, word lengths, bars,
repeats, place); the field has two states, content and boilerplate, linear
state scores and a transition matrix.  It is trained in numpy by the gradient of
the conditional likelihood (forward-backward), on documents with a quality
label: lines of good documents are content, lines of bad ones start as
boilerplate and are relabelled by Viterbi decoding after each round, so that
the ordinary lines of a bad document stop counting against it.  Viterbi decoding
then marks every line of every document, and the share of words on content
lines decides retention.

Bounds of the fit: ``FIT_DOCS`` labelled documents of each class in the order of
a hash of doc_id, of texts up to ``FIT_BYTES`` bytes.  All texts are judged whole.

Nulls: a null text has no words, so it fails the base rules; a null doc_id is
kept as it is and never learned from; labels that are null, or that are missing
for one class, are no labels (then every line is content).  Repeated rows are
judged alike.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import byte_rows, documents, text_groups
from shiftscope.llm.textops import SPACE, U, mix, ngram_hashes, span_hashes, word_spans

FIT_DOCS, FIT_BYTES, ROUNDS, STEPS = 1500, 40_000, 3, 120
MIN_WORDS, MAX_REPEAT_PERCENT, CONTENT_SHARE = 50, 50, 0.5
FEATURES = 14


def _flags(accepted: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[list(accepted)] = 1
    return out


SYMBOL = _flags(b"#*$%&|<>")
DIGIT = _flags(b"0123456789")
UPPER = _flags(bytes(range(65, 91)))
BAR = _flags(b"|")
MARK = _flags(b"!?@/:;=_~^{}[]()\\+\"")
LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
STOP = _flags(b".!?\"')")
LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], dtype=np.int32)


@dataclass
class Lines:
    """Lines with a word, of a group of texts, and the texts' base measures."""

    features: np.ndarray  # lines x FEATURES
    words: np.ndarray  # words per line
    first: np.ndarray  # first line of each text, one more at the end
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    spans: np.ndarray  # byte span of each line in its text


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def measure(texts: list[bytes | None]) -> Lines:
    """Base measures of each text and features of each line."""
    data = np.frombuffer(b"\n".join([*(t or b"" for t in texts), b""]), dtype=np.uint8)
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    word_start, word_end = word_spans(data)
    first_word = np.searchsorted(word_start, bounds)
    n_words = np.diff(first_word)
    text_of_word = np.repeat(np.arange(len(texts)), n_words)

    hashes = span_hashes(data, word_start, word_end)
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= 3:
        grams = ngram_hashes(hashes, 3)
        inside = np.flatnonzero(text_of_word[2:] == text_of_word[:-2])
        twice, _ = _repeats(grams[inside] ^ mix(text_of_word[inside].astype(U) + U(1)))
        for k in range(3):
            covered[inside[twice] + k] = True
    repeat_sums = _sums(covered)

    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, dtype=np.int64)
    w0, w1 = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    full = w1 > w0
    starts, ends, w0, w1 = starts[full], ends[full], w0[full], w1[full]
    first = np.searchsorted(starts, bounds)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    _, later = _repeats(span_hashes(data, starts, ends) ^ mix(text_of.astype(U) + U(1)))

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = _sums(flags[data])
        return total[ends] - total[starts]

    size = np.maximum(1, ends - starts)
    words = w1 - w0
    lengths = _sums(word_end - word_start)
    marks = [per_line(f) for f in (SYMBOL, DIGIT, UPPER, BAR, MARK, LETTER)]
    letters = np.maximum(1, marks[5])
    last = data[word_end[w1 - 1] - 1] if len(w1) else np.zeros(0, dtype=np.uint8)
    count = np.diff(first)
    features = np.stack(
        [
            np.ones(len(words)),
            np.log1p(words) / 3,
            np.minimum(4, marks[0] / words),
            marks[1] / size * 5,
            marks[2] / letters * 3,
            np.minimum(4, marks[3] / words * 2),
            np.minimum(4, marks[4] / words),
            (lengths[w1] - lengths[w0]) / words / 10,
            later * 1.0,
            (repeat_sums[w1] - repeat_sums[w0]) / words,
            STOP[last] * 1.0,
            (words < 4) * 1.0,
            (np.arange(len(words)) == first[text_of]) * 1.0,
            np.log1p(count[text_of]) / 4,
        ],
        axis=1,
    ).astype(np.float32)
    lead = _sums(LEAD[data] * ~SPACE[data])
    symbols, repeated, dup = _sums(SYMBOL[data]), repeat_sums[first_word], _sums(later)[first]
    return Lines(
        features, words, first, n_words, np.diff(lead[bounds]), np.diff(symbols[bounds]), np.diff(dup), np.diff(repeated),
        np.stack([starts, ends], axis=1) - bounds[text_of][:, None],
    )


@dataclass
class Field:
    """A linear-chain conditional random field with the states 0 content and 1 boilerplate."""

    weights: np.ndarray  # FEATURES x 2
    moves: np.ndarray  # from x to

    def viterbi(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Likeliest state sequence of every text; ties go to content.  Texts run side by side, longest first."""
        scores = features @ self.weights
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)) - 1, side="right")
        best = np.zeros((len(counts), 2))
        back = np.zeros((len(features), 2), dtype=np.int8)
        begin = first[:-1][order]
        for t, lanes in enumerate(active):
            at = begin[:lanes] + t
            if t == 0:
                best[:lanes] = scores[at]
                continue
            via = best[:lanes, :, None] + self.moves
            pick = via[:, 1] > via[:, 0]
            back[at] = pick
            best[:lanes] = np.where(pick, via[:, 1], via[:, 0]) + scores[at]
        states = np.zeros(len(features), dtype=np.int8)
        now = (best[:, 1] > best[:, 0]).astype(np.int8)
        for t in range(len(active) - 1, -1, -1):
            lanes = active[t]
            at = begin[:lanes] + t
            states[at] = now[:lanes]
            now[:lanes] = back[at, now[:lanes]]
        return states

    def gradient(self, features: np.ndarray, first: np.ndarray, states: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the states and its gradients, by the forward-backward recursions."""
        scores = features @ self.weights
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)) - 1, side="right")
        begin, tail = first[:-1][order], first[1:][order] - 1
        ahead, behind = np.zeros((len(features), 2)), np.zeros((len(features), 2))
        for t, lanes in enumerate(active):
            at = begin[:lanes] + t
            ahead[at] = scores[at] if t == 0 else scores[at] + np.logaddexp(*(ahead[at - 1, s, None] + self.moves[s] for s in (0, 1)))
        expected = np.zeros((2, 2))
        held = counts[order] > 0
        total = np.zeros(len(counts))
        total[held] = np.logaddexp(ahead[tail[held], 0], ahead[tail[held], 1])
        for t in range(len(active) - 1, 0, -1):
            at = begin[: active[t]] + t
            onward = scores[at] + behind[at]
            behind[at - 1] = np.logaddexp(*(onward[:, s, None] + self.moves[:, s] for s in (0, 1)))
            pair = ahead[at - 1][:, :, None] + self.moves + onward[:, None, :] - total[: active[t], None, None]
            expected += np.exp(pair).sum(0)
        owner = np.empty(len(features), dtype=np.int64)
        owner[:] = np.repeat(np.arange(len(counts)), counts)
        whole = np.empty(len(counts))
        whole[order] = total
        marginal = np.exp(ahead + behind - whole[owner][:, None])
        truth = np.eye(2)[states]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (states[inner], states[inner + 1]), 1)
        likelihood = (scores * truth).sum() + (seen * self.moves).sum() - total.sum()
        return float(likelihood), features.T @ (truth - marginal), seen - expected


def train(texts: list[bytes], quality: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> Field:
    """Fit on documents with quality 1 (good) or 0 (bad)."""
    lines = measure(texts)
    bad = np.repeat(quality == 0, np.diff(lines.first))
    states = bad.astype(np.int8)
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    scale = 1 / max(1, len(states))
    for _ in range(rounds):
        moments = [[0.0, 0.0], [0.0, 0.0]]
        for step in range(1, steps + 1):
            _, by_weight, by_move = field.gradient(lines.features, lines.first, states)
            for m, name, g in zip(moments, ("weights", "moves"), (by_weight, by_move), strict=True):
                value = getattr(field, name)
                g = g * scale - 1e-4 * value
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
                setattr(field, name, value + 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9))
        states = np.where(bad, field.viterbi(lines.features, lines.first), 0).astype(np.int8)
    return field


def sample_labels(labels: DataFrame, per_class: int = FIT_DOCS) -> DataFrame:
    usable = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    order = [F.xxhash64(F.lit(1), "doc_id"), F.col("doc_id")]
    good, bad = (usable.where(F.col("quality") == q).orderBy(*order).limit(per_class) for q in (1, 0))
    return good.unionByName(bad).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Train on the bounded sample; None without both classes."""
    sample = F.broadcast(sample_labels(labels))  # at most 2 * FIT_DOCS rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= FIT_BYTES)
    # of a repeated id the least text; one row an id reaches the driver however often it is repeated
    rows = texts.join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    quality = rows["quality"].to_numpy(dtype=np.int64)
    if len(set(quality.tolist())) < 2:
        return None
    return train([t.encode() for t in rows["text"]], quality)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_boilerplate_lines long"


def judge(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, base measures, base_failed, kept, and the share of words on content lines."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size: the weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            texts = byte_rows(batch.column(1))
            for i, j in text_groups(texts, 1 << 20):
                x = measure(texts[i:j])
                states = np.zeros(len(x.words), dtype=np.int8) if shared.value is None else shared.value.viterbi(x.features, x.first)
                content = np.diff(_sums(x.words * (states == 0))[x.first]) / np.maximum(1, x.n_words)
                failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > MAX_REPEAT_PERCENT * x.n_words)
                columns = [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, ~failed & (content >= CONTENT_SHARE), content, np.diff(_sums(states)[x.first])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, columns)], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, f"doc_id long, {MEASURES}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
