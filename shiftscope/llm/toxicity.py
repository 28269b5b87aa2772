"""Operator 3: convolutional text classifier over hashed word embeddings.

A word is a run of letters, lower-cased; its vector is the sum of the rows that
its hash and the hashes of its first four and five bytes choose in embedding
tables.  Filters of widths 1, 2 and 3 run over the whole text, each filter's
maximum over all places is kept, and a logistic layer turns the maxima into a
logit.  Training is plain numpy: the gradient of a maximum reaches the words at
its place alone, so a step touches few rows.  The first component of the tables
starts from smoothed class log-odds, which lets small samples train.

Thresholds are calibrated by language: the text's language is guessed from
hashed words (a naive Bayes table fitted on the same rows; the column ``lang``
is a training target only), and each language's best logit threshold on the
calibration rows is moved to the score 0.7.

Bounds of the fit: at most ``POSITIVE`` toxic and ``NEGATIVE`` other labelled
rows, taken in the order of a hash of doc_id, of texts up to ``FIT_BYTES``
bytes.  Scoring reads every text whole.

Nulls: a null text scores as an empty one, a null doc_id is never learned from
and counts as held out = false.  Without a usable label of each class the score
is 0 for every text.  Repeated rows score alike; of several rows with one doc_id the
one with the least text is learned from; labels at odds count as toxic.  Ties in a
filter's maximum take the first place, ties between thresholds the widest gap.  Very
long texts are scored whole, in groups of bounded size.  An empty table gives an
empty result.  Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.common import documents, release, text_groups
from shiftscope.llm.textops import U, span_hashes

POSITIVE, NEGATIVE, FIT_BYTES = 2500, 5000, 40_000
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
#: rows of the tables for words, four-byte and five-byte beginnings; each has a last row for padding
BUCKETS = (1 << 15, 1 << 14, 1 << 14)
LANGUAGE_BUCKETS = 1 << 13
THRESHOLD = 0.7
#: sums of single precision depend on the texts beside a text in their last bits, which scores don't show
DIGITS = 5
EPOCHS, BATCH = 6, 32
PAD = max(WIDTHS) - 1

LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows (3 x places), places' bounds per text, and language buckets (-1 at padding).

    ``PAD`` places of padding follow every text, so no filter reaches into the next one.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = LETTER[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    place = np.arange(len(starts)) + text_of * PAD
    total = len(starts) + len(texts) * PAD
    rows = np.empty((3, total), dtype=np.int32)
    whole = span_hashes(data, starts, ends)
    for k, (size, cut) in enumerate(zip(BUCKETS, (None, 4, 5), strict=True)):
        rows[k] = size
        hashes = whole if cut is None else span_hashes(data, starts, np.minimum(ends, starts + cut))
        rows[k, place] = (hashes % U(size)).astype(np.int32)
    language = np.full(total, -1, dtype=np.int32)
    language[place] = (whole >> U(40)) % U(LANGUAGE_BUCKETS)
    return rows, first + np.arange(len(texts) + 1) * PAD, language


@dataclass
class Model:
    tables: list[np.ndarray]
    kernel: np.ndarray  # DIM x (width, offset, filter)
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    languages: np.ndarray = field(default_factory=lambda: np.zeros((LANGUAGE_BUCKETS, 1), dtype=np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: float = 1.0

    def pooled(self, rows: np.ndarray, bounds: np.ndarray):
        """Vectors of all places, filter values at all places, their maxima per text (before the rectifier)."""
        x = self.tables[0][rows[0]]
        for k in (1, 2):
            x += self.tables[k][rows[k]]
        z = x @ self.kernel
        n, values, at = len(x), [], 0
        for width in WIDTHS:
            v = z[:, at : at + FILTERS].copy()
            for j in range(1, width):
                at += FILTERS
                v[: n - j] += z[j:, at : at + FILTERS]
            at += FILTERS
            for j in range(1, width):  # what begins in the padding would reach into the next text
                v[bounds[1:] - j] = 0
            values.append(v)
        value = np.concatenate(values, axis=1)
        return x, value, np.maximum.reduceat(value, bounds[:-1], axis=0) + self.bias

    def logits(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, bounds)[2], 0) @ self.out + self.intercept

    def guess(self, language: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of each text's likeliest language."""
        if self.languages.shape[1] == 1:
            return np.zeros(len(bounds) - 1, dtype=np.int64)
        return np.add.reduceat(np.where(language[:, None] < 0, np.float32(0), self.languages[language]), bounds[:-1], axis=0).argmax(axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, bounds, language = word_ids(texts)
        logit = self.logits(rows, bounds) - self.thresholds[self.guess(language, bounds)]
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _log_odds(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Significance of the class log-odds of each bucket's presence in a text."""
    counts = np.zeros((2, size + 1))
    for r, y in zip(rows, labels, strict=True):
        counts[y, np.unique(r)] += 1
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    a, b = counts[1] + 0.5 * n1 / (n0 + n1), counts[0] + 0.5 * n0 / (n0 + n1)
    z = (np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))) / np.sqrt(1 / a + 1 / b)
    z[size] = 0
    return np.clip(z, -1, 6) / 2


def train(texts: list[bytes], labels: np.ndarray, languages: list[str | None], seed: int = 7, ratio: float = 1.0) -> Model:
    """Fit on whole texts; ``ratio``: how many times more negatives there are in the table than in the sample."""
    rng = np.random.default_rng(seed)
    docs = [word_ids([t]) for t in texts]
    held = rng.random(len(texts)) < 0.2
    fit = np.flatnonzero(~held)
    tables = [rng.normal(0, 0.05, (size + 1, DIM)).astype(np.float32) for size in BUCKETS]
    for k, table in enumerate(tables):
        table[:, 0] = _log_odds([docs[i][0][k] for i in fit], labels[fit], BUCKETS[k])
        table[-1] = 0
    width = sum(WIDTHS) * FILTERS
    kernel = rng.normal(0, 0.3, (DIM, width)).astype(np.float32)
    kernel[0] = np.abs(kernel[0])
    n_filters = len(WIDTHS) * FILTERS
    model = Model(tables, kernel, np.full(n_filters, -0.3, dtype=np.float32), rng.normal(0.2, 0.1, n_filters).astype(np.float32), -1.0)
    squares = [np.full(t.shape[0], 1e-3, dtype=np.float32) for t in tables]
    moments = {k: [0.0, 0.0] for k in ("kernel", "bias", "out", "intercept")}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for i in range(0, len(order), BATCH):
            step += 1
            part = order[i : i + BATCH]
            rows = np.concatenate([docs[d][0] for d in part], axis=1)
            bounds = np.cumsum([0, *(docs[d][0].shape[1] for d in part)])
            x, value, top = model.pooled(rows, bounds)
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(hidden @ model.out + model.intercept)))
            error = ((p - labels[part]) / len(part)).astype(np.float32)
            grads = {"out": hidden.T @ error + 1e-4 * model.out, "intercept": error.sum()}
            back = error[:, None] * model.out * (top > 0)
            grads["bias"] = back.sum(0)
            at = np.stack([value[a:b].argmax(0) + a for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            grads["kernel"] = 1e-4 * model.kernel
            ends = bounds[1:, None]
            touched, pushes, column = [], [], 0
            for w, size in enumerate(WIDTHS):
                own = slice(w * FILTERS, (w + 1) * FILTERS)
                inside = back[:, own] * (at[:, own] + size <= ends)
                for j in range(size):
                    place = np.minimum(at[:, own] + j, len(x) - 1)
                    cols = slice(column, column + FILTERS)
                    grads["kernel"][:, cols] += np.einsum("dfe,df->ef", x[place], inside)
                    touched.append(place.ravel())
                    pushes.append((inside[:, :, None] * model.kernel[:, cols].T).reshape(-1, DIM))
                    column += FILTERS
            place, push = np.concatenate(touched), np.concatenate(pushes)
            for k, table in enumerate(model.tables):
                used, inverse = np.unique(rows[k][place], return_inverse=True)
                total = np.zeros((len(used), DIM), dtype=np.float32)
                np.add.at(total, inverse, push)
                total[used == BUCKETS[k]] = 0
                squares[k][used] += (total**2).mean(1)
                table[used] -= 0.05 * total / np.sqrt(squares[k][used])[:, None]
            for name, g in grads.items():
                m = moments[name]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                setattr(model, name, getattr(model, name) - 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
    model.kernel, model.bias, model.out = (v.astype(np.float32) for v in (model.kernel, model.bias, model.out))
    _calibrate(model, docs, labels, languages, held, ratio)
    return model


def _calibrate(model: Model, docs: list, labels: np.ndarray, languages: list[str | None], held: np.ndarray, ratio: float) -> None:
    """Language table, and each guessed language's threshold."""
    names = sorted({x for x in languages if x is not None})
    if len(names) > 1:
        counts = np.full((LANGUAGE_BUCKETS, len(names)), 0.5)
        for (_, _, buckets), name in zip(docs, languages, strict=True):
            if name is not None:
                np.add.at(counts[:, names.index(name)], buckets[buckets >= 0], 1)
        model.languages = np.log(counts / counts.sum(0)).astype(np.float32)
    logit = np.array([model.logits(rows, bounds)[0] for rows, bounds, _ in docs])
    guess = np.array([model.guess(language, bounds)[0] for _, bounds, language in docs])
    weight = np.where(labels == 1, 1.0, ratio)
    every = held if (labels[held] == 1).sum() >= 20 else np.ones(len(labels), dtype=bool)
    common = _threshold(logit[every], labels[every], weight[every])
    model.thresholds = np.full(max(1, len(names)), common)
    for k in range(len(names)):
        own = every & (guess == k)
        if (labels[own] == 1).sum() >= 10 and (labels[own] == 0).sum() >= 10:
            model.thresholds[k] = _threshold(logit[own], labels[own], weight[own])
    model.scale = float(min(4.0, 4.0 / (np.std(logit) + 1e-6)))


def _threshold(logit: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the widest gap among the cuts with the best F1."""
    order = np.argsort(-logit, kind="stable")
    value, y, w = logit[order], labels[order], weight[order]
    hit, false = np.cumsum(y * w), np.cumsum((1 - y) * w)
    f1 = 2 * hit / (hit + false + (y * w).sum())
    f1[:-1][value[:-1] == value[1:]] = -1
    below = np.append(value[1:], value[-1] - 2)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(value[best] - below[best])]
    return float((value[k] + below[k]) / 2)


def learnable(labels: DataFrame) -> DataFrame:
    """The only labels that a fit may use: those with crc32(doc_id as text) mod 3 other than 1."""
    usable = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
    return usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))


def sample_labels(labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> DataFrame:
    """Labelled rows to learn from, bounded per class."""
    usable = learnable(labels)
    order = [F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")]
    parts = [usable.where(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, positive), (0, negative))]
    return parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on the bounded sample; None without both classes."""
    sample = F.broadcast(sample_labels(labels))  # at most POSITIVE + NEGATIVE rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.octet_length("text") <= FIT_BYTES)
    # of a repeated id the least text; one row an id reaches the driver however often it is repeated
    least = texts.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.lower("text").alias("text"), "lang")).alias("_least"))
    rows = least.select("doc_id", "toxic", "_least.text", "_least.lang").toPandas().sort_values("doc_id")
    y = rows["toxic"].to_numpy(dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    counted = {int(r["toxic"]): int(r["count"]) for r in learnable(labels).groupBy("toxic").count().collect()}
    ratio = max(1.0, counted[0] / counted[1] * (y == 1).sum() / (y == 0).sum())
    languages = [None if not isinstance(x, str) else x for x in rows["lang"]]
    raw = [t.encode() for t in rows["text"]]
    del rows
    model = train(raw, y, languages, ratio=ratio)
    del raw
    release(docs.sparkSession)
    return model


SCORED = "doc_id long, score double"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower().encode() for t in batch.column(1).to_pylist()]
            values = np.zeros(len(texts))
            if shared.value is not None:
                for i, j in text_groups(texts, 1 << 19):
                    values[i:j] = np.round(shared.value.scores(texts[i:j]), DIGITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCORED)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, held-out mark and prediction of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text the model does not predict toxic, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None and batch.num_rows:
                texts = [(t or "").lower().encode() for t in batch.column(at).to_pylist()]
                values = np.concatenate([shared.value.scores(texts[i:j]) for i, j in text_groups(texts, 1 << 19)])
                batch = batch.filter(pa.array(np.round(values, DIGITS) < THRESHOLD))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
