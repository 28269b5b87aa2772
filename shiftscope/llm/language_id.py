"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes.  Over each window
one gated recurrent layer runs forward and one backward, from a zero state; the
two states at a byte give that byte's language probabilities, so every position
is labelled.  A document's probabilities are the means over all its bytes.  The
network is trained in numpy by backpropagation through time on the positions'
cross entropy.  All windows of a group of texts run side by side, so a step
handles thousands of bytes.

Bounds of the fit: at most ``FIT_DOCS`` distinct documents of every language, those
with the least hash of doc_id and text, and ``FIT_WINDOWS`` windows of each, chosen by
a seeded generator over the whole text.  Prediction reads every text whole.

Nulls: a null text, and one without letters, is ``und`` with score 0; rows with
null lang or null doc_id are never learned from.  Without any learned language
every text is ``und``.  Repeated rows are predicted alike and learned from once.  Ties
go to the language whose name comes first.  Very long texts are read whole, in windows.
An empty table gives an empty result.  ``identify`` keeps all columns; a column that is
named like one of its own is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shiftscope.llm.common import byte_rows, documents, release, text_groups

WINDOW, HIDDEN = 96, 8
FIT_DOCS, FIT_WINDOWS = 400, 4
PAD = 256
#: training steps for up to 16 languages, as many again for each further 16
STEPS, BATCH = 260, 384
#: sums of single precision depend on the windows beside a window in their last bits, which scores don't show
DIGITS = 5
#: bytes of text that are read at a time, whole windows
SLICE = 10_000 * WINDOW


@dataclass
class Network:
    """inputs: (2, 3H, 257) by byte; recurrent: (2, 3H, H); gates in the order reset, update, candidate."""

    inputs: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray  # languages x 2H
    bias: np.ndarray
    names: list[str]

    @classmethod
    def fresh(cls, names: list[str], rng: np.random.Generator) -> Network:
        h = HIDDEN
        return cls(
            rng.normal(0, 0.4, (2, 3 * h, 257)).astype(np.float32),
            rng.normal(0, 0.5 / np.sqrt(h), (2, 3 * h, h)).astype(np.float32),
            rng.normal(0, 0.3, (len(names), 2 * h)).astype(np.float32),
            np.zeros((len(names), 1), dtype=np.float32),
            names,
        )

    def states(self, windows: np.ndarray) -> np.ndarray:
        """Hidden states (time, 2H, lanes) of windows (time, lanes)."""
        h, (length, lanes) = HIDDEN, windows.shape
        out = np.empty((length, 2 * h, lanes), dtype=np.float32)
        for d in (0, 1):
            table, u = self.inputs[d], self.recurrent[d]
            half_u = u.copy()
            half_u[: 2 * h] *= 0.5
            half_t = table.copy()
            half_t[: 2 * h] *= 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
            half_t = np.ascontiguousarray(half_t.T)
            state = np.zeros((h, lanes), dtype=np.float32)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                x = half_t[windows[t]].T
                a = half_u @ state
                gates = np.tanh(x[: 2 * h] + a[: 2 * h])
                gates *= 0.5
                gates += 0.5
                c = a[2 * h :]
                c *= gates[:h]
                c += x[2 * h :]
                np.tanh(c, out=c)
                state = state - c
                state *= gates[h:]
                state += c
                out[t, d * h : (d + 1) * h] = state
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities of every byte, (time, languages, lanes)."""
        logits = np.matmul(self.out, self.states(windows))
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def label_positions(self, text: bytes) -> np.ndarray:
        """Number of the likeliest language at every byte of a text."""
        windows, _ = cut_windows([text])
        return self.probabilities(windows).argmax(axis=1).T.ravel()[: len(text)]

    def pooled(self, texts: list[bytes], lanes: int = 2048) -> np.ndarray:
        """Mean probabilities of every text over its bytes (zeros for an empty one).

        A very long text is read in slices of whole windows, so memory does not grow with it.
        """
        total = np.zeros((len(texts), len(self.names)))
        slices = [(i, t[at : at + SLICE]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), SLICE)]
        for a, b in text_groups([s for _, s in slices], SLICE):
            windows, owner = cut_windows([s for _, s in slices[a:b]])
            owner = np.array([i for i, _ in slices[a:b]])[owner]
            for i in range(0, windows.shape[1], lanes):
                part = windows[:, i : i + lanes]
                p = self.probabilities(part)
                p *= (part != PAD)[:, None, :]
                np.add.at(total, owner[i : i + lanes], p.sum(axis=0).T)
        return total / np.maximum(1, [[len(t)] for t in texts])


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts (time, lanes), the last one of a text padded, and each lane's text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    flat = np.full(int(counts.sum()) * WINDOW, PAD, dtype=np.int16)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begins = np.cumsum(sizes) - sizes
    flat[np.arange(len(data)) + np.repeat(first * WINDOW - begins, sizes)] = data
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), owner


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over real positions, and its gradients by backpropagation through time."""
    h, (length, lanes) = HIDDEN, windows.shape
    kept = []
    states = np.empty((length, 2 * h, lanes), dtype=np.float32)
    for d in (0, 1):
        table, u = np.ascontiguousarray(net.inputs[d].T), net.recurrent[d]
        state = np.zeros((h, lanes), dtype=np.float32)
        trace = []
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            x, a = table[windows[t]].T, u @ state
            r, z = (1 / (1 + np.exp(-(x[i * h : (i + 1) * h] + a[i * h : (i + 1) * h]))) for i in (0, 1))
            n = np.tanh(x[2 * h :] + r * a[2 * h :])
            trace.append((t, state, r, z, n, a[2 * h :]))
            state = n + z * (state - n)
            states[t, d * h : (d + 1) * h] = state
        kept.append(trace)
    p = np.matmul(net.out, states) + net.bias
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    real = windows != PAD
    count = max(1, int(real.sum()))
    loss = -float((np.log(np.maximum(p[:, labels, np.arange(lanes)], 1e-12)) * real).sum()) / count
    p[:, labels, np.arange(lanes)] -= 1
    p *= real[:, None, :] / np.float32(count)
    found = {
        "out": np.einsum("tln,thn->lh", p, states, optimize=True),
        "bias": p.sum(axis=(0, 2))[:, None],
        "inputs": np.zeros_like(net.inputs),
        "recurrent": np.zeros_like(net.recurrent),
    }
    above = np.matmul(net.out.T, p)
    for d in (0, 1):
        u = net.recurrent[d]
        carried = np.zeros((h, lanes), dtype=np.float32)
        pushes = np.empty((length, lanes, 3 * h), dtype=np.float32)
        for t, before, r, z, n, un in reversed(kept[d]):
            g = carried + above[t, d * h : (d + 1) * h]
            gn = g * (1 - z) * (1 - n * n)
            gz = g * (before - n) * z * (1 - z)
            gr = gn * un * r * (1 - r)
            gates = np.concatenate([gr, gz, gn * r])
            found["recurrent"][d] += gates @ before.T
            carried = g * z + u.T @ gates
            pushes[t] = np.concatenate([gr, gz, gn]).T
        order = windows.ravel()
        flat = pushes.reshape(-1, 3 * h)
        for k in range(3 * h):
            found["inputs"][d, k] = np.bincount(order, weights=flat[:, k], minlength=257)
    return loss, found


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], seed: int = 11, steps: int = STEPS) -> Network:
    """Fit the network to windows (time, lanes) by Adam with clipped gradients."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(names, rng)
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("inputs", "recurrent", "out", "bias")}
    share = 1 / np.bincount(labels, minlength=len(names))[labels]
    share /= share.sum()
    for step in range(1, steps + 1):
        pick = rng.choice(len(labels), size=min(BATCH, len(labels)), p=share)
        _, found = gradients(net, windows[:, pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        rate = 0.03 * min(1.0, step / 10) * (1 - 0.9 * step / steps)
        for k, g in found.items():
            g = g / max(1.0, norm)
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            setattr(net, k, (getattr(net, k) - change).astype(np.float32))
    return net


def sample_windows(docs: DataFrame, per_language: int = FIT_DOCS, windows: int = FIT_WINDOWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows to learn from, their labels and the languages."""
    usable = docs.where("doc_id is not null and lang is not null and crc32(cast(doc_id as string)) % 4 <> 2 and octet_length(text) > 0")
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    usable = usable.withColumn("_mark", F.xxhash64(F.lit(5), F.col("doc_id").cast("long"), "text"))
    # twice the rows that are wanted pass by their hash (of distinct ones, so that a much repeated row takes no other's place) ...
    counted = usable.groupBy("lang").agg(F.approx_count_distinct("_mark").alias("_n"))
    limit = F.broadcast(counted.select("lang", (F.least(F.lit(1.0), 2.0 * per_language / F.col("_n")) * float(1 << 62)).cast("long").alias("_limit")))
    near = usable.join(limit, "lang").where(F.pmod("_mark", F.lit(1 << 62)) < F.col("_limit")).dropDuplicates(["lang", "_mark"])
    # ... and of those the least hashes are taken
    ranked = near.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("_mark", F.lit(1 << 62)), "_mark")))
    chosen = ranked.where(F.col("_rank") <= per_language).select("doc_id", "text", "lang")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts, ids = [], [], []
            for doc_id, text, lang in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rng = np.random.default_rng(abs(doc_id))
                for begin in sorted(rng.integers(0, max(1, len(text) - WINDOW + 1), size=windows)):
                    parts.append(text[begin : begin + WINDOW])
                    langs.append(lang)
                    ids.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["doc_id", "lang", "part"])

    rows = chosen.mapInArrow(pick, "doc_id long, lang string, part binary").toPandas().sort_values(["doc_id", "lang", "part"], kind="stable")
    names = sorted(set(rows["lang"]))
    if not names:
        return np.zeros((WINDOW, 0), dtype=np.int16), np.zeros(0, dtype=np.int64), []
    found, _ = cut_windows([bytes(p) for p in rows["part"]])
    return found, np.array([names.index(x) for x in rows["lang"]], dtype=np.int64), names


def fit(docs: DataFrame) -> Network | None:
    found, labels, names = sample_windows(docs)
    net = train(found, labels, names, steps=STEPS * -(-len(names) // 16)) if names else None
    release(docs.sparkSession)
    return net


def has_letter(text: str) -> bool:
    return text.isascii() and any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def predict(texts: list[str | None], net: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
    raw = [texts[i].encode() for i in use]
    for i, j in text_groups(raw, 1 << 20):
        p = net.pooled(raw[i:j])
        for k, row in zip(use[i:j], p, strict=True):
            best = int(row.argmax())
            names[k], scores[k] = net.names[best], round(min(1.0, float(row[best])), DIGITS)
    return names, scores


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and lang_score, all columns kept; null and letterless texts are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size: the weights
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "lang_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, lang_score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
