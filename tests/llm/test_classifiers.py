import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shiftscope.llm import language_id as L, quality_crf as Q, toxicity as T


def test_toxicity_on_held_out_labels(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = T.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality", "toxic")
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    none = labels.where(f"not ({held})")
    turned = none.unionByName(labels.where(held).selectExpr("doc_id", "quality", "1 - toxic as toxic"))
    many = none.unionByName(docs.where(held).selectExpr("doc_id", "cast(0 as int) as quality", "cast(0 as int) as toxic"))
    scores = [sorted((r.doc_id, r.score) for r in T.judged(docs, x).collect()) for x in (none, turned, many)]
    assert scores[0] == scores[1] == scores[2]


def test_toxicity_scores_by_hand():
    """Every filter at every place, one by one, against the vectorised pass."""
    toxic, fine = ["what an idiot you are", "idiot talk here so bad"] * 12, ["fine words are here", "a calm day by the sea"] * 12
    model = T.train([t.encode() for t in toxic + fine], np.repeat([1, 0], 24), ["en"] * 48)
    texts = [b"", b"idiot", b"a calm idiot", b"some longer text with an idiot in it and calm words", b"12 34"]
    rows, bounds, language = T.word_ids(texts)
    got = model.logits(rows, bounds)
    for i in range(len(texts)):
        places = list(range(bounds[i], bounds[i + 1]))
        vectors = {p: sum(model.tables[k][rows[k, p]] for k in range(3)) for p in places}
        pooled, column = [], 0
        for width in T.WIDTHS:
            for f in range(T.FILTERS):
                values = []
                for p in places:
                    if width > 1 and p > places[-1] - (width - 1):
                        values.append(0.0)  # what would reach beyond the text's padding
                        continue
                    values.append(sum(float(vectors[p + j] @ model.kernel[:, column + j * T.FILTERS + f]) for j in range(width)))
                pooled.append(max(values))
            column += width * T.FILTERS
        hidden = np.maximum(np.array(pooled) + model.bias, 0)
        assert got[i] == pytest.approx(float(hidden @ model.out + model.intercept), rel=1e-4, abs=1e-4)


def test_toxicity_edge_cases(spark, table):
    docs = table([(1, None), (2, ""), (3, "idiot " * 30_000), (4, "é"), (4, "é"), (None, "x")], wide=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.fit(docs, none) is None
    assert [r.score for r in T.score(docs, None).collect()] == [0.0] * 6
    toxic = ["what an idiot you are", "idiot talk here"] * 20
    model = T.train([t.encode() for t in toxic + ["fine words are here", "a calm day"] * 20], np.repeat([1, 0], 40), ["en"] * 80)
    scores = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert scores[1] == scores[2] and scores[3] >= 0.7 > scores[2]
    assert sorted(str(r.doc_id) for r in T.clean(docs, model).collect()) == ["1", "2", "4", "4", "None"]
    assert T.score(table([]), model).collect() == []
    # filters never cross from one text into the next
    assert np.allclose(model.scores([b"an idiot", b"talk"]), [model.scores([b"an idiot"])[0], model.scores([b"talk"])[0]])


def test_language_on_held_out_documents(spark, sf_dir, texts):
    truth = {t[0]: t[2] for t in texts}
    rows = L.query(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, truth[r.doc_id]) for r in rows if r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.85


def test_network_by_hand():
    """The recurrences byte by byte against the vectorised pass; slices of a long text change nothing."""
    net = L.Network.fresh(["a", "b", "c"], np.random.default_rng(4))
    h = L.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    text = ("ein Text, " * 25).encode()
    total = np.zeros(3)
    for at in range(0, len(text), L.WINDOW):
        window = [*text[at : at + L.WINDOW], *[L.PAD] * max(0, at + L.WINDOW - len(text))]
        states = np.zeros((len(window), 2 * h))
        for d, order in ((0, range(len(window))), (1, range(len(window) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                x, a = net.inputs[d][:, window[t]], net.recurrent[d] @ state
                r, z = sigmoid(x[:h] + a[:h]), sigmoid(x[h : 2 * h] + a[h : 2 * h])
                state = (1 - z) * np.tanh(x[2 * h :] + r * a[2 * h :]) + z * state
                states[t, d * h : (d + 1) * h] = state
        for t, b in enumerate(window):
            if b != L.PAD:
                e = np.exp(net.out @ states[t] + net.bias[:, 0])
                total += e / e.sum()
    assert np.allclose(net.pooled([text])[0], total / len(text), atol=1e-4)


def test_slices_change_nothing(monkeypatch):
    net = L.Network.fresh(["a", "b"], np.random.default_rng(5))
    texts = [b"some text " * 100, b"", b"x" * 97, b"other " * 300]
    whole = net.pooled(texts)
    monkeypatch.setattr(L, "SLICE", 2 * L.WINDOW)
    assert np.allclose(net.pooled(texts), whole, atol=1e-6)


def test_every_language_is_learned(table):
    rows = [(i, f"text {i} of many", "aa") for i in range(900)] + [(1000 + i, f"rare {i}", f"l{i:02d}") for i in range(70)] + [(2000, "again", "aa")] * 800
    _, labels, names = L.sample_windows(table(rows), per_language=20)
    assert len(names) > 45 and names[0] == "aa" and 0 < (labels == 0).sum() <= 20 * L.FIT_WINDOWS
    wide = L.identify(table(rows[:3], wide=True).withColumnRenamed("node", "lang_pred"), None)
    assert wide.columns.count("lang_pred") == 1 and wide.count() == 3


def test_gradients_by_differences():
    net = L.Network.fresh(["a", "b", "c"], np.random.default_rng(1))
    windows, _ = L.cut_windows([b"some text to look at", b"ein anderer Text"])
    labels = np.array([0, 2])
    _, found = L.gradients(net, windows, labels)
    for name in ("inputs", "recurrent", "out", "bias"):
        value = getattr(net, name)
        at = np.unravel_index(np.abs(found[name]).argmax(), value.shape)
        old = value[at]
        losses = []
        for step in (1e-2, -1e-2):
            value[at] = old + step
            losses.append(L.gradients(net, windows, labels)[0])
        value[at] = old
        assert found[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.02, abs=1e-4)


def test_language_edge_cases(table):
    net = L.Network.fresh(["a", "b"], np.random.default_rng(2))
    docs = table([(1, None), (2, ""), (3, "123 !?"), (4, "x" * 200_000), (5, "é"), (5, "é"), (None, "word")], wide=True)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in L.identify(docs, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] in "ab" and got[None][0] in "ab"
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(table([]), net).collect() == [] and L.fit(table([])) is None
    assert net.label_positions(b"some words").shape == (10,)
    # other texts beside it don't change a text's probabilities
    alone, beside = net.pooled([b"abc def"]), net.pooled([b"abc def", b"q" * 500])
    assert np.allclose(alone[0], beside[0], atol=1e-5)


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)]


EDGE = [None, "", " \n\t", "a b c a b c", "x\nx\n\n \nx", "\x85 a\xa0b", "a a a a", "|||\n|||", "é " * 60, "w" * 300_000, "one\r\none\r\n"]


def test_quality_measures(table, texts):
    rows = [*texts[:150], *((10_000 + i, t) for i, t in enumerate(EDGE))]
    got = {r.doc_id: r for r in Q.judge(table([r[:2] for r in rows], wide=True), None).collect()}
    for doc_id, text, *_ in rows:
        want, r = measures(text), got[doc_id]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want, repr(text)[:80]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert Q.judge(table([]), None).collect() == []


def test_quality_field(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in Q.query(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in rows if labels[r.doc_id] == 1]) > 0.97
    assert np.mean([r.kept for r in rows if labels[r.doc_id] == 0]) < 0.2


def test_field_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    field = Q.Field(rng.normal(size=(Q.FEATURES, 2)), rng.normal(size=(2, 2)))
    features, first = rng.normal(size=(9, Q.FEATURES)), np.array([0, 4, 4, 9])
    score = lambda f, s: sum((f[t] @ field.weights)[s[t]] for t in range(len(s))) + sum(field.moves[a, b] for a, b in zip(s, s[1:]))
    states = field.viterbi(features, first)
    for a, b in ((0, 4), (4, 9)):
        assert tuple(states[a:b]) == max(product((0, 1), repeat=b - a), key=lambda s: score(features[a:b], s))
    chosen = rng.integers(0, 2, 9)
    value, by_weight, by_move = field.gradient(features, first, chosen)
    want = sum(score(features[a:b], chosen[a:b]) - np.log(sum(np.exp(score(features[a:b], s)) for s in product((0, 1), repeat=b - a))) for a, b in ((0, 4), (4, 9)))
    assert value == pytest.approx(want)
    for name, g in (("weights", by_weight), ("moves", by_move)):
        moved = getattr(field, name).copy()
        moved[1, 1] += 1e-6
        assert (Q.Field(**{**field.__dict__, name: moved}).gradient(features, first, chosen)[0] - value) / 1e-6 == pytest.approx(g[1, 1], abs=1e-3)


def test_copies_of_a_labelled_row_reach_the_driver_once(spark, sf_dir, monkeypatch):

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one = docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 <> 1").select(*docs.columns).orderBy("doc_id").limit(1)
    many = docs.unionByName(one.crossJoin(spark.range(100_000)).select(*docs.columns))
    got = []
    collect = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: got.append(len(rows := collect(self))) or rows)
    for module in (Q, T):
        monkeypatch.setattr(module, "train", lambda *a, **b: None)
        for rows in (docs, many):
            module.fit(rows, labels)
    assert len(got) == 4 and got[0] == got[1] < 1000 and got[2] == got[3] < 1000
