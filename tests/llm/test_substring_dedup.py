import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shiftscope.llm import substring_dedup as D
from shiftscope.llm.fm_index import FMIndex, WaveletMatrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in D.removed(docs).collect()), key=str)


def passages(seed, n=60):
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randint(0, 5000)}" for _ in range(k)]
    shared = [words(rng.choice([34, 35, 36, 60, 200])) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += words(rng.randint(0, 80))
            if rng.random() < 0.5:
                p = rng.choice(shared)
                a = rng.choice([0, 0, 1, 7])
                parts += p[a : len(p) - rng.choice([0, 0, 3])]
        if rng.random() < 0.2:
            parts = parts[:40] + ["again"] * rng.randint(30, 90)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_on_passages(table, seed):
    rows = passages(seed)
    assert found(table(rows)) == brute(rows)


def test_common_anchors_and_small_slabs_change_nothing(table, monkeypatch):
    rows = passages(3)
    for name, value in (("LOCAL", 2), ("HOT", 2), ("SLAB", 20), ("SEGMENTS_EACH", 3)):
        monkeypatch.setattr(D, name, value)
    assert found(table(rows)) == brute(rows)


def test_a_common_line_fills_no_shard(spark, table, monkeypatch):
    """Documents that share a line of 30 words between words of their own: their windows go to many groups and none is kept."""
    rng = random.Random(9)
    line = [f"l{i}" for i in range(30)]
    words = lambda k: [f"w{rng.randint(0, 10**9)}" for _ in range(k)]
    rows = [(i, " ".join(words(20) + line + words(20))) for i in range(1500)]
    rows += [(9000 + i, " ".join(words(9) + line + [f"t{j}" for j in range(30)])) for i in range(3)]
    docs = table(rows)
    texts = D._texts(docs)
    common = D._common(texts)
    assert common.shape[1] > 0
    (_, _, found_segments), = D._slabs(iter(pa.Table.from_pandas(texts.toPandas(), preserve_index=False).to_batches()), common)
    keys, counts = np.unique(found_segments[:, 5], return_counts=True)
    assert counts.max() < D.HOT
    kept = D._occurrences(texts, spark.sparkContext.broadcast(common), 16)
    assert kept.agg({"key": "max"}).count() == 1 and kept.count() < 400
    assert found(docs) == brute(rows)


def test_clashing_names(table):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = table([(1, f"one {shared}"), (2, f"{shared} two")]).selectExpr("doc_id", "text", "'x' as _id", "'y' as _bit", "1 as _mask", "2 as c0")
    got = {r.doc_id: tuple(r) for r in D.deduplicated(docs).collect()}
    assert got == {1: (1, "one ", "x", "y", 1, 2), 2: (2, "two", "x", "y", 1, 2)}


def test_matches_brute_force_on_documents(spark, sf_dir, texts):
    assert found(spark.read.parquet(f"{sf_dir}/documents.parquet")) == brute(texts)


def test_edge_cases(table):
    long = " ".join(f"x{i}" for i in range(35))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + " y"), (5, long + " y"), (6, "a " * 34), (7, "b " * 35), (8, "c " * 36), (None, long)]
    assert found(table(rows, wide=True)) == brute(rows)
    assert found(table([])) == []


def test_texts_keep_what_is_not_covered(table):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"one\ntwo {shared}\nthree  four", "en", "a", 9), (2, f"{shared} five", "en", "b", 9), (3, "six\n\nseven", "en", "c", 5)]
    got = {r.doc_id: (r.text, r.n_chars, r.source) for r in D.deduplicated(table(rows)).collect()}
    assert got == {1: ("one\ntwo three  four", 19, "a"), 2: ("five", 4, "b"), 3: ("six\n\nseven", 5, "c")}


def test_fm_index_counts_and_ranks():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = rng.integers(0, rng.integers(2, 9), rng.integers(1, 200))
        matrix = WaveletMatrix(text, 9)
        symbols, at = rng.integers(0, 9, 50), rng.integers(0, len(text) + 1, 50)
        assert matrix.rank(symbols, at).tolist() == [int((text[:i] == c).sum()) for c, i in zip(symbols, at)]
        padded = np.append(text + 1, 0)
        index = FMIndex(padded, 11, np.ones(len(padded), dtype=np.int64), 12)
        for end in rng.integers(1, len(text) + 1, 10):
            most = min(12, int(end))
            want = 0
            for k in range(1, most + 1):
                p = text[end - k : end]
                if sum((text[i : i + k] == p).all() for i in range(len(text) - k + 1)) >= 2:
                    want = k
                else:
                    break
            assert index.matching(padded, np.array([end]), np.array([most]), 2)[0] == want
