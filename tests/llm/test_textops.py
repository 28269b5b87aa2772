"""Hashes of words, lines and texts: patterns that defeat a polynomial modulo a power of two."""

import zlib

import numpy as np
import pytest

from shiftscope.llm import jaccard_join as J, packing as P, quality_crf as Q, sentencepiece_scan as S, textops as T


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


LEFT, RIGHT = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_hashes_tell_patterns_apart():
    for n in (8, 16, 64, 72, 1024, 4096):
        spans = [thue_morse(n, a, b).encode() for a, b in (("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"))]
        for seed in (T.SEED, T.SECOND):
            data = np.frombuffer(b"".join(spans), dtype=np.uint8)
            at = np.arange(5) * n
            assert len(set(T.span_hashes(data, at[:-1], at[1:], seed).tolist())) == 4


def test_hash_depends_on_the_span_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4000, 300))
    ends = starts + rng.integers(0, 200, 300)
    for s, e, h in zip(starts, ends, T.span_hashes(data, starts, ends)):
        part = np.concatenate([[7], data[s:e], [9]]).astype(np.uint8)
        assert h == T.span_hashes(part, np.array([1]), np.array([1 + e - s]))[0]


def test_index_tells_pairs_apart():
    index = T.HashIndex(8)
    h, c = np.array([5, 5, 6, 0], dtype=np.uint64), np.array([1, 2, 1, 0], dtype=np.uint64)
    index.add(h, c)
    assert index.get(h, c).tolist() == [0, 1, 2, 3] and index.get(h, c + np.uint64(9)).tolist() == [-1] * 4


def test_run_hashes_are_folds():
    values = np.arange(20, dtype=np.uint64)
    assert T.run_hashes(values, np.array([0, 3]), np.array([20, 9])).tolist() == [T.fold(values), T.fold(values[3:9])]


def test_quality_counts(table):
    text = f"{LEFT}\n{RIGHT}\n{LEFT} x y {RIGHT} x y"
    (row,) = Q.judge(table([(1, text)]), None).collect()
    assert (row.n_dup_lines, row.n_repeat_words) == (0, 0)


def test_join_keeps_them_apart(table):
    rows = [(1, f"p q r {LEFT}"), (2, f"p q r {RIGHT}"), (3, LEFT), (4, RIGHT)]
    assert {r.doc_id: r.component_id for r in J.linked_documents(table(rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_tokens(table):
    encoder, lattice = P.Encoder(), S.Lattice()
    texts = [LEFT, RIGHT, f"{LEFT} {RIGHT}"]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for text, (score, ids) in zip(texts, lattice.spans([" " + t for t in texts]), strict=True):
        assert lattice.decode(ids) == text and score == pytest.approx(lattice.best(" " + text, 0, len(text) + 1)[0])
    got = {r.doc_id: r.text_crc32 for r in S.digest(S.encode(table([(i, t) for i, t in enumerate(texts)]))).collect()}
    assert got == {i: zlib.crc32(t.encode()) for i, t in enumerate(texts)}


def test_passages_of_two_words(table):
    left, right = (thue_morse(62, a, b) for a, b in (("u", "v"), ("v", "u")))
    rows = [(1, " ".join(left) + " l"), (2, " ".join(right) + " m")]
    seen = {tuple(t.split()[i : i + 35]) for _, t in rows for i in range(29)}
    assert len(seen) > 35  # most windows differ
    from tests.llm.test_substring_dedup import brute, found

    assert found(table(rows)) == brute(rows)
