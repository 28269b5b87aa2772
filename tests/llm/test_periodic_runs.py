import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from shiftscope.llm import periodic_runs as pr


def brute(ids):
    """Every stretch of every period, kept if the period is its smallest."""
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            start, length = i, j + q - i
            least = next(p for p in range(1, q + 1) if all(ids[k] == ids[k + p] for k in range(start, start + length - p)))
            if least == q and length >= max(6, 4 * q):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng):
    words = []
    while len(words) < rng.randrange(1, 160):
        unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 14))]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 90)]
    return words


def test_equals_brute_force():
    rng = random.Random(5)
    for k in range(3000):
        ids = planted(rng) if k % 3 else [rng.randrange(2) for _ in range(rng.randrange(60))]
        assert pr.runs(np.array(ids, dtype=np.int64)) == brute(ids), ids


@pytest.mark.parametrize("n, unit", [(200_000, 1), (200_000, 3), (120_000, 997), (100_000, 24_999), (50_000, 12_501)])
def test_long_periodic_texts(n, unit):
    rng = np.random.default_rng(unit)
    ids = np.resize(rng.permutation(unit), n)
    began = time.time()
    assert pr.runs(ids) == ([(0, n, unit)] if n >= 4 * unit else [])
    assert time.time() - began < 20


def test_nested_and_adjacent_runs():
    unit = [1] * 40 + [2]
    ids = np.array(unit * 50 + [3, 4] * 30)
    assert pr.runs(ids) == brute(ids.tolist())
    blocks = np.array(([1] * 300 + [2]) * 60)
    began = time.time()
    assert len(pr.runs(blocks)) == 61 and time.time() - began < 10


def test_changed_words():
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    words = [b"w%d" % k for k in range(37)]
    for i in ids:
        g = zlib.crc32(str(i).encode()) // 10
        for n in (1, 2, 5, 37):
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert pr.altered(i, words[:n]) == [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    assert pr.altered(None, words) == words and pr.altered(ids[0], []) == []


def expected(doc_id, text):
    words = pr.altered(doc_id, (text or "").encode().split())
    found = brute(words)
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(top and (top[0], top[1], top[2], 1000 * top[1] // top[2]) or [None] * 4), sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_query_equals_brute_force(spark, texts, table):
    short = [r for r in texts if len((r[1] or "").split()) < 250]
    got = {r["doc_id"]: tuple(r) for r in pr.repeated_runs(table(short), pr.altered).collect()}
    assert len(short) > 100 and got == {r[0]: expected(r[0], r[1]) for r in short}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_whole_table(spark, sf_dir, texts):
    got = pr.query(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in texts)


def test_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b " * 9), (4, "x " * 5), (5, "x " * 6), (5, "x " * 6), (6, "é   " * 4), (7, ("lang " * 70_000))]
    for wide in (False, True):
        got = pr.repeated_runs(table(rows, wide)).collect()
        assert [tuple(r)[:6] for r in got] == [
            (1, 0, None, None, None, None), (2, 0, None, None, None, None), (3, 0, None, None, None, None), (None, 1, 0, 18, 2, 9000), (4, 0, None, None, None, None),
            (5, 1, 0, 6, 1, 6000), (5, 1, 0, 6, 1, 6000), (6, 1, 0, 8, 2, 4000), (7, 1, 0, 70_000, 1, 70_000_000),
        ]
        whole = pr.collapsed(table(rows, wide)).collect()
        assert [r["text"] for r in whole] == [None, "", "", "a b", "x x x x x", "x", "x", "é  ", "lang"]
    assert pr.repeated_runs(table([])).collect() == [] and pr.collapsed(table([])).collect() == []
