import random
import re

import numpy as np
import pytest

from shiftscope.llm import jaccard_join as J
from shiftscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sets_of(rows):
    out = []
    for _, text, *_ in rows:
        words = WORD.findall(lower(text or ""))
        grams = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        out.append(grams or ({tuple(words)} if words else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(s), least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def found(docs):
    return sorted(tuple(r) for r in J.linked_documents(docs).collect())


def near_copies(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(8)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words += shared
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force_on_near_copies(table, seed):
    rows = near_copies(seed)
    assert found(table(rows)) == brute(rows)


def test_frequent_shingles_blocks_and_parts_change_nothing(table, monkeypatch):
    rows = near_copies(3, 90)
    for name, value in (("LOCAL", 2), ("PART_ROWS", 3), ("TILE_ROWS", 4), ("SLAB_SHINGLES", 500)):
        monkeypatch.setattr(J, name, value)
    assert found(table(rows)) == brute(rows)


@pytest.mark.parametrize("limit", [60, 400, 3000])
def test_cut_stars_and_clusters_change_nothing(table, monkeypatch, limit):
    """Stars in parts; clusters in bands, with the largest component dealt out, and in blocks that meet in pairs."""
    rng = random.Random(limit)
    rows = near_copies(5, 80)
    for n in (20, 24, 28, 33, 40):  # a ladder of sizes within a band's reach
        rows.append((1000 + n, " ".join(f"z{i}" for i in range(n))))
    rows += [(2000 + i, " ".join(w if rng.random() > 0.03 else f"q{i}" for w in [f"h{j}" for j in range(90)])) for i in range(40)]
    monkeypatch.setattr(J, "LIMIT", limit)
    monkeypatch.setattr(J, "TILE_ROWS", 8)
    assert found(table(rows)) == brute(rows)


def test_sets_with_one_hash_stay_apart(table, monkeypatch):
    rows = near_copies(6, 40)
    fold, signed = J.fold, J._signed

    def weak(x, twice=frozenset()):  # five ids for all sets
        first = fold(x[:1]) % 5
        return signed(fold(x, 1)) if first in twice else first

    monkeypatch.setattr(J, "class_of", weak)
    assert found(table(rows)) == brute(rows)


def test_many_null_ids_and_a_repeated_id(table):
    rng = random.Random(8)
    texts = [" ".join(f"n{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(300)]
    rows = [(None, t) for t in texts * 3] + [(7, t + " y z") for t in texts]
    got = J.linked_documents(table(rows)).collect()
    assert len(got) == len(rows) and {r.n_shingles for r in got} == {9, 11}
    assert sum(r.component_id is None for r in got) == 900  # 9 of 11 shingles are too few


def test_own_width_bitmaps_never_cut_a_link():
    rng = np.random.default_rng(3)
    for n in (5, 60, 64, 300, 1200):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.96], rng.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))
        if J.linked(base, other):
            width = min(J.width_for(len(base)), J.width_for(len(other)))
            assert J.possible(np.array([len(base)]), np.array([len(other)]), J.bitmap(base, width)[None], J.bitmap(other, width)[None])[0]


def test_matches_brute_force_on_documents(spark, sf_dir, texts):
    assert found(spark.read.parquet(f"{sf_dir}/documents.parquet")) == brute(texts)


def test_edge_cases(table):
    rows = [(5, None), (3, ""), (9, " \n\t"), (4, "One two"), (2, "one TWO"), (8, "one two three"), (7, "a b c d"), (7, "a b c d"), (1, "x\x85y x\xa0y É é")]
    assert found(table(rows, wide=True)) == brute(rows)
    assert found(table([])) == []
    assert sorted(r[0] for r in J.one_of_each(table(rows)).collect()) == [1, 2, 3, 5, 7, 8, 9]


def test_null_ids(table):
    got = J.linked_documents(table([(None, "a b c d e"), (6, "a b c d e"), (None, "p q r s t")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("6", "6"), ("None", "6"), ("None", "None")]


def test_an_id_may_name_several_texts(table):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (9, "p q r s t")]
    got = J.linked_documents(table(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (9, 9)}


def test_bitmap_bound_never_cuts_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 63, rng.integers(0, 20), dtype=np.uint64)]))
        small, large = sorted((base, other), key=len)
        if not len(small):
            continue
        union = len(np.union1d(base, other))
        if 100 * len(np.intersect1d(base, other)) >= 85 * union:
            sizes = (np.array([len(x)]) for x in (small, large))
            assert J.possible(*sizes, J.bitmap(small)[None], J.bitmap(large)[None])[0]


def test_signatures_of_several_widths_never_cut_a_link():
    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 20, 60, 62, 64, 66, 250, 260, 1000, 1030):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [base, np.unique(np.concatenate([base[rng.random(len(base)) < 0.96], rng.integers(0, 1 << 63, n // 25, dtype=np.uint64)]))]
    signatures = J.Signatures([J.bitmap(s, J.width_for(len(s), 4)).tobytes() for s in sets])
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    sizes = np.array([len(s) for s in sets])
    got = signatures.possible(x, y, sizes[x], sizes[y])
    true = np.array([J.linked(sets[a], sets[b]) for a, b in zip(x, y)])
    assert got[true].all() and true.sum() > len(sets)
    assert got.sum() < true.sum() + 6  # and seldom lets another pair pass


def test_components_of_a_long_path(spark):
    order = list(range(40))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert len({got[i] for i in range(40)}) == 1 and got[100] == got[101] != got[0] and len(got) == 42
