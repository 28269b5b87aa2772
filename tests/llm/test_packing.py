import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shiftscope.llm import packing as P


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(memo=400)


def reference(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_matches_the_tokenizer(encoder, texts):
    rng = random.Random(1)
    parts = ["a", "B", "'s", "'", "re", ".", ",", "...", "<|endoftext|>", "<", "É", "é", "é", "\xa0", "\n", "\t", " ", "1", "23", "ß", "İ", "don't", "a.b", "x. ", "y.\n", ", ", "你好", "-", "\x85", "µ", "×"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    for batch in (made, [t[1] for t in texts[:60]], ["", " ", "\n\n"]):
        for text, ids in zip(batch, encoder.encode_batch(batch), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def brute(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return rooms


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 50, 2048])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        histogram = {n: lengths.count(n) for n in lengths}
        bins = defaultdict(list)
        moves = sorted(P.plan_bins(histogram, capacity))
        for n in histogram:
            own = [m for m in moves if m[0] == n]
            for rank in range(histogram[n]):
                m = [m for m in own if m[1] <= rank][-1]
                bins[m[3] + (rank - m[1]) // m[2]].append((m[4] + (rank - m[1]) % m[2] * n, n))
        for items in bins.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in x) for x in bins.values()) == sorted(brute(lengths, capacity))


def check(rows, encoder, docs):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    for doc_id, text in docs.items():
        ids = reference(encoder, text)
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.length == min(2048, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert len(bins) == len(brute([r.length for r in rows], 2048))


def test_documents(spark, sf_dir, encoder, texts):
    check(P.query(spark, sf_dir).collect(), encoder, {t[0]: t[1] for t in texts})


def test_edge_cases(table, encoder):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "same"), (5, "same"), (6, "x" * 3000), (None, "y")]
    got = P.pack_documents(table(rows, wide=True)).collect()
    check(got, encoder, {r[0]: r[1] for r in rows})
    assert len(P.pack_documents(table([(1, "a b"), (1, "a b")])).collect()) == 2
    assert P.pack_documents(table([])).collect() == []
