import pytest

import corpus_pipeline as pipeline
from shiftscope.llm import common, jaccard_join, packing
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_substring_dedup import brute as brute_removed


def test_stages(spark, sf_dir, texts):
    docs, sizes = common.documents(spark, sf_dir), []
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.stored(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == pipeline.COLUMNS and set(after) <= set(before)
        sizes.append(len(after))
        rows = [(r.doc_id, r.text) for r in before.values()]
        if name == "jaccard_join":
            assert set(after) == {c for _, _, c in brute_components(rows)}
        if name == "substring_dedup":
            removed = {d: (n, k) for d, n, k, _ in brute_removed(rows)}
            for d, r in after.items():
                assert len((r.text or "").split()) == removed[d][0] - removed[d][1]
                assert removed[d][1] or r.text == before[d].text
        else:
            assert all(after[d] == before[d] for d in after)
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert sorted(tuple(r) for r in packed) == sorted(tuple(r) for r in packing.pack_documents(docs).collect())


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "a b c d e", "en", "s", 9), (2, "", "en", "s", 0)]])
def test_small_tables(spark, table, sf_dir, rows):
    docs = table(rows)
    for name, stage in pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    assert docs.count() == (1 if rows else 0)


def test_one_of_each_keeps_null_ids(table):
    docs = table([(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (9, "a b c d", "fr", "s", 1)])
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(docs).collect()) == ["4", "None"]
