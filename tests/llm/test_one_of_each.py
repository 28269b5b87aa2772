"""One document of each component, where ids do not name one text each."""

from shiftscope.llm import jaccard_join as J


def test_an_id_of_several_texts_loses_only_near_copies(table):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, "p q r s t"), (4, "u v w x y"), (4, "u v w x y"), (5, ""), (5, "k l m n o")]
    kept = sorted((r.doc_id, r.text) for r in J.one_of_each(table(rows, wide=True)).collect())
    assert kept == sorted([(1, a), (2, b), (4, "p q r s t"), (4, "u v w x y"), (5, ""), (5, "k l m n o")])


def test_near_texts_of_one_id_are_one(table):
    a = " ".join(f"a{i}" for i in range(60))
    assert J.one_of_each(table([(1, a), (1, a + " x"), (2, a)])).count() == 1


def test_callers_columns_may_have_any_name(spark, table):
    from pyspark.sql import functions as F

    from shiftscope.llm import packing

    rows = [(4, "p q r s t"), (4, "u v w x y"), (1, "k l m n o"), (2, "k l m n o")]
    docs = table(rows).withColumns({c: F.lit(7) for c in ("_node", "_id", "_kept", "_several")})
    kept = J.one_of_each(docs).collect()
    assert sorted((r.doc_id, r.text, r["_node"]) for r in kept) == [(1, "k l m n o", 7), (4, "p q r s t", 7), (4, "u v w x y", 7)]
    pieces = spark.createDataFrame([(k % 5 + 1, k) for k in range(40)], "length long, _rank long").withColumns({c: F.lit(7) for c in ("_bucket", "_row", "_ahead", "_n")})
    packed = packing.pack(pieces, 6).collect()
    assert sorted(r["_rank"] for r in packed) == list(range(40)) and max(r["offset"] + r["length"] for r in packed) <= 6
