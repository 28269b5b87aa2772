"""Scores of graphs stay in the parts that orders are dealt into, and equal the joins they stand for."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shiftscope.operators import graphs

QUERIES = "link_kinds mutual_edges confounded_scores causal_confounded_counts kind_adjacency orientation_scores observed_labels conditioning_sets window_graph kites unshielded_triples triangles metric_improvement summary_graph edge_confusion skeleton_confusion".split()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", [*QUERIES, "edge_state_scores"])
def test_orders_are_dealt_once(spark, sf_dir, no_broadcast, name):
    """Parts grow in number with the table; what a session deals out by itself has a number of its own."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "ENSURE_REQUIREMENTS" in line]
    assert all("decision" in line for line in dealt) and len(dealt) == (name == "edge_state_scores")


def test_more_rows_make_more_parts(spark, sf_dir, monkeypatch):
    from shiftscope.plans import table_queries

    monkeypatch.setattr(table_queries, "PART_ROWS", 100)
    rows = table_queries.read(spark, sf_dir, "lineitem").count()
    assert table_queries.order_lines(spark, sf_dir).rdd.getNumPartitions() == -(-rows // 100)


KEYS = ["graph", "src", "dst"]
ROWS = [(1, 1, 2), (1, 1, 2), (1, 2, 3), (2, 1, 2), (2, None, 2), (3, 4, 4)]
OTHER = [(1, 1, 2), (1, 1, 2), (2, None, 2), (3, 4, 4), (4, 1, 2)]


def test_flagged(spark):
    """Repeated rows stay, and null keys are in no table."""
    left, right = (spark.createDataFrame(r, "graph int, src int, dst int") for r in (ROWS, OTHER))
    got = graphs.flagged(left.withColumn("v", F.lit("x")), KEYS, seen=right)
    wanted = left.withColumn("v", F.lit("x")).join(right.distinct().withColumn("seen", F.lit(True)), KEYS, "left").fillna(False, ["seen"])
    assert sorted(map(tuple, got.select(*KEYS, "v", "seen").collect()), key=str) == sorted(map(tuple, wanted.select(*KEYS, "v", "seen").collect()), key=str)


def test_met(spark):
    left = spark.createDataFrame(ROWS, "graph int, src int, dst int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 1, None), (2, None, "b"), (3, 4, "c"), (5, 1, "d")], "graph int, src int, name string")
    keys = ["graph", "src"]
    got, wanted = graphs.met(left, right, keys), left.join(right, keys)
    assert got.columns == wanted.columns and sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_marked(spark):
    left, right = (spark.createDataFrame(r, "graph int, src int, dst int").dropna() for r in (ROWS, OTHER))
    got = {tuple(r) for r in graphs.marked(KEYS, t=left, f=right).collect()}
    assert got == {(1, 1, 2, True, True), (1, 2, 3, True, False), (2, 1, 2, True, False), (3, 4, 4, True, True), (4, 1, 2, False, True)}
