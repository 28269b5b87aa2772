"""Queries over columns with planted structure find it."""

import numpy as np
import pytest

from shiftscope.plans import model_queries as Q, runners
from shiftscope.sources import readers, sinks

TABLES = "/root/testdata/sf0.01"


def test_chain_of_curved_mechanisms(spark):
    assert {(r.src, r.dst) for r in Q.topological_contexts(spark, TABLES).collect()} == {("q", "w"), ("w", "v")}


def test_shared_changes(spark):
    found = {(r.a, r.b): (r.confounded, r.group) for r in Q.confounder_pairs(spark, TABLES).collect()}
    assert found == {("a", "b"): (True, 0), ("a", "c"): (False, None), ("b", "c"): (False, None)}


def test_series_that_turn(spark):
    assert {(r.child, r.parent, r.lag) for r in Q.lagged_regime_edges(spark, TABLES).collect()} == {("x", "x", 1), ("y", "x", 1), ("z", "y", 1)}
    spans = {(r.child, r.begin, r.end) for r in Q.own_segments(spark, TABLES).collect()}
    assert {s for s in spans if s[0] != "x"} == {("y", 0, 216), ("y", 216, 720), ("z", 0, 432), ("z", 432, 720)}
    assert {216, 432} <= {r.cut for r in Q.cut_search(spark, TABLES).collect()}


def test_windows_cover_the_whole_series(spark):
    assert {r.window for r in Q.window_strengths(spark, TABLES).collect()} == set(range(5))


def test_rows_of_every_context():
    context = np.repeat([0, 1, 2], [500, 300, 200])
    x = np.arange(1000.0)[:, None]
    some = runners.some_rows(x, context, 100)
    assert len(some) == 100 and np.bincount(context[some[:, 0].astype(int)]).tolist() == [50, 30, 20]
    assert np.array_equal(runners.some_rows(x[:80], context[:80], 100), x[:80])


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.csv", 2, 1.5, None), ("a.csv", 1, 2.5, "y"), ("b.csv", 1, None, "z")], "file string, t int, v double, s string").repartition(3)
    for _ in range(2):  # a task that runs again leaves the same files
        assert sinks.write_named(rows, f"file://{tmp_path}/out", "file", "t", ["s", "v"]) == 2
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.csv": "s,v\ny,2.5\n,1.5\n", "b.csv": "s,v\nz,\n"}
    got = readers.by_header(spark, f"{tmp_path}/out/*.csv", ["v", "s"]).collect()
    assert sorted((r.v, r.s) for r in got) == [("", "z"), ("1.5", ""), ("2.5", "y")]


@pytest.mark.parametrize("spans", [[(0, 10, 0), (10, 5, 1)]])
def test_partition_file(spark, tmp_path, spans):
    sinks.write_partition(spark.createDataFrame(spans, "begin int, duration int, regime int"), str(tmp_path / "p"))
    assert [tuple(map(int, r)) for r in spark.read.option("sep", "\t").csv(str(tmp_path / "p"), header=True).collect()] == spans
