from shiftscope.sources import readers


def test_headings_are_found_without_sorting_lines(spark, tmp_path):
    """Every file's own heading, from numbers of lines alone; lines are neither sorted nor dealt by file."""
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},{-i}\n" for i in range(500)))
    (tmp_path / "b.csv").write_text("y,x\n5,6\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = readers.by_header(spark, f"{tmp_path}/*.csv", ["x", "y"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
    got = sorted((r.file[-5:], r.x, r.y) for r in rows.collect())
    assert got == sorted([("a.csv", str(i), str(-i)) for i in range(500)] + [("b.csv", "6", "5")])
