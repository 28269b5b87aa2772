from pyspark.sql import functions as F

from shiftscope.operators import moments


def test_rows_are_not_dealt_by_context(spark):
    """Two contexts would fill two tasks, whatever the table."""
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("c"), F.sqrt("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = moments.inlier_rows(rows, ["v"], 1.5, ["c"])
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    frame = rows.toPandas()
    z = (frame["v"] - frame.groupby("c")["v"].transform("mean")).abs() / frame.groupby("c")["v"].transform(lambda v: v.std(ddof=0))
    assert {r.id for r in found.collect()} == set(frame["id"][z <= 1.5])
