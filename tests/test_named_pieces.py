from pyspark.sql import functions as F

from shiftscope.sources import sinks


def test_a_large_file_is_many_tasks_work(spark, tmp_path, monkeypatch):
    """Pieces of 50 rows make whole files in order, with one heading; integers stay so beside nulls, and no piece is left."""
    monkeypatch.setattr(sinks, "PIECE_ROWS", 50, raising=False)
    monkeypatch.setattr(sinks, "COPY_BYTES", 7, raising=False)
    rows = spark.range(400).select(F.concat(F.lit("f"), F.col("id") % 2, F.lit(".csv")).alias("file"), F.col("id").alias("t"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v")).repartition(4, F.rand(1))
    assert sinks.write_named(rows, str(tmp_path / "out"), "file", "t", ["t", "v"]) == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f0.csv", "f1.csv"]
    for odd in (0, 1):
        wanted = "t,v\n" + "".join(f"{i},{i if i % 7 else ''}\n" for i in range(odd, 400, 2))
        assert (tmp_path / "out" / f"f{odd}.csv").read_text() == wanted
