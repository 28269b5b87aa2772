import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: with names that operators use inside
WIDE = T.StructType([*SCHEMA.fields, *(T.StructField(n, T.StringType()) for n in ("id", "node", "n", "key", "score", "length", "piece", "shard", "component"))])


@pytest.fixture
def table(spark):
    def make(rows, wide=False):
        rows = [(*r, *[None] * (5 - len(r))) for r in rows]
        if wide:
            return spark.createDataFrame([(*r, *["x"] * (len(WIDE.fields) - 5)) for r in rows], WIDE)
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
