"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from shiftscope.plans import evaluation_queries, file_queries, model_queries, table_queries

ORACLE_SQL = table_queries.ORACLE_SQL | evaluation_queries.ORACLE_SQL | model_queries.ORACLE_SQL | file_queries.ORACLE_SQL
QUERIES = {k: q for k, q in (table_queries.QUERIES | evaluation_queries.QUERIES | model_queries.QUERIES | file_queries.QUERIES).items() if k in ORACLE_SQL}

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else v
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    mine, theirs = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(duck.execute(ORACLE_SQL[name]).df())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-6) if all(isinstance(v, float) for v in a + b) else [x if not isinstance(x, float) else round(x, 4) for x in a] == [x if not isinstance(x, float) else round(x, 4) for x in b]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
