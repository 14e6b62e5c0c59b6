"""Each query with SQL gives what DuckDB gives on the small tables, and the smoke query runs."""

import duckdb
import pytest
from tools.compare import canonical

import tarn.evidence_queries  # noqa: F401  registers its queries
import tarn.library_queries  # noqa: F401
import tarn.phrase_queries  # noqa: F401
import tarn.stream_queries  # noqa: F401
import tarn.queries as q
from tarn.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df, rel = q.QUERIES[name](spark, SF), duck.sql(q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.columns, df.collect()) == canonical(rel.columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
