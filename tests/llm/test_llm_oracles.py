"""The queries that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from gridprint.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_match(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = registry.queries()[name](spark, SF)
    want = c.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(r[k] for k in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[want.columns.index(k)] for k in cols) for r in want.fetchall()), key=repr)
