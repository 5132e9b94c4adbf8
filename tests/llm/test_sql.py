"""The operators that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from tideline.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        duck.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)
