"""The corpus operators that SQL can state, against their SQL on the smallest tables."""

import os

import duckdb
import pytest
from test_queries import rows

from tidelog.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, want = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want.df())
