"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidelog.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(plain(v) for v in r)).replace("True", "1").replace("False", "0") for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, DATA)
    if name not in plans.oracle_sql():
        assert got.count() >= 0
        return
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want.df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
