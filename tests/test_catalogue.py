"""Every query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if pd.isna(v):
            return None
        return repr(round(float(v), 6)) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=lambda r: tuple(x or "" for x in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.toPandas()) == normal(want.df())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["l_orderkey", "revenue", "tier"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
