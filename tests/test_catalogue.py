"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ledgerlens.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    if name in catalogue.ORACLE:
        want = duck.execute(catalogue.ORACLE[name]).fetch_df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
