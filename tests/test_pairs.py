"""Function queries and store queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from wideleaf import pairs, stored

SF = "/root/testdata/sf0.001"
QUERIES, SQL = pairs.queries() | stored.queries(), pairs.oracle_sql() | stored.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    names = sorted(df.columns)
    one = lambda v: None if pd.isna(v) else str(v)
    return names, sorted(repr([one(v) for v in r]) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = plain(QUERIES[name](spark, SF).toPandas())
    assert got[1] and got == plain(duck.execute(SQL[name]).df())
