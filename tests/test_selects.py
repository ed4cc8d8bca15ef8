"""Every dialect query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from wideleaf import selects

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", selects.oracle_sql())
def test_select(spark, duck, name):
    got = selects.queries()[name](spark, SF)
    order = sorted(got.columns)
    want = duck.execute(selects.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == order
    expected = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in want.fetchall())
    assert expected and sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == expected
