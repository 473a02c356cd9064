"""Every catalogue query against its DuckDB oracle on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans.catalogue import QUERIES
from ledgerloom.plans.oracle import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())
    assert got == want


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
