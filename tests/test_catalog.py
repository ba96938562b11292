"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entrypoint

SF = "/root/testdata/sf0.001"
ORACLE = entrypoint.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _norm(row):
    return tuple(round(v, 5) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(entrypoint.queries()))
def test_query(spark, con, name):
    df = entrypoint.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(_norm(r[c] for c in cols)) for r in df.collect())
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted(repr(_norm(r[names.index(c)] for c in cols)) for r in cur.fetchall())
        assert got == want


def test_entry(spark):
    assert entrypoint.entry(spark).count() > 0
