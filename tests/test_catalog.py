"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import numpy as np
import pytest

from quirewell.plans import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(x, cols):
    x = x[cols].astype(object).where(x[cols].notna(), None)
    plain = lambda v: float(v) if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v
    return sorted(repr(tuple(map(plain, r))) for r in x.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
