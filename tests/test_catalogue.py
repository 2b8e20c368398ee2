"""Every registered query against its SQL, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from folioscan.plans.catalogue import ORACLES, QUERIES

from .conftest import SMALL


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) or isinstance(v, int) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name not in ORACLES:
        assert columns
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
