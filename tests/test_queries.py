"""Every query runs on the smallest tables and equals its SQL there."""

import decimal
import os

import duckdb
import pytest

from lumbrera.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return int(v) if isinstance(v, bool) else v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert table(df.columns, rows) == table(names, want.fetchall())
