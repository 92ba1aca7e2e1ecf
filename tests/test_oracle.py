"""Every catalogued query against its DuckDB text on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

from tessera.queries import CATALOG

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_matches_oracle(spark, duck, name):
    run, sql = CATALOG[name]
    df = run(spark, FOLDER)
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert have == want
