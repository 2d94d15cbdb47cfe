"""Every query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from plumbline.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in records], key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
