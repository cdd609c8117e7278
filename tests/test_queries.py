"""Every query with SQL gives the same rows on another engine, at the smallest scale."""

import glob
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    other = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in other.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, other.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["reference_id", "fault"]
