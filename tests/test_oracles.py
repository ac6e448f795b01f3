"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, D)
    got = df.collect()
    if name in entry.oracle_sql():
        r = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(got, df.columns) == canonical(r.fetchall(), columns)
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
