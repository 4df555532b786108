"""Every query that has SQL against DuckDB, on the smallest data set: same columns, same rows."""

import math
import os

import duckdb
import pytest

from factloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.collect()
    if name not in catalogue.oracle_sql():
        assert rows
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    at = [want.columns.index(c) for c in columns]
    b = sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert a == b
