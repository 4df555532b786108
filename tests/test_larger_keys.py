"""Queries against their SQL on tables that the smallest data set does not have: larger keys, series that begin at zero."""

import duckdb

from factloom.operators.hits import Known, block_hits
from factloom.plans import catalogue
from test_catalogue import plain


def same_rows(spark, folder, name, **tables):
    """Whether a query gives the rows of its SQL on these tables (name: data frame), and the rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(folder))
    want = con.sql(catalogue.oracle_sql()[name])
    at = [want.columns.index(c) for c in got.columns]
    a = sorted(tuple(map(plain, r)) for r in got.collect())
    return a == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall()), a


def test_grids_of_series_that_begin_at_zero(spark, tmp_path):
    series = {1: (0.0, 8.0), 2: (0.0, 0.0), 3: (2.0, 512.0), 4: (-4.0, -1.0), 5: (-4.0, 4.0), 6: (None, None), 7: (None, 0.0), 8: (float("nan"), 0.0), 9: (float("inf"), 0.0)}
    events = spark.createDataFrame([(u, v) for u, pair in series.items() for v in pair], "user_id long, value double")
    same, rows = same_rows(spark, tmp_path, "sampling_grid", events=events)
    assert same and len(rows) == 81
    assert ("1", "8", "8", "nan") in rows and ("1", "0", "0", "0") in rows and ("3", "4", "257", "32") in rows


def test_design_values_of_longer_numbers(spark, tmp_path):
    keys = (0, 19_999, 99_899, 99_900, 1_199_999, 10**12, 10**18)
    part = spark.createDataFrame([(k + n, n % 5) for k in keys for n in range(5)], "p_partkey long, p_size int")
    same, rows = same_rows(spark, tmp_path, "design_values", part=part)
    assert same and len(rows) == 35 and (str(10**18 + 2), "BC1000000000000000102", "part") in rows


def test_page_hits_of_longer_numbers(spark, tmp_path):
    keys = (0, 6_999, 7_000, 59_999, 10**9, 10**14, 10**18)
    lines = [(n, page, k + page, line, 10.0, 0.0, 0.0, "N") for n, (page, k, line) in enumerate((page, k, line) for page in (1, 4, 8) for k in keys for line in range(1, 8))]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string")
    part = spark.createDataFrame([(1,), (4,), (8,)], "p_partkey long")
    same, rows = same_rows(spark, tmp_path, "page_hits", lineitem=lineitem, part=part)
    found = {r[1] for r in rows}
    assert same and {"2N3001A", "2N10000A", "2N63000A", "2N1000003001A", "2N100000000003001A", "2N1000000000000003001A"} <= found


def test_longer_numbers_of_a_text():
    found = [(h.part, h.base, h.conf) for h in block_hits("2N10000A, 2n62999 3N123456789012345b/2 2N3055 2N12345678901234567AB", Known(), False)]
    assert found == [("2N10000A", "2N10000", "high"), ("2N62999", "2N62999", "high"), ("3N123456789012345B", "3N123456789012345", "high"), ("2N3055", "2N3055", "high")]
