"""The driver contract, and a few registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as spark_entry

SMALL = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_entry_and_oracles(spark):
    from oracle import compare, connect

    assert spark_entry.entry(spark).count() > 0
    con = connect(SMALL)
    for name in ("bin_gap", "group_hierarchy", "dup_marker_clean", "moving_avg_by_user", "sql_subqueries", "csv_null_tokens", "summary_selected"):
        assert compare(spark, con, name, SMALL) is None, name
