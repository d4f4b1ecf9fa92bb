"""Run registered queries next to their SQL in DuckDB and compare all values.

    python tests/oracle.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(str(_cell(x)) for x in v) + "]"
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "∅"
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "item"):
        return _cell(v.item())
    return str(v)


def rows(frame: pd.DataFrame):
    names = sorted(frame.columns)
    columns = [[_cell(v) for v in frame[n].astype(object).tolist()] for n in names]
    return names, sorted(zip(*columns)) if columns else []


def compare(spark, con, name, sf_dir):
    """None when equal, else what differs."""
    fn, sql = spark_entry.queries()[name], spark_entry.oracle_sql().get(name)
    got_arrow = fn(spark, sf_dir).toArrow()
    got = got_arrow.to_pandas(integer_object_nulls=True)
    if sql is None:
        return None if len(got) else "no rows"
    want = con.sql(sql).arrow()
    want_arrow = want.read_all() if hasattr(want, "read_all") else want
    want = want_arrow.to_pandas(integer_object_nulls=True)
    kinds = [{f.name: str(f.type).replace("large_", "") for f in t.schema} for t in (got_arrow, want_arrow)]
    differ = {k: (v, kinds[1].get(k)) for k, v in kinds[0].items() if v != kinds[1].get(k)}
    if differ:
        print("    types:", differ)
    a, b = rows(got), rows(want)
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows against {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return None if not bad else f"{len(bad)} of {len(a[1])} rows differ, first {bad[0]}"


def main():
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in spark_entry.queries():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
