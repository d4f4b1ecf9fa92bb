"""Values at their limits, files with other headers, intermediates on a cluster, plans."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from colforge import query as q
from colforge import session
from colforge.functions.infer import ColumnType, infer_types
from colforge.operators import computed, groups, stats, timebin
from colforge.sources.csv_ingest import CsvOptions, read_csv
from conftest import column

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize(
    "name",
    ["bin_absolute_third", "group_equals_bigint", "summary_nan", "histogram_nan", "convert_dates_us", "csv_folder_headers", "csv_quoted_rows", "project_partitioned", "stream_keyed_batches", "arrow_unsigned", "dup_full_steps"],
)
def test_against_sql(spark, name):
    from oracle import compare, connect

    assert compare(spark, connect(SMALL), name, SMALL) is None


def test_late_text_keeps_its_column_a_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f"{i},{i if i < 2500 else 'x'}\n" for i in range(2600)))
    table = read_csv(spark, str(tmp_path / "t.csv"))
    assert table.types["v"].kind == "text" and table.rows.where("v IS NULL").count() == 0


def test_folder_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n20,10\n")
    (tmp_path / "c.csv").write_text("x,y\n3,4\n")
    (tmp_path / "d.csv").write_text("x,z\n5,6\n")
    table = read_csv(spark, str(tmp_path), CsvOptions(types={"x": ColumnType("integer")}))
    assert sorted(map(tuple, table.rows.select("x", "y").collect())) == [(1, 2), (3, 4), (10, 20)]
    assert [(r.reason, r.value) for r in table.rejects.select("reason", "value").collect()] == [("header", "5,6")]


def test_one_order_of_day_and_month(spark):
    df = spark.createDataFrame([("01/13/2024", "1/2/2024 1:02:03", "01/02/2024"), ("02/03/2024", "1/13/2024 1:02:03", "13/02/2024")], "us string, stamp string, eu string")
    found = infer_types(df)
    assert (found["us"].order, found["stamp"].order, found["eu"].order) == ("mdy", "mdy", "dmy")


@pytest.mark.parametrize("size, want", [(0.1, [0, 17, -1]), (1 / 3, [0, 5, -1]), ("0.0000001", [0, 17500000, -10]), (2, [0, 0, -1])])
def test_bins_of_any_size(spark, size, want):
    df = spark.createDataFrame([(0,), (1_750_000,), (-1,)], "us long").select(F.timestamp_micros("us").alias("t"), "us")
    got = {r.us: r.bin for r in timebin.bin_absolute(df, "t", size).collect()}
    assert [got[0], got[1_750_000], got[-1]] == want


def test_values_are_compared_in_their_own_type(spark):
    df = spark.createDataFrame([(1, 9007199254740992), (2, 9007199254740993), (3, None)], "id long, n long")
    hits = lambda v: column(groups.add_groups(df, groups.value_equals("n", v, "g"), order_by=["id"]), "g")
    assert hits(9007199254740993) == [-1, 1, -1] and hits("9007199254740992") == [1, -1, -1]
    assert hits(0.5) == hits("word") == hits(float("nan")) == [-1, -1, -1]


def test_nan_is_left_out_everywhere(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    row = stats.summary(df, ["v"]).first()
    assert (row["values"], row["min"], row["max"], row["mean"], row["median"], row["std"]) == (2, 1.0, 2.0, 1.5, 1.5, 0.5)
    assert stats.nan_counts(df, ["v"]).first()["nans"] == 1
    assert sum(r["rows"] for r in stats.histogram(df, "v", 2).collect()) == 2


def test_pages_by_key(spark):
    rows = [(None, 1), (None, 2), ("a", 1), ("a", 3), ("b", 0)]
    df = spark.createDataFrame(rows, "k string, n int")
    seen, after = [], None
    while page := list(map(tuple, q.page_after(df, ["k", "n"], after, 2).collect())):
        seen += page
        after = page[-1]
    assert seen == rows


def test_samples_with_equal_keys(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    got = stats.systematic_sample(df, 100, order_by="k")
    assert got.count() == 100 and got.select("id").distinct().count() == 100 and got.columns == ["k", "id"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)
    context.getCheckpointDir = lambda: "hdfs://store/work/"
    assert session.shared_dir(spark) == "hdfs://store/work"


def test_a_delta_shuffles_its_rows_once(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7 % 13).alias("v"))
    plan = computed.delta(df, "v", order_by="id", buckets=4)._jdf.queryExecution().executedPlan().toString()
    # One for the rows, one for the few rows of state that join them.
    assert plan.count("REPARTITION_BY_NUM") <= 2
