import datetime as dt
import os

import pyarrow as pa
import pytest
from conftest import column
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from colforge import query
from colforge.functions import infer
from colforge.functions.infer import header_unit
from colforge.sources import arrow_ipc, csv_ingest, project
from colforge.sources.csv_ingest import LINE, CsvOptions, read_csv
from colforge.streaming import streams


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


MESSY = """junk line
more junk, with comma
id;name;dur (ms);flag;when;t;x;x;;n
1;"a; b";10;yes;2024-02-29 10:00:00;00:00:30.5;1.5;q;z;-
# comment
2; c ;20;no;2024-03-01T11:00:00.25;23:59:59.999;2;N/A;;NULL
short;row

3;d;30;y;1999-12-31 00:00:00;-;;w;z;n/a
4;e;40;n;bad
5;f;;1;2100-03-01 00:00:00;00:00:00;-7;w;z;
"""


def test_messy_csv(spark, tmp_path):
    got = read_csv(spark, write(tmp_path / "m.csv", MESSY), CsvOptions(header_row=2))
    assert got.delimiter == ";"
    assert got.names == ["id", "name", "dur (ms)", "flag", "when", "t", "x", "x_1", "col_8", "n"]
    assert [got.types[n].kind for n in got.names] == ["integer", "text", "time_ms", "boolean", "datetime", "time_ms", "real", "text", "text", "text"]
    rows = [tuple(r)[:10] for r in got.rows.orderBy("id").collect()]
    assert rows[0] == (1, "a; b", 10_000, True, dt.datetime(2024, 2, 29, 10), 30_500_000, 1.5, "q", "z", None)
    assert rows[1] == (2, "c", 20_000, False, dt.datetime(2024, 3, 1, 11, 0, 0, 250_000), 86_399_999_000, 2.0, None, None, None)
    assert [r[4].year for r in rows[2:]] == [1999, 2100]
    assert [(r["reason"], r["value"]) for r in got.rejects.orderBy(*LINE).collect()] == [
        ("comment", "# comment"), ("field count", "short;row"), ("blank", ""), ("field count", "4;e;40;n;bad")]


def test_csv_options(spark, tmp_path):
    path = write(tmp_path / "m.csv", MESSY)
    got = read_csv(spark, path, CsvOptions(header_row=2, columns=["id", "n", "flag"], types={"flag": "text", "id": "real"}, text_null_as_empty=True))
    assert got.names == ["id", "flag", "n"]
    assert [tuple(r)[:3] for r in got.rows.orderBy("id").collect()] == [(1.0, "yes", ""), (2.0, "no", ""), (3.0, "y", ""), (5.0, "1", "")]
    plain = read_csv(spark, write(tmp_path / "p.csv", '1|"a|b\n2|c|d\n'), CsvOptions(header_row=None, quotes=False))
    assert plain.names == ["col_0", "col_1", "col_2"] and plain.rows.count() == 2
    with pytest.raises(ValueError, match="no such column"):
        read_csv(spark, path, CsvOptions(header_row=2, columns=["nope"]))
    with pytest.raises(ValueError, match="only"):
        read_csv(spark, path, CsvOptions(header_row=99))
    assert csv_ingest.preview(spark, path, 3) == MESSY.splitlines()[:3]


def test_header_in_every_file(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"part{i}.csv", "note\na,b\n" + "".join(f"{i * 10 + j},{j}.5\n" for j in range(4)) + "a,b\n" * (i == 1))
    got = read_csv(spark, str(tmp_path / "part*.csv"), CsvOptions(header_row=1, types={"a": "text", "b": "text"}))
    values = sorted(r["a"] for r in got.rows.collect())
    assert values == sorted([str(i * 10 + j) for i in range(3) for j in range(4)] + ["a"]), "a later line equal to the header is data"


def test_big_file_in_many_splits(spark, tmp_path):
    path = write(tmp_path / "big.csv", "skip\nn,t\n" + "".join(f"{i},{i % 7}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = read_csv(spark, path, CsvOptions(header_row=1))
        assert got.rows.rdd.getNumPartitions() > 4
        ordered = [r["n"] for r in got.rows.orderBy(*LINE).select("n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered == list(range(20_000))


def test_folder_and_count_check(spark, tmp_path):
    write(tmp_path / "2024 sales.csv", "a,b\n1,2\n")
    write(tmp_path / "x-y.csv", "a\tb\n1\t2.5\n")
    tables = csv_ingest.read_folder(spark, str(tmp_path))
    assert sorted(tables) == ["t_2024_sales", "x_y"]
    assert tables["x_y"].types["b"].kind == "real"
    assert csv_ingest.read_simple(spark, str(tmp_path / "x-y.csv"), "\t").schema.simpleString() == "struct<a:bigint,b:double>"
    path = write(tmp_path / "bad.csv", "a,b\n1,2\n3\n")
    csv_ingest.check_field_count(spark, str(tmp_path / "x-y.csv"), 2)
    with pytest.raises(ValueError, match="1 lines do not have 2 fields"):
        csv_ingest.check_field_count(spark, path, 2)


def test_names():
    assert csv_ingest.unique_names(["a", "A", "", "a", "a_1"]) == ["a", "A_1", "col_2", "a_2", "a_1_1"]
    assert csv_ingest.infer_delimiter("a;b;c,d") == ";" and csv_ingest.infer_delimiter("abc") == ","
    assert csv_ingest.table_name("/x/my file.v2.csv") == "my_file_v2"


@pytest.mark.parametrize("name, unit", [("section", None), ("milliseconds", "ms"), ("duration (ms)", "ms"), ("t (s)", "s"), ("sec", "s"), ("usec", "us"), ("nanoseconds", "ns"), ("items", None)])
def test_header_unit(name, unit):
    assert header_unit(name) == unit


CASES = {
    "integer": ["1", "-5", "30"], "real": ["1.5", "2", ".5", "1e3"], "boolean": ["yes", "N", "1"], "date": ["2024-02-29", "31/12/1999"],
    "datetime": ["2024-02-29 10:00:00", "2024-01-01T00:00:00Z", "2024/05/06 07:08"], "time_s": ["10:00:00"], "time_ms": ["10:00:00.5"],
    "time_us": ["10:00:00.1234"], "text": ["a", "1"],
}


def test_infer_kinds(spark):
    data = {k: (v * 3)[:3] for k, v in CASES.items()}
    data |= {"empty": [None] * 3, "bad_date": ["2023-02-29", "2024-01-01", None], "long_digits": ["12345678901234567890", "1", "2"], "section": ["5", "6", "7"], "milliseconds": ["5", "x", "7"]}
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} string" for c in data))
    got = {c: t.kind for c, t in infer.infer_types(df).items()}
    assert {k: got[k] for k in CASES} == {k: k for k in CASES}
    assert (got["empty"], got["bad_date"], got["section"], got["milliseconds"]) == ("text", "text", "integer", "text")
    assert got["long_digits"] == "real", "whole numbers beyond 64 bits keep their size"


def test_late_surprise_changes_the_type(spark):
    """A value far behind the first rows counts as much as an early one."""
    df = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") == 4321, "oops").otherwise(F.col("id").cast("string")).alias("v"))
    assert infer.infer_types(df)["v"].kind == "text"


def test_validate_and_pad(spark):
    df = spark.createDataFrame([("1",), ("x",), ("-",), ("2.5",), (None,)], "v string")
    assert sorted(r["v"] for r in infer.invalid_values(df, "v", "integer").collect()) == ["2.5", "x"]
    assert infer.invalid_values(df, "v", "text").count() == 0
    t = spark.createDataFrame([(1, "1:00:00"), (2, "02:00:00.25"), (3, "")], "id int, t string")
    assert column(infer.pad_times(t, "t"), "t") == ["1:00:00.00", "02:00:00.25", ""]


def test_convert(spark):
    text = {"datetime": "1704067200", "time_s": "90", "time_ns": "5000", "boolean": "No", "integer": "9223372036854775808", "real": "-inf"}
    df = spark.range(1).select(*[infer.convert(F.lit(v), k).alias(k) for k, v in text.items()])
    assert tuple(df.first()) == (dt.datetime(2024, 1, 1), 90_000_000, 5, False, None, float("-inf"))


# --- Arrow and projects ---------------------------------------------------------------------------


def arrow_table():
    return pa.table(
        {
            "i": pa.array([1, 2, None], pa.int32()),
            "t": pa.array([1000, None, 86_399_999], pa.time32("ms")),
            "ts": pa.array([1, 2, 3], pa.timestamp("s")),
            "d": pa.array(["a", "b", "a"]).dictionary_encode(),
            "u": pa.array([1, 2, 3], pa.uint16()),
        }
    )


def test_arrow_read(spark, tmp_path):
    arrow_ipc.register(spark)
    t = arrow_table()
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t.slice(0, 2))
        w.write_table(t.slice(2))
    df = spark.read.format("arrow_ipc").option("position", "true").load(str(tmp_path / "a.arrow"))
    assert df.rdd.getNumPartitions() == 2, "one task per batch"
    rows = df.orderBy(*arrow_ipc.POSITION).collect()
    assert [tuple(r)[:5] for r in rows] == [
        (1, 1_000_000, dt.datetime(1970, 1, 1, 0, 0, 1), "a", 1), (2, None, dt.datetime(1970, 1, 1, 0, 0, 2), "b", 2),
        (None, 86_399_999_000, dt.datetime(1970, 1, 1, 0, 0, 3), "a", 3)]
    with pa.OSFile(str(tmp_path / "s.arrows"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t, max_chunksize=1)
    assert spark.read.format("arrow_ipc").option("layout", "stream").load(str(tmp_path / "s.arrows")).count() == 3


def test_arrow_write(spark, tmp_path):
    arrow_ipc.register(spark)
    df = spark.range(0, 50, 1, 5).withColumn("s", F.col("id").cast("string"))
    path = str(tmp_path / "out")
    project.export_arrow(df, path)
    project.export_arrow(df.limit(0), path)
    back = spark.read.format("arrow_ipc").load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    project.export_arrow(df.filter("id < 7"), path, "overwrite")
    assert spark.read.format("arrow_ipc").load(path).count() == 7
    assert not [f for f in os.listdir(path) if f.startswith(".")]


def test_project(spark, tmp_path):
    p = project.Project(spark, str(tmp_path / "proj"))
    assert p.open() == []
    p.save("nums", spark.range(5).withColumn("v", F.col("id") * 2))
    p.append("nums", spark.createDataFrame([(9,)], "id long"))
    assert p.load("nums").count() == 6 and p.load("nums", limit=2).count() == 2
    with pytest.raises(ValueError, match="no column"):
        p.append("nums", spark.createDataFrame([(9,)], "zz long"))
    p.replace("nums", spark.range(3).withColumn("v", F.lit(1)))
    assert p.info("nums")["rows"] == 3 and [c["name"] for c in p.info("nums")["columns"]] == ["id", "v"]
    p.declare("later", {"a": "INT", "b": "VARCHAR", "c": "TIMESTAMP", "d": "what"})
    assert p.load("later").schema.simpleString() == "struct<a:bigint,b:string,c:timestamp_ntz,d:string>"
    p.save_derived("nums_with_w", p.load("nums").withColumn("w", F.lit(2)), "nums", {"op": "w"})
    note = p.derived_note("nums_with_w").first()
    assert (note["source"], note["rows"], note["columns_added"]) == ("nums", 3, ["w"])
    os.makedirs(tmp_path / "proj" / "broken")
    write(tmp_path / "proj" / "broken" / "x.parquet", "not parquet")
    again = project.Project(spark, str(tmp_path / "proj"))
    assert again.open() == ["later", "nums", "nums_with_w"]
    with pytest.raises(KeyError):
        again.load("broken")
    assert spark.sql("SELECT count(*) FROM nums").first()[0] == 3


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 2.5), (2, None, None), (3, "", 1.0)], "id int, s string, v double")
    project.export_csv(df, str(tmp_path / "csv"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "csv")).distinct().collect())
    assert lines == ['1,"say ""hi""",2.5', "2,,", '3,"",1.0', "id,s,v"], "NULL and an empty text stay apart"
    project.export_json(df, str(tmp_path / "json"), stringify=True)
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "json")).collect()) == ["1", "2", "3"]


# --- SQL ------------------------------------------------------------------------------------------


def test_sql(spark):
    spark.createDataFrame([(1, "A"), (2, None), (3, "B")], "id int, category_3 string").createOrReplaceTempView("test_data")
    assert query.run_sql(spark, 'SELECT "id" FROM test_data WHERE "category_3" = \'A\'').collect()[0][0] == 1
    assert query.schema_of(spark, "SELECT id AS n FROM test_data").simpleString() == "struct<n:int>"
    assert query.run_sql(spark, "SELECT id FROM test_data WHERE id > :low", low=1).count() == 2
    assert query.run_sql(spark, "SELECT id FROM test_data WHERE id == 1").count() == 1
    for text, error in [("SELECT * FORM test_data", ParseException), ("SELECT nope FROM test_data", AnalysisException), ("SELECT * FROM gone", AnalysisException), ('SELECT * FROM test_data WHERE category_3 = "A"', AnalysisException)]:
        with pytest.raises(error):
            query.run_sql(spark, text)
    described = query.describe_table(spark, "test_data").orderBy("position").collect()
    assert [(r["column_name"], r["data_type"]) for r in described] == [("id", "int"), ("category_3", "string")]


@pytest.mark.parametrize("page, size", [(0, 10), (2, 10), (4, 10), (10, 10), (0, 100), (1, 7)])
def test_pages(spark, page, size):
    got = query.paginate(spark.range(45), page, size, ["id"])
    assert got.total_rows == 45 and got.pages == -(-45 // size)
    assert [r[0] for r in got.rows.collect()] == list(range(45))[page * size : (page + 1) * size]


def test_empty_page_and_warning(spark):
    assert query.paginate(spark.range(5).filter("id > 9"), 0, 5, ["id"]).total_rows == 0
    with pytest.warns(UserWarning, match="order_by"):
        query.page_rows(spark.range(5), 0, 2)


def test_guided_tools(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 2)], "id int, v int")
    assert [r[0] for r in query.sort_rows(df, ["-v"]).collect()] == [1, 3, 2]
    assert [r[0] for r in query.sort_rows(df, ["v"], nulls="first").collect()] == [2, 3, 1]
    assert query.filter_rows(df, [("v", "is null"), ("id", ">", 2)], match="any").count() == 2
    with pytest.raises(ValueError):
        query.filter_rows(df, [("v", "~", 1)])


# --- streams --------------------------------------------------------------------------------------


def test_keyed_running_over_batches(spark, tmp_path):
    """Three micro-batches give the same as one batch; a repeated batch would overwrite its own output."""
    source = tmp_path / "in"
    values = [(i, "ab"[i % 3 == 0], None if i == 5 else i * i) for i in range(18)]
    for b in range(3):
        spark.createDataFrame(values[b * 6 : b * 6 + 6], "id int, k string, v long").coalesce(1).write.mode("append").parquet(str(source))
        os.utime(next(p for p in sorted(source.glob("*.parquet"), key=os.path.getmtime)[-1:]), (1_700_000_000 + b, 1_700_000_000 + b))
    stream = spark.readStream.schema("id int, k string, v long").option("maxFilesPerTrigger", 1).parquet(str(source))
    writer = streams.keyed_running(stream, "v", keys=["k"], order_by=["id"], output=str(tmp_path / "out"), state=str(tmp_path / "state"))
    streams.drain(writer, str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert len({r["batch"] for r in got}) == 3
    last, total = {}, {}
    for (i, k, v), r in zip(values, got):
        want = v - last[k] if k in last and v is not None and last[k] is not None else None
        total[k] = total.get(k, 0) + (v or 0)
        assert (r["delta"], r["total"]) == (want, None if v is None else total[k]), i
        last[k] = v


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", "id,at,v\n1,2024-01-01 10:00:00,1.5\n2,N/A,-\n")
    stream = streams.csv_stream(spark, str(tmp_path / "in"), {"id": "integer", "at": "datetime", "v": "real"})
    streams.drain(streams.absolute_bins(stream, "at", 3600), str(tmp_path / "cp"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, dt.datetime(2024, 1, 1, 10), 1.5, 473362), (2, None, None, None)]


def test_recursion_reaches_every_order(spark, tmp_path):
    """More rounds than Spark allows by default, and customers beyond the fiftieth."""
    from colforge.queries import QUERIES

    rows = [(7, 10 * k) for k in range(130)] + [(c, 5000 + c) for c in range(60, 90)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["sql_recursive_all"][0](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((c, o, o // 10 + 1 if c == 7 else 1) for c, o in rows)


def test_a_round_of_the_recursion_shuffles_no_links(spark, tmp_path, monkeypatch):
    """The links are read in the buckets of the join, in several files, and nothing stays in the catalog."""
    from colforge import session
    from colforge.queries import QUERIES

    monkeypatch.setattr(session, "BUCKET_ROWS", 40, raising=False)
    rows = [(c, 1000 * c + 7 * k) for c in range(60) for k in range(c % 9 + 1)] + [(None, 5), (99, None)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = spark.catalog.listTables()
        got = QUERIES["sql_recursive_all"][0](spark, str(tmp_path))
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame([(c, o, o % 1000 // 7 + 1 if c not in (None, 99) else 1) for c, o in rows], got.schema).collect())
        links = spark.table("recursive_links")
        reached = spark.createDataFrame(rows, "c long, o long")
        plan = links.join(reached, (F.col("o_custkey") == F.col("c")) & (F.col("before") == F.col("o")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and links.inputFiles()[1:]
        assert {t.name for t in spark.catalog.listTables()} - {t.name for t in before} <= {"recursive_links"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
