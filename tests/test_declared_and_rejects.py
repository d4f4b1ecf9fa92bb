"""Declared dates, rejected lines of a stream, lines with a wrong field count."""

import datetime as dt

import pytest

from colforge.functions.infer import ColumnType
from colforge.sources.csv_ingest import CsvOptions, read_csv, wrong_field_counts
from colforge.streaming.csv_tables import csv_to_tables


def write(path, text):
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_text(text)
    return str(path)


def days(table, *columns):
    return [tuple(r) for r in table.rows.orderBy("__line").select(*columns).collect()]


def test_declared_dates_have_one_order(spark, tmp_path):
    path = write(tmp_path / "us.csv", "day,at,n\n02/03/2024,02/03/2024 10:00:00,1\n01/13/2024,12/31/2023 00:00:00,2\nno date,,3\nN/A,2024-05-06 07:08:09,4\n")
    table = read_csv(spark, path, CsvOptions(types={"day": "date", "at": "datetime"}))
    assert days(table, "day", "at", "n") == [
        (dt.date(2024, 2, 3), dt.datetime(2024, 2, 3, 10), 1), (dt.date(2024, 1, 13), dt.datetime(2023, 12, 31), 2),
        (None, None, 3), (None, dt.datetime(2024, 5, 6, 7, 8, 9), 4),
    ]
    assert table.types["day"] == ColumnType("date", order="mdy") and table.types["n"].kind == "integer"
    path = write(tmp_path / "both.csv", "day\n13/01/2024\n01/13/2024\n")
    with pytest.raises(ValueError, match="column 'day' has dates with the day first"):
        read_csv(spark, path, CsvOptions(types={"day": "date"}))
    told = read_csv(spark, path, CsvOptions(types={"day": ColumnType("date", order="mdy")}))
    assert days(told, "day") == [(None,), (dt.date(2024, 1, 13),)]
    path = write(tmp_path / "open.csv", "day\n02/03/2024\n")
    assert days(read_csv(spark, path, CsvOptions(types={"day": "date"})), "day") == [(dt.date(2024, 3, 2),)]
    path = write(tmp_path / "none.csv", "day,x\n,1\n")
    assert days(read_csv(spark, path, CsvOptions(types={"day": "date", "x": "text"})), "day", "x") == [(None, "1")]


def run(spark, tmp_path, types):
    writer = csv_to_tables(spark, str(tmp_path / "in"), types, str(tmp_path / "rows"), str(tmp_path / "rejects"), files_per_batch=2)
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).select(*types).collect())
    return rows, sorted((r.reason, r.value) for r in spark.read.parquet(str(tmp_path / "rejects")).collect())


def test_every_line_of_a_stream_comes_out_once(spark, tmp_path):
    types = {"id": "integer", "day": ColumnType("date", order="mdy")}
    write(tmp_path / "in" / "a.csv", 'id,day\n1,02/03/2024\n2\n3,01/13/2024,x\n\n# no row\n"4",-\n')
    write(tmp_path / "in" / "b.csv", "day,id\n12/31/2023,5\n")
    write(tmp_path / "in" / "c.csv", "id,other\n6,7\n")
    rows, rejects = run(spark, tmp_path, types)
    first = [(1, dt.date(2024, 2, 3)), (4, None), (5, dt.date(2023, 12, 31))]
    wrong = [("blank", ""), ("comment", "# no row"), ("field count", "2"), ("field count", "3,01/13/2024,x"), ("header", "6,7")]
    assert rows == first and rejects == wrong
    # A later file, a file with a header alone, and the writer of a batch run twice.
    write(tmp_path / "in" / "d.csv", "id,day\n8,13/01/2024\n")
    write(tmp_path / "in" / "e.csv", "id,day\n")
    rows, rejects = run(spark, tmp_path, types)
    assert rows == [*first, (8, None)] and rejects == wrong
    assert run(spark, tmp_path, types) == (rows, rejects)


def test_a_batch_done_again_replaces_itself(spark, tmp_path):
    write(tmp_path / "in" / "a.csv", "id\n1\n2,3\n")
    held = {}

    class Capture:
        def foreachBatch(self, fn):  # noqa: N802
            held["write"] = fn
            return self

    from colforge.streaming import csv_tables

    lines = csv_tables.csv_lines
    try:
        csv_tables.csv_lines = lambda *a: type("Lines", (), {"writeStream": Capture()})
        csv_to_tables(spark, str(tmp_path / "in"), {"id": "integer"}, str(tmp_path / "rows"), str(tmp_path / "rejects"))
    finally:
        csv_tables.csv_lines = lines
    from colforge.sources.csv_ingest import read_lines

    batch = read_lines(spark, str(tmp_path / "in")).drop("__line")
    for _ in range(2):
        held["write"](batch, 0)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "rows")).collect()] == [1]
    assert [r.value for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["2,3"]


def test_lines_with_a_wrong_field_count_are_rows(spark, tmp_path):
    path = write(tmp_path / "x.csv", 'title\na,b\n1,2\n\n3\n"4,4",5,"6""6"\n# c,c,c\n7,8,9,10\n')
    bad = wrong_field_counts(spark, path, 2, CsvOptions(header_row=1)).orderBy("row").collect()
    assert [(r.row, r.fields, r.value) for r in bad] == [(5, 1, "3"), (6, 3, '"4,4",5,"6""6"'), (8, 4, "7,8,9,10")]
    good = write(tmp_path / "good.csv", "a,b\n1,2\n")
    assert wrong_field_counts(spark, good, 2).count() == 0
