import pytest
from conftest import column
from pyspark.sql import functions as F

from colforge.operators import computed, groups, timebin
from colforge.operators.computed import Request

A = [100.0, 150.0, 120.0, 180.0, 200.0, 160.0, 190.0, 210.0, 170.0, 220.0]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(i + 1, a, a / 10) for i, a in enumerate(A)], "id int, value_a double, value_b double").cache()


@pytest.fixture(scope="module")
def kinds(spark):
    rows = zip(range(1, 11), "AAABBBCCAA", "aaiaaiaaia", [None if i % 2 == 0 and i > 0 else "d" for i in range(10)])
    status = {"a": "active", "i": "inactive"}
    return spark.createDataFrame([(i, c, status[s], o) for i, c, s, o in rows], "id int, category string, status string, optional_field string").cache()


def test_delta(spark, numbers):
    assert column(computed.delta(numbers, "value_a", "d", order_by="id"), "d") == [None, 50, -30, 60, 20, -40, 30, 20, -40, 50]
    four = spark.createDataFrame([(i, v) for i, v in enumerate([100, 200, 300, 400])], "id int, v int")
    out = computed.delta(four, "v", "d", order_by="id")
    assert column(out, "d") == [None, 100, 100, 100]
    assert out.schema["d"].dataType.simpleString() == "int"


def test_delta_variants(spark, numbers):
    assert column(computed.delta_from_first(numbers, "value_a", "d", order_by="id"), "d") == [a - 100 for a in A]
    assert column(computed.delta_offset(numbers, "value_a", 2, "d", order_by="id"), "d") == [None, None] + [b - a for a, b in zip(A, A[2:])]


def test_cumsum_ratio_average(numbers):
    assert column(computed.cumulative_sum(numbers, "value_a", "c", order_by="id"), "c") == [100, 250, 370, 550, 750, 910, 1100, 1310, 1480, 1700]
    assert column(computed.ratio(numbers, "value_a", "value_b", "r"), "r") == pytest.approx([10.0] * 10)
    mean = column(computed.moving_average(numbers, "value_a", "m", 3, order_by="id"), "m")
    assert mean[:4] == pytest.approx([100, 125, 370 / 3, 150])


def test_order_free(spark, numbers):
    pct = column(computed.percent_of_total(numbers, "value_a", "p"), "p")
    assert sum(pct) == pytest.approx(100) and pct[0] == pytest.approx(100 / 17)
    z = column(computed.z_score(numbers, "value_a", "z"), "z")
    assert sum(z) == pytest.approx(0, abs=1e-9)
    flat = spark.createDataFrame([(1, 0.0, 3.0), (2, 0.0, None), (3, 0.0, 3.0)], "id int, zero double, v double")
    assert column(computed.percent_of_total(flat, "zero", "p"), "p") == [None] * 3
    assert column(computed.z_score(flat, "v", "z"), "z") == [None] * 3
    assert column(computed.ratio(flat, "v", "zero", "r"), "r") == [None] * 3


def test_null_modes(spark):
    df = spark.createDataFrame(list(enumerate([5, None, 7, None, None, 10])), "id int, v int").cache()

    def run(op, **k):
        return column(op(df, "v", "o", order_by="id", **k), "o")

    assert run(computed.delta) == [None] * 6
    assert run(computed.delta, nulls="skip") == [None, None, 2, None, None, 3]
    assert run(computed.delta, nulls="zero") == [None, -5, 7, -7, 0, 10]
    assert run(computed.cumulative_sum) == [5, None, 12, None, None, 22]
    assert run(computed.cumulative_sum, nulls="skip") == [5, 5, 12, 12, 12, 22]
    assert run(computed.moving_average, window=2) == [5, None, 7, None, None, 10]
    assert run(computed.moving_average, window=2, nulls="skip") == [5, 5, 7, 7, None, 10]
    assert run(computed.moving_average, window=2, nulls="zero") == [5, 2.5, 3.5, 3.5, 0, 5]
    skip = column(computed.percent_of_total(df, "v", "p", nulls="skip", order_by="id"), "p")
    assert skip == pytest.approx([100 * x / 41 for x in (5, 5, 7, 7, 7, 10)])


def test_row_ids(kinds):
    out = computed.row_id(kinds, order_by="id", group_columns=["category"])
    assert column(out, "row_id") == list(range(10))
    assert column(out, "row_id_group") == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_compute_pipeline(numbers):
    steps = [
        Request("delta", ["value_a"], "d"),
        Request("cumsum", ["value_a"], "c"),
        Request("cumsum", ["d"], "back"),
        Request("ratio", ["c", "value_a"], "r"),
        Request("expression", [], "e", options={"text": "coalesce(back, 0) + 100"}),
    ]
    out = computed.compute(numbers, steps, order_by="id")
    assert column(out, "e") == A
    assert column(out, "r")[1] == pytest.approx(250 / 150)


def test_checks(numbers, kinds):
    with pytest.raises(ValueError, match="not a numeric"):
        computed.delta(kinds, "category", "d", order_by="id")
    with pytest.raises(ValueError, match="taken"):
        computed.delta(numbers, "value_a", "value_b", order_by="id")
    with pytest.raises(ValueError, match="output names"):
        computed.delta(numbers, ["value_a", "value_b"], ["d"], order_by="id")
    with pytest.raises(ValueError, match="nulls"):
        computed.delta(numbers, "value_a", "d", order_by="id", nulls="drop")


def ids(df, *rules):
    return [column(groups.add_groups(df, list(rules), order_by="id"), r.out) for r in rules]


def test_group_rules(kinds):
    change, place, b, active, empty = ids(
        kinds,
        groups.value_change("category", "g1"),
        groups.value_change("category", "g2", reset=True),
        groups.value_equals("category", "B", "g3"),
        groups.value_equals("status", "active", "g4"),
        groups.is_empty("optional_field", "g5"),
    )
    assert change == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert place == [0, 1, 2, 0, 1, 2, 0, 1, 0, 1]
    assert b == [-1, -1, -1, 1, 1, 1, -1, -1, -1, -1]
    assert active == [1, 1, -1, 2, 2, -1, 3, 3, -1, 4]
    assert empty == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_group_examples(spark):
    t = spark.createDataFrame(list(enumerate(["00:00:00.000"] * 3 + ["00:00:01.000"] * 2 + ["00:00:02.000"])), "id int, good_time string")
    assert ids(t, groups.value_change("good_time", "g"), groups.value_change("good_time", "r", reset=True)) == [[0, 0, 0, 1, 1, 2], [0, 1, 2, 0, 1, 0]]
    d = spark.createDataFrame(list(enumerate(["", "00:01:30.000", "00:02:45.000", None, "00:01:15.000", ""])), "id int, dumb_time string")
    assert ids(d, groups.is_empty("dumb_time", "g"), groups.is_empty("dumb_time", "r", reset=True)) == [[0, 0, 0, 1, 1, 2], [0, 1, 2, 0, 1, 0]]


def test_typed_comparison(spark):
    df = spark.createDataFrame([(1, 200.0), (2, 200.001), (3, 200.0), (4, None), (5, None)], "id int, v double")
    equals, change = ids(df, groups.value_equals("v", "200", "e"), groups.value_change("v", "c"))
    assert equals == [1, -1, 2, -1, -1]
    assert change == [0, 1, 2, 3, 3]
    ts = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'2024-01-01 10:00:00' AS t UNION ALL SELECT 2, TIMESTAMP_NTZ'2024-01-02 10:00:00'")
    assert ids(ts, groups.value_change("t", "c")) == [[0, 1]]


def test_rule_reads_earlier_rule(kinds):
    out = groups.add_groups(kinds, [groups.value_change("category", "g"), groups.value_change("g", "h", reset=True)], order_by="id")
    assert column(out, "h") == [0, 1, 2, 0, 1, 2, 0, 1, 0, 1]


def test_hierarchy(kinds):
    out = groups.hierarchy(kinds, groups.value_change("category", "block"), groups.value_change("status", "part"), order_by="id")
    assert column(out, "block") == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert column(out, "part") == [0, 0, 1, 0, 0, 1, 0, 0, 0, 1]
    assert column(out, "sequence") == [0, 1, 0, 0, 1, 0, 0, 1, 0, 0]


TIMES = {
    "00:00:00.000": 0, "00:00:30.500": 30, "01:30:45.123": 5445, "23:59:59.999": 86399, "12:00:00": 43200, "00:00": 0,
    "12:30": 45000, "1234567890": 1234567890, "2024-01-01T12:00:00": 1704110400, "2024-01-01T12:00:00.123": 1704110400,
    "2024-01-01T12:00:00Z": 1704110400, "2024-01-01T12:00:00+02:00": 1704103200, "2024-02-29 00:00:00": 1709164800,
    "1999-12-31 00:00:00": 946598400, "2100-03-01 00:00:00": 4107542400, "2023-02-29 00:00:00": None, "not a time": None,
    "25:00:00": None, "12:60:00": None, "": None, "-": None,
}


def test_time_parsing(spark):
    from colforge.functions.timeparse import clock_text, micros_of_day, pad_fraction, parse_seconds

    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = {r[0]: r[1] for r in df.select("t", parse_seconds(F.col("t"))).collect()}
    assert got == TIMES
    c = spark.createDataFrame([("00:00:30.5",), ("23:59:59.999999",), ("7:08:09",)], "t string")
    assert [r[0] for r in c.select(micros_of_day(F.col("t"))).collect()] == [30_500_000, 86_399_999_999, 25_689_000_000]
    assert [r[0] for r in c.select(clock_text(micros_of_day(F.col("t")), 3)).collect()] == ["00:00:30.500", "23:59:59.999", "07:08:09.000"]
    assert [r[0] for r in c.select(pad_fraction(F.col("t"), 3)).collect()] == ["00:00:30.500", "23:59:59.999", "7:08:09.000"]


def test_durations():
    from colforge.functions.timeparse import boundary_seconds, duration_seconds

    assert [duration_seconds(t) for t in ("90", "09:00", "01:00:00", 15)] == [90, 540, 3600, 15]
    assert [boundary_seconds(t) for t in ("09:00", "09:00:30", 60)] == [32400, 32430, 60]
    with pytest.raises(ValueError):
        duration_seconds("a:b")


def test_bins(spark):
    times = ["00:00:00.000", "00:00:00.200", "00:00:30.000", "00:01:00.000", "00:30:00.000", "01:00:00.000", "02:00:00.000", ""]
    df = spark.createDataFrame(list(enumerate(times)), "id int, t string").cache()
    assert column(timebin.bin_relative(df, "t", 30), "bin") == [0, 0, 1, 2, 60, 120, 240, -1]
    assert column(timebin.bin_relative(df, "t", "1h"), "bin") == [0, 0, 0, 0, 0, 1, 2, -1]
    assert column(timebin.bin_manual(df, "t", ["01:00", "00:00:30"]), "bin") == [0, 0, 1, 1, 1, 2, 2, -1]
    gaps = timebin.bin_gaps(df, "t", 60, order_by="id")
    assert column(gaps, "gap_id") == [0, 0, 0, 0, 1, 2, 3, -1]
    row = timebin.bin_preview(timebin.bin_relative(df, "t", "1h")).first()
    assert tuple(row) == (8, 1, 3, 1, 5, 7 / 3)
    labels = {r["label"]: r["rows"] for r in timebin.bin_counts(timebin.bin_relative(df, "t", "1h")).collect()}
    assert labels == {"0": 5, "1": 1, "2": 1, "Invalid": 1}


def test_gap_file(spark):
    """Epoch seconds with 60 s and 680 s steps."""
    t = [1640995200 + s for s in (0, 60, 120, 800, 860, 920, 1600, 1660)]
    df = spark.createDataFrame(list(enumerate(t)), "id int, timestamp long")
    assert column(timebin.bin_gaps(df, "timestamp", 300, order_by="id"), "gap_id") == [0, 0, 0, 1, 1, 1, 2, 2]
    assert column(timebin.bin_gaps(df, "timestamp", 680, order_by="id"), "gap_id") == [0] * 8


def test_no_valid_time(spark):
    df = spark.createDataFrame([(1, "x"), (2, "")], "id int, t string")
    assert column(timebin.bin_relative(df, "t", 60), "bin") == [-1, -1]
    assert column(timebin.bin_gaps(df, "t", 60, order_by="id"), "gap_id") == [-1, -1]
    assert column(timebin.bin_manual(df, "t", ["06:00"]), "bin") == [-1, -1]


def test_negative_epoch(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ'1969-12-31 23:30:00.25' AS t")
    assert column(timebin.bin_manual(df, "t", ["06:00", "23:00"]), "bin") == [2]
    assert column(timebin.bin_absolute(df, "t", 3600), "bin") == [-1]
    assert column(timebin.bin_absolute(df, "t", 0.5), "bin") == [-3600]


def test_time_columns(spark):
    df = spark.createDataFrame([("10:00:00", "x", "12:00", 1), ("", None, "zz", 2)], "good_time string, time_note string, other string, n int")
    df = df.withColumn("at", F.timestamp_seconds(F.lit(5)))
    assert timebin.time_columns(df) == ["good_time", "at"]
    assert tuple(timebin.validate_time_column(df, "good_time").first()) == (1, 1, True)
    assert tuple(timebin.validate_time_column(df, "time_note").first()) == (1, 0, False)
