import random
import statistics

import pytest
from conftest import column
from pyspark.sql import functions as F

from colforge.functions.rows import row_hash
from colforge.operators import duplicates, quality, stats
from colforge.operators.duplicates import FIRST_ROW, DuplicateBlocks, DuplicateGroups
from colforge.plans.quantile import exact_medians


def table(spark, groups, schema="g int, k int, a string, b string"):
    """Rows of (group, content rows), numbered through."""
    rows, k = [], 0
    for g, content in groups:
        for a, b in content:
            rows.append((g, k, a, b))
            k += 1
    return spark.createDataFrame(rows, schema)


GROUPS = [
    (2, [("x", "1"), ("y", "2")]),
    (10, [("x", "1"), ("y", "2")]),
    (3, [("y", "2"), ("x", "1")]),
    (4, [("x", "1")]),
    (5, [("x", "1"), ("z", "9")]),
    (6, [("x", "1"), ("y", "2")]),
    (None, [("x", "1")]),
]


def test_full_groups(spark):
    dup = DuplicateGroups(table(spark, GROUPS), "g", order_by="k", ignore=["k"])
    row = dup.classes().first()
    assert (row["first_group"], row["groups"], row["rows"], row["group_size"]) == (2, 3, 6, 2)
    assert sorted((r["group"], r["kept"]) for r in dup.members().collect()) == [(2, True), (6, False), (10, False)]
    assert tuple(dup.statistics().first()) == (6, 4, 1, 3, 6, 4)
    assert column(dup.clean(), "k", "k") == [0, 1, 4, 5, 6, 7, 8, 11]
    assert sorted(map(tuple, dup.frequency().select("copies", "patterns", "groups").collect())) == [(1, 3, 3), (3, 1, 3)]


def test_first_row_mode(spark):
    dup = DuplicateGroups(table(spark, GROUPS), "g", order_by="k", ignore=["k"], mode=FIRST_ROW)
    assert sorted(r["group"] for r in dup.members().collect()) == [2, 4, 5, 6, 10]


def test_kept_group(spark):
    """By row order the first group stays; by id text "10" comes before "2"."""
    df = table(spark, GROUPS[:2])
    assert DuplicateGroups(df, "g", order_by="k", ignore=["k"]).classes().first()["first_group"] == 2
    assert DuplicateGroups(df, "g", order_by="k", ignore=["k"], keep="min_id_text").classes().first()["first_group"] == 10
    swapped = table(spark, GROUPS[1::-1])
    assert DuplicateGroups(swapped, "g", order_by="k", ignore=["k"]).classes().first()["first_group"] == 10


def test_nulls_in_content(spark):
    df = table(spark, [(1, [(None, "a")]), (2, [("a", None)]), (3, [("", "a")]), (4, [(None, "a")]), (5, [("a1:", "b")]), (6, [("a", "1:b")])])
    dup = DuplicateGroups(df, "g", order_by="k", ignore=["k"])
    assert sorted(r["group"] for r in dup.members().collect()) == [1, 4]
    strict = DuplicateGroups(df, "g", order_by="k", ignore=["k"], null_equals_null=False)
    assert strict.classes().count() == 0
    hashes = column(df.select("k", row_hash(["a", "b"]).alias("h")), "h", "k")
    assert len(set(hashes)) == 5


def test_hot_group_and_hot_class(spark, monkeypatch):
    """One group with a third of the rows, and a third of the groups alike: the same answer as in plain Python."""
    from colforge.plans import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 40)
    r = random.Random(3)
    groups = [(0, [(r.choice("abc"), "p") for _ in range(300)])]
    groups += [(i, [("same", "q"), ("same", "r")]) for i in range(1, 101)]
    groups += [(i, [(r.choice("abcd"), r.choice("uv")) for _ in range(2)]) for i in range(101, 201)]
    groups.append((999, list(groups[0][1])))
    order = list(range(len(groups)))
    r.shuffle(order)
    groups = [groups[i] for i in order]
    df = table(spark, groups).repartition(6)
    dup = DuplicateGroups(df, "g", order_by="k", ignore=["k"])
    seen, keep = {}, set()
    for g, content in groups:
        if seen.setdefault(tuple(content), g) == g:
            keep.add(g)
    assert {x["g"] for x in dup.clean().select("g").distinct().collect()} == keep
    assert dup.statistics().first()["unique_groups"] == len(keep)


def test_broadcast_is_measured(spark):
    from colforge.session import broadcast_if_small

    big = spark.range(1000)
    side = spark.range(50).withColumn("s", F.repeat(F.lit("x"), 100))
    plan = lambda limit: big.join(broadcast_if_small(side, limit), "id", "left_anti")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(1 << 20) and "broadcast" not in plan(1000)


def test_marker_blocks(spark):
    marks = [None, None, "t", "t", None, "t", "t", None, "t", "", "t", "t"]
    body = "zabcabcaxabc"
    df = spark.createDataFrame([(i, "before" if i == 0 and False else m, c, str(i)) for i, (m, c) in enumerate(zip(["t"] + marks[1:], body))], "k int, dumb_time string, c string, good_time string")
    blocks = DuplicateBlocks(df, "dumb_time", order_by="k", ignore=["*time*", "k"])
    assert column(duplicates.marker_blocks(df, "dumb_time", order_by="k"), "block", "k") == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3, 3]
    assert [(r["first_group"], r["groups"]) for r in blocks.classes().collect()] == [(0, 3)]
    clean = blocks.clean()
    assert clean.columns == df.columns and column(clean, "k", "k") == [1, 2, 3, 7, 8]


def test_identical_runs(spark):
    df = spark.createDataFrame(list(enumerate("aabccca" + "aabb")), "k int, c string")
    runs = duplicates.identical_runs(df, order_by="k", buckets=4)
    assert sorted((r["first_key"]["k"], r["last_key"]["k"], r["rows"]) for r in runs.collect()) == [(0, 1, 2), (3, 5, 3), (6, 8, 3), (9, 10, 2)]
    assert tuple(duplicates.run_statistics(runs).first()) == (4, 2, 3, 2.5, 10, 1)


# --- statistics -----------------------------------------------------------------------------------


@pytest.mark.parametrize("band", [5, 10_000])
def test_exact_medians(spark, band):
    """Narrowing gives the true median: ties, hot values on both sides of the middle, even and odd counts, NULLs."""
    r = random.Random(5)
    n = 3000
    data = {
        "uniform": [r.random() for _ in range(n)],
        "hot": [7.0 if i % 3 else r.uniform(0, 20) for i in range(n)],
        "halves": [1.0] * (n // 2) + [5.0] * (n // 2),
        "skewed": [r.expovariate(1) ** 5 for _ in range(n)],
        "few": [float(r.randint(0, 3)) for _ in range(n)],
        "nulls": [None if i % 2 else float(i) for i in range(n)],
        "none": [None] * n,
        "same": [4.0] * n,
        "negative": [-r.randint(1, 1000) / 10 for _ in range(n)],
    }
    names = list(data)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in names)).cache()
    got = exact_medians(df, names, small=0, band_values=band)
    for c in names:
        present = [v for v in data[c] if v is not None]
        assert got[c] == (statistics.median(present) if present else None), c
    assert exact_medians(df, names) == got


def test_summary_and_selection(spark):
    df = spark.createDataFrame([(1, 10.0, True), (2, 20.0, False), (3, 40.0, True), (4, None, None)], "i int, v double, b boolean")
    rows = {r["column"]: r for r in stats.summary(df, ["i", "v", "b"]).collect()}
    assert (rows["i"]["median"], rows["v"]["median"], rows["b"]["mean"]) == (2.5, 20.0, pytest.approx(2 / 3))
    picked = stats.summary_selected(df, ["i"], {"v": (15, 50)}).first()
    assert (picked["values"], picked["selected_rows"], picked["selected_percent"]) == (2, 2, 50.0)


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 9, 10)], "v double")
    bins = {r["bin"]: (r["rows"], r["selected"]) for r in stats.histogram(df, "v", 5, {"v": (1, 9)}).collect()}
    assert bins == {0: (2, 1), 1: (1, 1), 4: (2, 1)}
    assert [tuple(r)[:1] + (r["rows"],) for r in stats.histogram(df.filter("v = 2"), "v").collect()] == [(0, 1)]


def test_sample_and_codes(spark):
    df = spark.range(103).withColumn("c", F.element_at(F.array(F.lit("b"), F.lit("a"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")))
    assert column(stats.systematic_sample(df, 10, order_by="id"), "id") == list(range(0, 100, 10))
    assert column(stats.systematic_sample(df, 500, order_by="id"), "id") == list(range(103))
    coded = stats.category_codes(df, "c", order_by="id")
    assert column(coded, "c_code") == [i % 3 for i in range(103)]


# --- checks ---------------------------------------------------------------------------------------


def test_checks(spark):
    df = spark.createDataFrame(
        [(1, "10:00:00.000", "10:00:01.000", "1.50", 1.5, "a"), (2, "23:59:59.000", "00:00:01.000", "x", 3.0, "b"), (3, "12:00:00.000", "11:00:00.000", "2.5", None, "zz"), (4, "bad", None, "", 250.0, "a")],
        "id int, good_time string, dumb_time string, width string, w double, tag string",
    ).cache()
    assert tuple(quality.structure(df, ["id", "tag", "gone"]).first()) == (4, 6, "gone", "good_time,dumb_time,width,w")
    nulls = {r["column"]: (r["nulls"], r["null_percent"]) for r in quality.null_profile(df).collect()}
    assert nulls["w"] == (1, 25.0) and nulls["id"] == (0, 0.0)
    assert tuple(quality.token_rates(df, ["width"], "", 0.25, 0.01).first()) == ("width", 1, 0.25, True)
    assert tuple(quality.format_check(df, "good_time", r"^\d\d:\d\d:\d\d\.\d{3}$").first()) == (4, 1)
    assert column(quality.format_examples(df, "good_time", r"^\d\d:", order_by="id"), "good_time") == ["bad"]
    assert tuple(quality.after_check(df, "good_time", "dumb_time").first()) == (3, 1)
    ranges = quality.range_check(df, {"w": (1, 200)}, {"w": 0}).first()
    assert tuple(ranges) == ("w", 3, 1, 1, 1)
    assert tuple(quality.text_decimals_check(df.filter("id < 4"), "width", 2).first()) == (3, 1, 1)
    assert {tuple(r) for r in quality.allowed_values(df, "tag", ["a", "b"]).collect()} == {("zz", 1)}
    assert {tuple(r) for r in quality.constraint_check(df, ["w"], ["tag", "id"]).collect()} == {("w", "not_null", 1), ("tag", "unique", 1), ("id", "unique", 0)}
    lines = quality.report(("w filled", quality.constraint_check(df, ["w"]), "violations", 0, quality.ERROR), ("ids", quality.constraint_check(df, unique=["id"]), "violations", 0, quality.WARNING)).collect()
    assert [tuple(r) for r in lines] == [("w filled", "error", 1, 0), ("ids", "info", 0, 0)]


def test_group_gaps(spark):
    df = spark.createDataFrame([(i, g, s) for i, (g, s) in enumerate([(0, 10), (0, 20), (1, 50), (1, 60), (2, 5000), (3, 100)])], "k int, g int, s int")
    gaps = quality.group_gaps(df, "g", F.col("s"), order_by="k", wrap_day=True)
    assert column(gaps, "gap", "group") == [30, 4940, 81500]
    assert tuple(quality.gap_classes(gaps).first()) == (1, 0, 2, pytest.approx(200 / 3), 81500)
