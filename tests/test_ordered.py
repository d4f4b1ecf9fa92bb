"""The ordered scan gives the same answer for any number of buckets, and keeps big inputs out of one task."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colforge.plans.ordered import FILE_ORDER, OrderedScan, Previous, RowIndex, RunningSum, Runs, with_file_order

BUCKETS = [1, 2, 8, 64]


def make(spark, n=400, seed=1, key=lambda r, i: r.randint(0, 40)):
    r = random.Random(seed)
    rows = [
        (i, key(r, i), r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 5, 9, 700]), r.choice(["x", "y", None]))
        for i in range(n)
    ]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "id int, k int, g string, v int, s string").repartition(5)


def features():
    return {
        "total": RunningSum(F.col("v")),
        "through": RunningSum(F.col("v"), "total"),
        "index": RowIndex(),
        "prev": Previous(F.col("s")),
        "filled": Previous(F.col("v"), F.col("v").isNotNull()),
        "change": Runs(F.struct("s"), lambda p, c: ~p.eqNullSafe(c)),
        "hits": Runs(F.coalesce(F.col("s") == "x", F.lit(False)), lambda p, c: c & ~p, initial=lambda s: s),
        "gap": Runs(F.col("v"), lambda p, c: (c - p) > 3, valid=F.col("v").isNotNull()),
    }


def derive():
    names = [*features(), "change.position", "change.index", "hits.position"]
    return {n.replace(".", "_"): (lambda r, n=n: r[n]) for n in names}


def expected(df, keys):
    w = W.partitionBy(*keys).orderBy("k", "id")
    up, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    n = F.row_number().over(w)
    hit = F.coalesce(F.col("s") == "x", F.lit(False))
    df = df.withColumns(
        {
            "index": (n - 1).cast("long"),
            "through": F.sum("v").over(up),
            "prev": F.lag("s").over(w),
            "filled": F.last("v", ignorenulls=True).over(before),
            "_c": ((n > 1) & ~F.lag("s").over(w).eqNullSafe(F.col("s"))).cast("int"),
            "_h": (hit & ~F.coalesce(F.lag(hit).over(w), F.lit(False))).cast("int"),
            "_g": F.coalesce(F.col("v") - F.last("v", ignorenulls=True).over(before) > 3, F.lit(False)).cast("int"),
        }
    ).withColumn("total", F.when(F.col("v").isNotNull(), F.col("through")))
    df = df.withColumns({"change": F.sum("_c").over(up), "hits": F.sum("_h").over(up), "gap": F.sum("_g").over(up)})
    place = lambda c: (F.row_number().over(W.partitionBy(*keys, c).orderBy("k", "id")) - 1).cast("long")
    return df.withColumns({"change_index": F.col("index"), "change_position": place("change"), "hits_position": place("hits")})


def same(a, b):
    text = lambda df: sorted([str(x) for x in r] for r in df.collect())
    assert a.columns == b.columns
    assert text(a) == text(b)


@pytest.mark.parametrize("buckets", BUCKETS)
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_all_features(spark, buckets, keys):
    df = make(spark).cache()
    got = OrderedScan(df, ["k", "id"], keys, buckets).add(features(), derive())
    same(got, expected(df, keys).select(got.columns))


@pytest.mark.parametrize("key", [lambda r, i: 7, lambda r, i: None, lambda r, i: r.choice([None, 3, 3, 3, 4])])
def test_equal_and_null_keys(spark, key):
    df = make(spark, 200, key=key).cache()
    scan = OrderedScan(df, ["k", "id"], buckets=16)
    assert scan.buckets > 8, "ties in the first key must not end in one bucket"
    got = scan.add(features(), derive())
    same(got, expected(df, []).select(got.columns))


@pytest.mark.parametrize("buckets, size", [(1, 4), (2, 1), (8, 90), (64, 4), (64, 90)])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_sliding(spark, buckets, keys, size):
    """Windows may be longer than a bucket and reach over several."""
    df = make(spark, 150).cache()
    columns = lambda w: {"m": F.sum("v").over(w.rowsBetween(-size, 0)), "l": F.lag("v", size).over(w)}
    got = OrderedScan(df, ["k", "id"], keys, buckets).sliding(size, columns, ["v"])
    same(got, df.withColumns(columns(W.partitionBy(*keys).orderBy("k", "id"))).select(got.columns))


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp", "timestamp_ntz", "decimal(20,3)", "boolean", "binary"])
def test_key_types(spark, kind):
    source = {
        "string": F.concat(F.lit('q"\\'), F.col("id").cast("string")),
        "double": F.when(F.col("id") == 5, F.lit(float("nan"))).otherwise(F.col("id") / 7),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
        "timestamp": F.timestamp_seconds(F.col("id") * 1000 - 50000),
        "timestamp_ntz": F.timestamp_seconds(F.col("id") * 1000 - 50000).cast("timestamp_ntz"),
        "boolean": F.col("id") % 2 == 0,
        "binary": F.encode(F.col("id").cast("string"), "UTF-8"),
    }.get(kind, F.col("id").cast(kind))
    df = spark.range(0, 120, 1, 3).withColumn("k", source.cast(kind)).cache()
    got = OrderedScan(df, ["k", "id"], buckets=8).add({"i": RowIndex()})
    same(got, df.withColumn("i", (F.row_number().over(W.orderBy("k", "id")) - 1).cast("long")))


def test_empty_table(spark):
    df = make(spark, 3).filter("id < 0")
    assert OrderedScan(df, ["k", "id"]).add(features(), derive()).count() == 0
    assert OrderedScan(df, ["k", "id"], "g").add({"i": RowIndex()}).count() == 0


def test_hot_key_is_spread(spark, monkeypatch):
    """A key with more rows than a task should get is worked on by many tasks."""
    from colforge.plans import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 50)
    df = spark.range(600).select(F.col("id").cast("int"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("g"), F.lit(1).alias("v")).cache()
    scan = OrderedScan(df, "id", "g")
    assert not scan.plain and scan.buckets >= 8
    got = scan.add({"total": RunningSum(F.col("v"))})
    same(got, df.withColumn("total", F.sum("v").over(W.partitionBy("g").orderBy("id"))))
    per_task = scan.placed(scan.based()).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 200


def test_small_keys_use_plain_windows(spark):
    df = make(spark).cache()
    scan = OrderedScan(df, ["k", "id"], "g")
    assert scan.plain
    got = scan.add(features(), derive())
    same(got, expected(df, ["g"]).select(got.columns))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_task_over_the_rows(spark):
    """A single-partition exchange may only stand over one row per bucket."""
    df = make(spark).repartition(5)
    for out in (
        OrderedScan(df, ["k", "id"], buckets=8).add(features(), derive()),
        OrderedScan(df, ["k", "id"], buckets=8).sliding(3, lambda w: {"l": F.lag("v", 3).over(w)}, ["v"]),
    ):
        lines = plan_of(out).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "Aggregate" in lines[i + 1] and "__bucket" in lines[i + 1], lines[i + 1]
        wide = [line for line in lines if "Exchange" in line and "shufflepartitionidpassthrough" in line]
        assert wide, "rows go to their bucket in one shuffle"


def test_boundaries_are_a_literal(spark):
    """Thousands of boundaries must not be parsed or rebuilt per row."""
    df = spark.range(0, 5000, 1, 2).withColumn("same", F.lit(1)).cache()
    for order in (["id"], ["same", "id"]):
        scan = OrderedScan(df, order, buckets=1000)
        assert scan.buckets > 900
        plan = plan_of(scan.based())
        assert "from_json" not in plan and "transform(" not in plan
        sizes = scan.based().groupBy("__bucket").count().agg(F.max("count")).first()[0]
        assert sizes < 60


def test_keyed_join_keeps_the_placement(spark):
    """The summary comes to the rows: both sides are placed by bucket, the rows are not shuffled again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make(spark)
        plan = plan_of(OrderedScan(df, ["k", "id"], "g", buckets=8).add({"t": RunningSum(F.col("v"))}))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan
    hashed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("k#" not in line.split("hashpartitioning")[1] for line in hashed)


def test_file_order(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).withColumn("v", F.col("id") * 2)
    df.write.parquet(str(tmp_path / "t"))
    stored = with_file_order(spark.read.parquet(str(tmp_path / "t")))
    got = OrderedScan(stored, FILE_ORDER, buckets=6).add({"i": RowIndex(), "p": Previous(F.col("id"))})
    rows = got.orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(1000))
    assert all(r["p"] == q["id"] for q, r in zip(rows, rows[1:]))


def test_bad_arguments(spark):
    df = make(spark, 5)
    with pytest.raises(ValueError, match="order_by"):
        OrderedScan(df, [])
    with pytest.raises(ValueError, match="no such column"):
        OrderedScan(df, ["nope"])
