"""Sums without rounding, integers with all digits, epoch text."""

import math
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from colforge.functions.timeparse import parse_micros, parse_seconds
from colforge.operators import computed, stats
from colforge.plans.exact import Grid, exact_totals, grids


def doubles(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice([rng.uniform(-1e6, 1e6), rng.gauss(0, 1e-3), 0.1, -0.0, 0.0, None, float(rng.randint(-9, 9))]) for _ in range(n)]


def test_running_totals_do_not_depend_on_buckets(spark):
    cells = doubles(3000)
    df = spark.createDataFrame([(k, k % 3, v) for k, v in enumerate(cells)], "id long, g int, v double").repartition(6)
    want, total = [], Fraction(0)
    for v in cells:
        total += Fraction(v or 0)
        want.append(None if v is None else float(total))  # a fraction is rounded once
    for buckets in (1, 7, 50):
        got = [r[0] for r in computed.cumulative_sum(df, "v", "s", order_by="id", buckets=buckets, exact=True).orderBy("id").select("s").collect()]
        assert got == want
    keyed = computed.cumulative_sum(df, "v", "s", order_by="id", partition_by="g", nulls="skip", exact=True)
    sums = {}
    for r in keyed.orderBy("id").collect():
        sums[r.g] = sums.get(r.g, Fraction(0)) + Fraction(r.v or 0)
        assert r.s is None and not sums[r.g] or r.s == float(sums[r.g])


def test_totals_equal_fsum(spark):
    cells = doubles(4000, 2)
    df = spark.createDataFrame([(k % 5, v) for k, v in enumerate(cells)] + [(9, None)], "g int, v double")
    by = {k: [v for j, v in enumerate(cells) if j % 5 == k and v is not None] for k in range(5)}
    for parts in (1, 13):
        got = {r.g: (r.v_total, r.v_mean) for r in exact_totals(df.repartition(parts), ["v"], ["g"]).collect()}
        assert got == {k: (math.fsum(v), math.fsum(v) / len(v)) for k, v in by.items()} | {9: (None, None)}
    assert exact_totals(df.limit(0), ["v"]).collect()[0] == (None, None)


@pytest.mark.parametrize("odd", [[float("nan")], [float("inf")], [1e-300, 1e300]])
def test_cells_without_an_exact_sum_are_refused(spark, odd):
    df = spark.createDataFrame([(v,) for v in odd], "v double")
    with pytest.raises(ValueError, match="no exact sum"):
        grids(df, ["v"])


def test_grid_steps_are_exact(spark):
    cells = [0.1, -0.1, 123456.789, -5e-4, 2.0**40, -(2.0**40) - 0.5, 3.0, 0.0]
    df = spark.createDataFrame([(v,) for v in cells], "v double")
    grid = grids(df, ["v"])["v"]
    for v, steps, back in df.select("v", grid.whole(F.col("v")).alias("s"), grid.double(grid.whole(F.col("v")))).collect():
        assert Fraction(int(steps), 2**grid.bits) == Fraction(v) and back == v
    assert Grid(0) == grids(df.where("v = 0"), ["v"])["v"]


def test_integers_keep_all_digits(spark):
    rows = [9007199254740993, 9007199254740992, 9007199254740995, None, 9007199254740993, -(2**63), 2**63 - 1, 9007199254740994]
    df = spark.createDataFrame([(v, None if v is None else v % 7) for v in rows], "big long, small long").repartition(3)
    got = {r.column: r for r in stats.summary_integers(df, ["big", "small"]).collect()}
    have = sorted(v for v in rows if v is not None)
    assert (got["big"]["values"], got["big"].min, got["big"].max) == (7, -(2**63), 2**63 - 1)
    assert got["big"].median == have[3] and got["big"].mean == float(Fraction(sum(have))) / 7
    even = stats.summary_integers(df.where("big <> 9007199254740995"), ["big"]).first()
    assert even.median == Decimal(9007199254740993 + 9007199254740993) / 2
    none = stats.summary_integers(df.limit(0), ["big"]).first()
    assert (none["values"], none.min, none.median, none.mean) == (0, None, None, None)
    with pytest.raises(ValueError):
        stats.summary_integers(spark.createDataFrame([(1.5,)], "v double"), ["v"])


def test_epoch_text_has_one_rule(spark):
    texts = ["1700000000123", "1700000000", "-5", "9223372036854775807", "12345678901234567890", "2024-01-01 00:00:01", "x", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").select("id", parse_seconds(F.col("t")).alias("s"), parse_micros(F.col("t")).alias("u")).orderBy("id").collect()
    assert [(r.s, r.u) for r in got[:3]] == [(s, s * 10**6) for s in (1700000000123, 1700000000, -5)]
    assert (got[3].s, got[3].u) == (2**63 - 1, None) and got[4].s is None
    assert got[5].u == got[5].s * 10**6 and got[6].s is got[7].u is None
