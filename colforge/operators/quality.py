"""Profiles and data-quality checks. Each check is one aggregate over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.functions.timeparse import DAY_MICROS, micros_of_day
from colforge.operators.groups import empty
from colforge.plans.ordered import OrderedScan, Previous
from colforge.session import materialize

INFO, WARNING, ERROR = "info", "warning", "error"
HALF_DAY = DAY_MICROS // 2


def _per_column(df: DataFrame, columns: Sequence[str], make) -> DataFrame:
    """One wide aggregate, turned into one row per column."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), *make(c)).alias(f"s{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*wide.columns)))


def structure(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row: rows, columns, missing and extra column names."""
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(missing)).alias("missing"),
        F.lit(",".join(extra)).alias("extra"),
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: total, nulls, filled, null_percent."""
    total = F.count(F.lit(1))
    return _per_column(
        df,
        list(columns or df.columns),
        lambda c: [
            total.alias("total"),
            (total - F.count(c)).alias("nulls"),
            F.count(c).alias("filled"),
            F.try_divide((total - F.count(c)) * 100.0, total).alias("null_percent"),
        ],
    )


def token_rates(df: DataFrame, columns: Sequence[str], token: str = "", target: float = 0.1, tolerance: float = 0.02) -> DataFrame:
    """Per text column: the share of blank (`token=""`, NULL counts) or `token` cells, and whether it meets the target."""

    def make(c):
        hit = empty(F.col(c), T.StringType()) if token == "" else F.col(c) == token
        rate = F.try_divide(F.count_if(hit), F.count(F.lit(1)))
        return [F.count_if(hit).alias("hits"), rate.alias("rate"), (F.abs(rate - target) <= tolerance).alias("ok")]

    return _per_column(df, columns, make)


def format_check(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row: values and how many do not match the pattern."""
    bad = F.col(column).isNotNull() & ~F.col(column).rlike(pattern)
    return df.agg(F.count(column).alias("values"), F.count_if(bad).alias("bad"))


def format_examples(df: DataFrame, column: str, pattern: str, n: int = 5, *, order_by) -> DataFrame:
    """The first `n` values that do not match."""
    bad = F.col(column).isNotNull() & ~F.col(column).rlike(pattern)
    return df.filter(bad).orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(n)


def day_micros(df: DataFrame, column: str) -> Column:
    """Time of day of a text, timestamp or long (already microseconds) column."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return micros_of_day(F.col(column))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.pmod(F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", F.col(column)), F.col(column)), F.lit(DAY_MICROS))
    return F.col(column).cast("long")


def after_check(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """One row: pairs compared and pairs where `later` is before `earlier` on the clock.

    Going back by 12 hours or more counts as passing midnight.
    """
    diff = day_micros(df, later) - day_micros(df, earlier)
    return df.agg(F.count(diff).alias("pairs"), F.count_if((diff < 0) & (diff > -HALF_DAY)).alias("violations"))


def order_check(df: DataFrame, column: str, *, order_by, group_by=(), wrap: int | None = None) -> DataFrame:
    """One row: rows and how often the value goes back against the row before (in its group).

    A step back by more than `wrap` is taken as a wrap-around.
    """
    scan = OrderedScan(df, order_by, group_by)
    stepped = scan.add({"__prev": Previous(F.col(column))})
    back = F.col(column) < F.col("__prev")
    if wrap is not None:
        back = back & (F.col("__prev") - F.col(column) <= wrap)
    return stepped.agg(F.count(F.lit(1)).alias("rows"), F.count_if(back).alias("violations"))


def range_check(df: DataFrame, ranges: dict[str, tuple], decimals: dict[str, int] | None = None) -> DataFrame:
    """Per column: values, NULLs, values outside the closed range, values with more decimal places than allowed."""
    decimals = decimals or {}

    def make(c):
        low, high = ranges.get(c, (None, None))
        outside = F.lit(False)
        if low is not None:
            outside = outside | (F.col(c) < low)
        if high is not None:
            outside = outside | (F.col(c) > high)
        places = F.lit(False)
        if c in decimals:
            rounded = F.round(F.col(c), decimals[c])
            places = rounded != F.col(c)
        return [
            F.count(c).alias("values"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count_if(outside).alias("outside"),
            F.count_if(places).alias("bad_decimals"),
        ]

    return _per_column(df, list(dict.fromkeys([*ranges, *decimals])), make)


def text_decimals_check(df: DataFrame, column: str, places: int) -> DataFrame:
    """One row for a number kept as text: values, those that are no number, those without exactly `places` decimals."""
    number = F.col(column).try_cast("double")
    exact = F.col(column).rlike(rf"^[+-]?\d+\.\d{{{places}}}$")
    return df.agg(
        F.count(column).alias("values"),
        F.count_if(F.col(column).isNotNull() & number.isNull()).alias("not_numbers"),
        F.count_if(number.isNotNull() & ~exact).alias("bad_decimals"),
    )


def allowed_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Values outside the allowed set with their row counts."""
    value = F.col(column)
    outside = ~F.coalesce(value.isin(list(allowed)), F.lit(False))
    return df.filter(outside).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values, mean, sample standard deviation, min, max."""
    return _per_column(
        df,
        columns,
        lambda c: [
            F.count(c).alias("values"),
            F.avg(c).cast("double").alias("mean"),
            F.stddev(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        ],
    )


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """One row: groups of equal values, and the smallest, largest and mean group."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("avg_size"))


def size_distribution(df: DataFrame, column: str) -> DataFrame:
    """How many groups have each size: size, groups."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def repeated_in_groups(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Per column: groups of more than one row, and how many of them hold some value twice."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    wide = sizes.filter("n > 1").agg(
        *[
            F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("groups"), F.count_if(F.col(f"d{i}") < F.col("n")).alias("repeated")).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))


def group_gaps(df: DataFrame, group: str, seconds: Column, *, order_by, wrap_day=False) -> DataFrame:
    """Seconds from the last row of each group to the first row of the next one: group, gap.

    Groups stand in the order of their first rows. With `wrap_day` a negative gap gets 24 hours added.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    key = F.struct(*keys)
    narrow = df.select(F.col(group).alias("group"), *keys, seconds.alias("__s"))
    ends = narrow.groupBy("group").agg(
        F.min(key).alias("first"), F.min_by("__s", key).alias("start"), F.max_by("__s", key).alias("end")
    )
    ends = materialize(ends.select("group", "start", "end", *[F.col(f"first.{k}").alias(f"k{i}") for i, k in enumerate(keys)]))
    scan = OrderedScan(ends, [f"k{i}" for i in range(len(keys))])
    stepped = scan.add({"before": Previous(F.struct("end"))}, {"before": lambda r: r["before"]})
    gap = F.col("start") - F.col("before.end")
    if wrap_day:
        gap = F.when(gap < 0, gap + 86_400).otherwise(gap)
    return stepped.filter(F.col("before").isNotNull()).select("group", gap.alias("gap"))


def gap_classes(gaps: DataFrame, medium: int = 60, large: int = 600, hour: int = 3600) -> DataFrame:
    """One row: gaps below `medium`, below `large`, the rest, share of at least an hour in percent, largest gap."""
    return gaps.agg(
        F.count_if(F.col("gap") < medium).alias("small"),
        F.count_if((F.col("gap") >= medium) & (F.col("gap") < large)).alias("medium"),
        F.count_if(F.col("gap") >= large).alias("large"),
        F.try_divide(F.count_if(F.col("gap") >= hour) * 100.0, F.count("gap")).alias("hour_percent"),
        F.max("gap").alias("largest"),
    )


def time_span(df: DataFrame, column: str) -> DataFrame:
    """One row: first and last time, hours between, and whether all of it fits 24 hours."""
    hours = F.timestamp_diff("MICROSECOND", F.min(column), F.max(column)) / 3.6e9
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), hours.alias("hours"), (hours < 24).alias("within_day"))


def constraint_check(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = ()) -> DataFrame:
    """Per declared constraint: column, constraint, violations (a primary key is both)."""
    parts = []
    if not_null:
        nulls = _per_column(df, list(not_null), lambda c: [F.count_if(F.col(c).isNull()).alias("violations")])
        parts.append(nulls.select("column", F.lit("not_null").alias("constraint"), "violations"))
    for c in unique:
        # Two-step count: a hot value is combined before the shuffle.
        extra = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        parts.append(extra.select(F.lit(c).alias("column"), F.lit("unique").alias("constraint"), "violations"))
    if not parts:
        raise ValueError("no constraint given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplication_check(frequency: DataFrame, targets: dict[int, float], tolerance: float = 5.0) -> DataFrame:
    """Per number of copies: percent of patterns against its target."""
    total = frequency.agg(F.sum("patterns")).scalar()
    percent = F.try_divide(F.col("patterns") * 100.0, total)
    target = F.coalesce(*[F.when(F.col("copies") == k, F.lit(float(v))) for k, v in targets.items()])
    return frequency.select("copies", "patterns", percent.alias("percent"), target.alias("target"), (F.abs(percent - target) <= tolerance).alias("ok"))


def report(*checks: tuple[str, DataFrame, str, int, str]) -> DataFrame:
    """Join one-row checks to a report: check, level, value, expected.

    Each check is (name, one-row DataFrame, column to read, largest good value, level when it is above).
    """
    out = None
    for name, df, column, limit, level in checks:
        if level not in (WARNING, ERROR):
            raise ValueError(f"level must be {WARNING} or {ERROR}")
        value = F.col(column).cast("long")
        line = df.select(
            F.lit(name).alias("check"),
            F.when(value > limit, F.lit(level)).otherwise(F.lit(INFO)).alias("level"),
            value.alias("value"),
            F.lit(limit).cast("long").alias("expected"),
        )
        out = line if out is None else out.unionByName(line)
    return out
