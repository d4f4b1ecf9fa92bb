"""Time bins: fixed intervals, manual boundaries, gaps."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.functions.timeparse import (
    DAY_SECONDS,
    boundary_seconds,
    duration_seconds,
    micros_of,
    parse_seconds,
    seconds_of,
)
from colforge.plans.ordered import OrderedScan, Runs

# The interval choices offered by name, in seconds.
PRESETS = {"1s": 1, "5s": 5, "10s": 10, "30s": 30, "1min": 60, "5min": 300, "10min": 600, "15min": 900, "30min": 1800, "1h": 3600}

NO_TIME = -1


def _interval(value) -> int:
    seconds = PRESETS.get(value) if isinstance(value, str) and value in PRESETS else duration_seconds(value)
    if seconds <= 0:
        raise ValueError("the interval must be positive")
    return seconds


def _seconds(df: DataFrame, column: str) -> Column:
    return seconds_of(F.col(column), df.schema[column].dataType)


def bin_relative(df, column, interval, out="bin") -> DataFrame:
    """Bin number counted from the earliest time in whole seconds; -1 where there is no time."""
    size, seconds = _interval(interval), _seconds(df, column)
    start = df.agg(F.min(seconds).alias("start")).scalar()
    return df.withColumn(out, F.coalesce(F.floor((seconds - start) / size).cast("long"), F.lit(NO_TIME)))


def exact_size(seconds: float | str | Fraction) -> Fraction:
    """The size as an exact fraction; a float counts as the simple fraction it was written for (0.1, 1/3)."""
    if not isinstance(seconds, float):
        return Fraction(seconds)
    simple = Fraction(seconds).limit_denominator(1_000_000)
    return simple if float(simple) == seconds else Fraction(seconds).limit_denominator(10**15)


def bin_absolute(df, column, size_seconds: float | str | Fraction, out="bin") -> DataFrame:
    """`floor(epoch seconds / size)`, exact for any fraction of a second. NULL stays NULL. Also works on a stream."""
    size = exact_size(size_seconds)
    if size <= 0:
        raise ValueError("the size must be positive")
    micros = micros_of(F.col(column), df.schema[column].dataType)
    size_micros = size * 1_000_000
    if size_micros.denominator > 1:  # whole units of 1/denominator microseconds, beyond 64 bits
        unit = size_micros.denominator
        if unit >= 10**18:
            raise ValueError(f"the size {size_seconds!r} needs too many digits")
        micros = micros.cast("decimal(19,0)") * F.lit(unit).cast("decimal(18,0)")
    whole = F.lit(size_micros.numerator).cast("decimal(38,0)" if size_micros.denominator > 1 or size_micros.numerator >> 63 else "long")
    return df.withColumn(out, _floor_div(micros, whole))


def _floor_div(a: Column, b: Column) -> Column:
    """Integer quotient rounded down; `div` rounds towards zero."""
    return F.call_function("div", a - F.pmod(a, b), b).cast("long")


def bin_manual(df, column, boundaries: Sequence[str | int], out="bin") -> DataFrame:
    """Index of the first time-of-day boundary after the row's time, or the number of boundaries; -1 without time."""
    bounds = sorted(boundary_seconds(b) for b in boundaries)
    if not bounds:
        raise ValueError("at least one boundary")
    day = F.pmod(_seconds(df, column), F.lit(DAY_SECONDS))
    passed = sum((F.when(day >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return df.withColumn(out, F.when(day.isNull(), F.lit(NO_TIME)).otherwise(passed).cast("long"))


def bin_gaps(df, column, threshold, out="gap_id", *, order_by, partition_by=(), buckets=None) -> DataFrame:
    """Id from 0 that rises when the time is more than `threshold` after the last time before it.

    Rows without a time get -1 and are passed over.
    """
    limit, seconds = _interval(threshold), _seconds(df, column)
    gap = Runs(seconds, lambda p, c: (c - p) > limit, valid=seconds.isNotNull())
    scan = OrderedScan(df, order_by, partition_by, buckets)
    return scan.add({out: gap}, {out: lambda r: F.when(seconds.isNotNull(), r[out]).otherwise(F.lit(NO_TIME))})


def bin_bounds(df, column, interval, out="bin") -> DataFrame:
    """`bin_relative` plus the first and last instant of each bin as `<out>_start`, `<out>_end`."""
    size, seconds = _interval(interval), _seconds(df, column)
    start = df.agg(F.min(seconds).alias("start")).scalar()
    begin = start + F.floor((seconds - start) / size).cast("long") * size
    instant = lambda s: F.timestamp_seconds(s).cast("timestamp_ntz")
    return bin_relative(df, column, interval, out).withColumns(
        {f"{out}_start": instant(begin), f"{out}_end": instant(begin + size)}
    )


def bin_counts(df, bin_column="bin") -> DataFrame:
    """Rows per bin, with the label "Invalid" for rows without a time."""
    label = F.when(F.col(bin_column) == NO_TIME, F.lit("Invalid")).otherwise(F.col(bin_column).cast("string"))
    return df.groupBy(bin_column).agg(F.count(F.lit(1)).alias("rows")).select(bin_column, label.alias("label"), "rows")


def bin_preview(df, bin_column="bin") -> DataFrame:
    """One row: total rows, rows without a time, bins, and the smallest, largest and mean bin."""
    counts = df.groupBy(bin_column).agg(F.count(F.lit(1)).alias("rows"))
    valid = F.when(F.col(bin_column) != NO_TIME, F.col("rows"))
    return counts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col(bin_column) == NO_TIME, F.col("rows"))), F.lit(0)).alias("invalid_rows"),
        F.count(valid).alias("bins"),
        F.min(valid).alias("min_size"),
        F.max(valid).alias("max_size"),
        F.avg(valid).alias("avg_size"),
    )


def time_columns(df) -> list[str]:
    """Timestamp columns, and text columns named like a time whose largest non-empty value parses. One job."""
    typed = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and "time" in f.name.lower()]
    if not texts:
        return typed
    largest = df.agg(*[F.max(F.nullif(F.trim(c), F.lit(""))).alias(c) for c in texts])
    parsed = largest.select(*[parse_seconds(F.col(c)).isNotNull().alias(c) for c in texts]).first()
    found = {*typed, *(c for c in texts if parsed[c])}
    return [c for c in df.columns if c in found]


def validate_time_column(df, column) -> DataFrame:
    """One row: how many values there are, how many parse as a time, and whether the column is usable."""
    seconds = _seconds(df, column)
    filled = F.col(column).isNotNull()
    if isinstance(df.schema[column].dataType, T.StringType):
        filled = filled & (F.trim(column) != "")
    return df.agg(
        F.count_if(filled).alias("values"),
        F.count(seconds).alias("parsed"),
        (F.count(seconds) > 0).alias("usable"),
    )
