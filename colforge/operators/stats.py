"""Summary statistics, histograms, samples and category codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.functions.rows import numeric_form
from colforge.plans.ordered import OrderedScan, RowIndex
from colforge.plans.quantile import SMALL_TABLE, exact_integer_medians, exact_medians
from colforge.session import broadcast_if_small, materialize


def numeric_view(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns with a numeric form, as double: booleans 0/1, times in seconds."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))]
    return df.select(*[_figure(df, c).alias(c) for c in columns])


def _figure(df: DataFrame, column: str) -> Column:
    """The numeric form of a column; NaN is no value, so that one rule holds for all figures."""
    return F.nanvl(numeric_form(F.col(column), df.schema[column].dataType).cast("double"), F.lit(None).cast("double"))


def nan_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, nans: how many cells `summary` and `histogram` leave out as NaN."""
    form = lambda c: numeric_form(F.col(c), df.schema[c].dataType).cast("double")
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(F.isnan(form(c))).alias("nans")).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def summary(df: DataFrame, columns: Sequence[str], small: int = SMALL_TABLE) -> DataFrame:
    """One row per column: column, values, min, max, mean, exact median, population standard deviation; all without NaN."""
    view = numeric_view(df, columns)
    medians = exact_medians(view, columns, small)
    wide = view.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("values"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.avg(c).alias("mean"),
                F.lit(medians[c]).cast("double").alias("median"),
                F.stddev_pop(c).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def summary_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per integer column: column, values, min, max (long), median (decimal with one place), mean (the double nearest
    to the exact total over the values). No figure but the mean passes through a double, so 2^53 + 1 stays itself."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.IntegralType):
            raise ValueError(f"not an integer column: {c}")
    medians = exact_integer_medians(df, columns)
    figures = lambda c: F.struct(
        F.lit(c).alias("column"), F.count(c).alias("values"), F.min(c).cast("long").alias("min"), F.max(c).cast("long").alias("max"),
        F.lit(medians[c]).cast("decimal(21,1)").alias("median"), F.try_divide(F.sum(F.col(c).cast("decimal(38,0)")).cast("double"), F.count(c)).alias("mean"),
    )
    wide = df.agg(*[figures(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def in_ranges(df: DataFrame, ranges: dict[str, tuple]) -> Column:
    """True where every named column lies in its closed range; NULL lies in none."""
    test = F.lit(True)
    for c, (low, high) in ranges.items():
        test = test & F.coalesce(F.col(c).between(low, high), F.lit(False))
    return test


def select_ranges(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The rows of a range selection; the comparisons reach the Parquet scan."""
    for c, (low, high) in ranges.items():
        df = df.filter(F.col(c).between(low, high))
    return df


def summary_selected(df: DataFrame, columns: Sequence[str], ranges: dict[str, tuple], small: int = SMALL_TABLE) -> DataFrame:
    """`summary` of a range selection, with the selected rows and their share of all rows in percent."""
    size = df.agg(
        F.struct(F.count_if(in_ranges(df, ranges)).alias("selected"), F.count(F.lit(1)).alias("total")).alias("s")
    ).scalar()
    percent = F.try_divide(size["selected"] * 100.0, size["total"])
    return (
        summary(select_ranges(df, ranges), columns, small)
        .withColumn("selected_rows", size["selected"])
        .withColumn("selected_percent", percent)
    )


def histogram(df: DataFrame, column: str, bins: int = 30, selection: dict[str, tuple] | None = None) -> DataFrame:
    """Equal-width bins from min to max: bin, low, high, rows (and `selected` rows). Empty bins are left out."""
    if bins < 1:
        raise ValueError("at least one bin")
    x = _figure(df, column)
    hit = in_ranges(df, selection) if selection else F.lit(True)
    # One map-side combined aggregate over the rows; the limits are a one-row subquery.
    edge = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    width = (edge["hi"] - edge["lo"]) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((x - edge["lo"]) / width), F.lit(bins - 1)))
    aggregates = [F.count(F.lit(1)).alias("rows")]
    if selection:
        aggregates.append(F.count_if(hit).alias("selected"))
    counted = df.filter(x.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(*aggregates)
    low = edge["lo"] + F.col("bin") * width
    return counted.select("bin", low.alias("low"), (low + width).alias("high"), *counted.columns[1:])


def systematic_sample(df: DataFrame, size: int = 5000, *, order_by) -> DataFrame:
    """Every step-th row in order, `step = max(1, rows // size)`, at most `size` rows."""
    if size < 1:
        raise ValueError("size must be positive")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    narrow = df.select(*dict.fromkeys(keys))
    rows = narrow.count()
    step = max(1, rows // size)
    # Only the keys are put in order; the at most `size` picked ones bring their rows, and equal keys no more than were picked.
    numbered = OrderedScan(narrow, keys, rows=rows).add({"__i": RowIndex()})
    picked = numbered.filter((F.col("__i") % step == 0) & (F.col("__i") < step * size))
    names = {k: f"__k{i}" for i, k in enumerate(narrow.columns)}
    wanted = picked.groupBy(*narrow.columns).agg(F.count("*").alias("__n")).withColumnsRenamed(names)
    same = reduce(and_, (df[k].eqNullSafe(F.col(n)) for k, n in names.items()))
    found = df.join(F.broadcast(wanted), same)
    turn = F.row_number().over(Window.partitionBy(*names.values()).orderBy(*names.values()))
    return found.withColumn("__turn", turn).filter("__turn <= __n").select(*[F.col(f"`{c}`") for c in df.columns])


def category_codes(df: DataFrame, column: str, out: str | None = None, *, order_by) -> DataFrame:
    """Replace text by integers in order of first appearance (NULL is a category of its own)."""
    out = out or f"{column}_code"
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    # One row per category, whatever the size of the table; a hot category is combined map-side.
    first = df.groupBy(F.col(column).alias("__category")).agg(F.min(F.struct(*keys)).alias("__first"))
    first = materialize(first.select("__category", *[F.col(f"__first.{k}").alias(f"__k{i}") for i, k in enumerate(keys)]))
    codes = OrderedScan(first, [f"__k{i}" for i in range(len(keys))]).add({out: RowIndex()}).select("__category", out)
    codes = broadcast_if_small(codes)
    return df.join(codes, df[column].eqNullSafe(codes["__category"]), "left").drop("__category")
