"""Row fingerprints and typed numeric views of columns."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.functions.timeparse import micros_of_day, ntz_micros


def cell(column: Column) -> Column:
    """Text form of one cell; the length in front keeps neighbouring cells apart, and NULL differs from ''."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text))


def row_hash(columns: Sequence[str]) -> Column:
    """md5 over typed cells. Equal rows, NULLs included, get equal hashes."""
    return F.md5(F.concat(*[cell(F.col(c)) for c in columns])) if columns else F.md5(F.lit(""))


def without(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    """Column names that match none of the names or `*` patterns (case is ignored)."""
    return [c for c in df.columns if not any(fnmatch(c.lower(), p.lower()) for p in patterns)]


def numeric_form(column: Column, data_type: T.DataType) -> Column:
    """Booleans as 0/1, times as seconds, numbers as they are; text only if it is a time of day."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column) / 1e6
    if isinstance(data_type, T.TimestampNTZType):
        return ntz_micros(column) / 1e6
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double") * 86_400
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    if isinstance(data_type, T.StringType):
        return micros_of_day(column) / 1e6
    raise ValueError(f"no numeric form for {data_type.simpleString()}")
