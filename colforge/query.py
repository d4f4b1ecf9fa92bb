"""SQL over registered tables: results, schemas, pages, table columns, guided filters."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.session import QUOTED_IDENTIFIERS


def run_sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """The result of a statement, all rows, typed. Double quotes name columns, single quotes are text.

    Wrong syntax, tables or columns raise Spark's ParseException / AnalysisException at once.
    """
    before = spark.conf.get(QUOTED_IDENTIFIERS, "false")
    spark.conf.set(QUOTED_IDENTIFIERS, "true")
    try:
        return spark.sql(text, args=args or None)
    finally:
        spark.conf.set(QUOTED_IDENTIFIERS, before)


def schema_of(spark: SparkSession, text: str) -> T.StructType:
    """Names and types of a statement's result without running it."""
    return run_sql(spark, text).schema


@dataclass
class Page:
    rows: DataFrame
    page: int
    page_size: int
    total_rows: int

    @property
    def pages(self) -> int:
        return -(-self.total_rows // self.page_size)


def page_rows(df: DataFrame, page: int, page_size: int, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """Page number `page` (from 0). A limited sort: only the first `(page + 1) * page_size` rows are kept per task."""
    if page < 0 or page_size < 1:
        raise ValueError("page counts from 0 and page_size from 1")
    if order_by:
        df = df.orderBy(*order_by)
    else:
        warnings.warn("pages without order_by may overlap or miss rows", stacklevel=2)
    return df.offset(page * page_size).limit(page_size)


def page_after(df: DataFrame, order_by: Sequence[str], after: Sequence | None, page_size: int) -> DataFrame:
    """The `page_size` rows that follow the row with the key values `after` (None: the first page), NULLs first.

    The comparison reaches the scan and only `page_size` rows per task are kept, so deep pages cost no more than the first.
    `order_by` has to be unique, else rows equal to the last one of a page are passed over.
    """
    if page_size < 1:
        raise ValueError("page_size counts from 1")
    if after is not None:
        if len(after) != len(order_by):
            raise ValueError("one value per key column")
        later, equal = F.lit(False), F.lit(True)
        for name, value in zip(order_by, after):
            c, v = F.col(name), F.lit(value)
            beyond = F.when(v.isNull(), c.isNotNull()).otherwise(F.coalesce(c > v, F.lit(False)))
            later, equal = later | (equal & beyond), equal & c.eqNullSafe(v)
        df = df.filter(later)
    return df.orderBy(*order_by).limit(page_size)


def paginate(df: DataFrame, page: int, page_size: int, order_by: Sequence[str | Column] = ()) -> Page:
    """A page together with the row count of the whole result."""
    return Page(page_rows(df, page, page_size, order_by), page, page_size, df.count())


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """Columns of a table or view: table_name, column_name, position, data_type, is_nullable."""
    schema = spark.table(name).schema
    lines = [(name, f.name, i + 1, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(lines, "table_name string, column_name string, position int, data_type string, is_nullable boolean")


# --- guided tools ---------------------------------------------------------------------------------

_TESTS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "between": lambda c, v: c.between(*v),
    "in": lambda c, v: c.isin(list(v)),
    "like": lambda c, v: c.like(v),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}


def filter_rows(df: DataFrame, conditions: Sequence[tuple], match: str = "all") -> DataFrame:
    """Keep rows that meet all (or any) of the conditions `(column, test, value)`."""
    if match not in ("all", "any"):
        raise ValueError("match is all or any")
    combined = None
    for column, test, *value in conditions:
        if test not in _TESTS:
            raise ValueError(f"unknown test {test!r}; one of {list(_TESTS)}")
        c = _TESTS[test](F.col(column), value[0] if value else None)
        combined = c if combined is None else (combined & c if match == "all" else combined | c)
    return df if combined is None else df.filter(combined)


def sort_rows(df: DataFrame, keys: Sequence[str], nulls: str = "last") -> DataFrame:
    """Sort by columns; a leading `-` means descending. NULLs go `first` or `last` in both directions."""
    order = []
    for k in keys:
        c = F.col(k.lstrip("-"))
        if k.startswith("-"):
            order.append(c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last())
        else:
            order.append(c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last())
    return df.orderBy(*order)


_AGGREGATES = {
    "count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    "stddev": F.stddev, "first": F.first, "last": F.last,
}


def aggregate_groups(df: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Group by `keys`; `aggregates` maps an output name to (function, column), e.g. `("sum", "price")`."""
    columns = []
    for out, (name, column) in aggregates.items():
        if name not in _AGGREGATES:
            raise ValueError(f"unknown aggregate {name!r}; one of {list(_AGGREGATES)}")
        target = F.lit(1) if column == "*" else F.col(column)
        columns.append(_AGGREGATES[name](target).alias(out))
    return df.groupBy(*keys).agg(*columns)
