"""Registry of runnable queries, each with the SQL that must give the same rows (or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    """Money as whole cents, so that sums are exact in every engine."""
    return F.round(F.col(column) * 100).cast("long")


def rounded(column, places: int = 6):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), places)
