"""What several operators of this package need: bounded batches, folds, hashing, connected components."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from colforge.session import materialize, shared_dir  # noqa: F401

# Rows that Spark hands to Python at once: long texts are among them, and a batch is held in memory.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that a batch of very long texts fits beside the executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, longer where `df` has a column of that name."""
    while name in df.columns:
        name += "_"
    return name


def crc_fold(key: str, folds: int) -> Column:
    """Fold of a row: crc32 of the key's decimal text, modulo `folds`; the crc of '' for a null key."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def by_batch(fn) -> callable:
    """A mapInArrow function that applies `fn` to every batch with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return run


class Fitted:
    """A trained model as bytes: the driver passes it on unopened, each Python worker opens it once."""

    def __init__(self, data: bytes):
        self.data = data

    def __getstate__(self):
        return {"data": self.data}

    @cached_property
    def model(self):
        return pickle.loads(self.data)


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> Fitted:
    """`fit` applied to all `rows` within one executor task; only the model reaches the driver.

    The caller bounds the number of rows. They are written first, so a lost executor costs the fit alone, and sorted by
    all their columns, so that it does not matter which task wrote which of them.
    """
    rows = materialize(rows)
    order = [c for c, kind in rows.dtypes if not kind.startswith("array")]
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], names=["model"])

    fitted = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").first()
    # Adaptive execution drops a task without rows.
    return Fitted(fitted["model"] if fitted else pickle.dumps(fit(schema.empty_table())))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two checks over all of them: equal when nothing has moved."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("pmod(xxhash64(b, a), 1000003)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node that can be reached.

    `edges` has two long columns `a`, `b` without nulls. Alternating star contraction: each node's neighbours
    are hung on the smallest one, first the larger neighbours, then the smaller ones. Every round is a minimum
    per node (partial aggregates, so a node with a third of all edges is no hot task) and joins that adaptive
    execution may split; the number of rounds grows with the logarithm of the longest path. Each round is written
    to the shared folder, so that a lost executor costs its tasks only.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialize(hung.where("a <> b").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
