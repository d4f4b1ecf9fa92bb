"""The operators whose meaning survives on a stream. Extensions: the batch forms are the main ones.

Relative bins, shares, z-scores, dense global ids and group signatures need the whole table and stay batch only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.functions.infer import NULL_TOKENS, SPARK_TYPES, ColumnType, blank_nulls, convert
from colforge.functions.rows import row_hash, without
from colforge.operators.timebin import bin_absolute
from colforge.plans.ordered import OrderedScan, Previous, RunningSum
from colforge.streaming.csv_tables import declared


def csv_stream(spark: SparkSession, folder: str, types: dict[str, str | ColumnType], delimiter: str = ",", null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """New CSV files of a folder as typed rows; the types come from an earlier inference, with their order of day and month.

    Lines with another number of fields are left out here; `csv_tables.csv_to_tables` keeps them beside the rows.
    """
    types = declared(types)
    text = T.StructType([T.StructField(c, T.StringType()) for c in types])
    lines = (
        spark.readStream.schema(text).option("sep", delimiter).option("header", True).option("comment", "#")
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "DROPMALFORMED").csv(folder)
    )
    return lines.select(*[convert(blank_nulls(F.col(f"`{c}`"), null_tokens), t.kind, t.order).cast(SPARK_TYPES[t.kind]).alias(c) for c, t in types.items()])


def parquet_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema=None) -> DataFrame:
    """New Parquet files of a folder."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def absolute_bins(stream: DataFrame, column: str, size_seconds: float, out: str = "bin") -> DataFrame:
    """The row-wise absolute bin; needs no state."""
    return bin_absolute(stream, column, size_seconds, out)


def _timed(stream: DataFrame, column: str, lateness: str) -> DataFrame:
    """Set the watermark. Event time has to be a TIMESTAMP; one without zone is read in the session zone (UTC)."""
    if isinstance(stream.schema[column].dataType, T.TimestampNTZType):
        stream = stream.withColumn(column, F.col(column).cast("timestamp"))
    return stream.withWatermark(column, lateness)


def _back(frame: DataFrame, stream: DataFrame, column: str, outputs: Sequence[str]) -> DataFrame:
    """Give the time outputs the type the event time came in."""
    kind = stream.schema[column].dataType
    return frame.withColumns({c: F.col(c).cast(kind) for c in outputs})


def bin_counts(stream: DataFrame, column: str, size: str, lateness: str, slide: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per time window (tumbling, or sliding with `slide`); a window is final once the watermark passes it."""
    timed = _timed(stream, column, lateness)
    window = F.window(column, size, slide) if slide else F.window(column, size)
    counted = timed.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    flat = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rows")
    return _back(flat, stream, column, ["window_start", "window_end"])


def gap_sessions(stream: DataFrame, column: str, gap: str, lateness: str, keys: Sequence[str]) -> DataFrame:
    """Sessions per key that end when nothing came for longer than `gap`; the id of a session is its start."""
    timed = _timed(stream, column, lateness)
    session = F.session_window(column, gap)
    found = timed.groupBy(session.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"), F.max(column).alias("last_time"))
    flat = found.select(*keys, F.col("w.start").alias("session_start"), "last_time", "rows")
    return _back(flat, stream, column, ["session_start", "last_time"])


def drop_duplicate_rows(stream: DataFrame, column: str, lateness: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Drop rows equal to one that arrived within the lateness (columns in `ignore` do not count)."""
    content = without(stream, ignore)
    hashed = _timed(stream, column, lateness).withColumn("__hash", row_hash(content))
    return _back(hashed.dropDuplicatesWithinWatermark(["__hash"]).drop("__hash"), stream, column, [column])


def keyed_running(stream: DataFrame, value: str, *, keys: Sequence[str], order_by: Sequence[str], output: str, state: str):
    """A writer that adds, per key, the delta to the row before and the running total, across micro-batches.

    Every batch goes through the batch ordered scan, so a hot key is spread over tasks; what a key needs to go
    on (last value, total) is one row in a state table per batch. Results and state are written under the
    batch id, so a repeated batch overwrites its own output. Rows are expected in order from batch to batch.
    """
    keys, order_by = list(keys), list(order_by)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = _state_before(spark, state, batch_id)
        scan = OrderedScan(batch, order_by, keys)
        rows = scan.add({"__prev": Previous(F.struct(value)), "__sum": RunningSum(F.col(value), "total")})
        if previous is not None:
            # A NULL key is a key like any other, so that its delta and total go on too.
            named = previous.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
            same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)))
            rows = rows.join(named, same, "left").drop(*(f"__key{i}" for i in range(len(keys))))
            last, before = F.col("__last"), F.coalesce(F.col("__total"), F.lit(0))
        else:
            last, before = F.lit(None).cast(batch.schema[value].dataType), F.lit(0)
        prior = F.when(F.col("__prev").isNotNull(), F.col(f"__prev.{value}")).otherwise(last)
        done = rows.withColumns(
            {"delta": F.try_subtract(F.col(value), prior), "total": F.when(F.col(value).isNotNull(), before + F.col("__sum"))}
        ).select(*batch.columns, "delta", "total")
        done.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

        key = F.struct(*order_by)
        now = batch.groupBy(*keys).agg(F.max_by(F.struct(value), key).alias("__now"), F.sum(value).alias("__add"))
        now = now.select(*keys, F.col(f"__now.{value}").alias("__last"), F.coalesce("__add", F.lit(0)).alias("__total"))
        if previous is not None:
            # Partial sums of old and new per key in one aggregate; the newer last value wins.
            both = previous.withColumn("__age", F.lit(0)).unionByName(now.withColumn("__age", F.lit(1)))
            now = both.groupBy(*keys).agg(F.max_by(F.struct("__last"), "__age").alias("__s"), F.sum("__total").alias("__total"))
            now = now.select(*keys, F.col("__s.__last").alias("__last"), "__total")
        now.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return stream.writeStream.foreachBatch(process).outputMode("append")


def _state_before(spark, state, batch_id):
    return spark.read.parquet(f"{state}/batch={batch_id - 1}") if batch_id > 0 else None


def drain(frame_or_writer, checkpoint: str, output: str | None = None) -> None:
    """Work through everything available now and stop."""
    writer = frame_or_writer
    if isinstance(frame_or_writer, DataFrame):
        writer = frame_or_writer.writeStream.format("parquet").option("path", output).outputMode("append")
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
