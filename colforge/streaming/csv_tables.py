"""A stream of CSV files into two tables: typed rows and rejected lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from colforge.functions.infer import ORDERS, SPARK_TYPES, ColumnType, blank_nulls, convert
from colforge.session import materialize
from colforge.sources.csv_ingest import LINE, CsvOptions, split_lines


def csv_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as lines with their file and split."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return reader.format("text").load(folder).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")
    )


def declared(types: dict[str, str | ColumnType]) -> dict[str, ColumnType]:
    """Types with the order of day and month. A stream cannot look at the whole column: dates without an order are read day
    first, all of them; cells that are no date that way are NULL."""
    found = {n: t if isinstance(t, ColumnType) else ColumnType(t) for n, t in types.items()}
    return {n: ColumnType(t.kind, t.digits, ORDERS[0]) if t.kind in ("date", "datetime") and not t.order else t for n, t in found.items()}


def csv_to_tables(
    spark: SparkSession, folder: str, types: dict[str, str | ColumnType], rows: str, rejects: str,
    delimiter: str = ",", options: CsvOptions | None = None, files_per_batch: int | None = None,
) -> DataStreamWriter:
    """A writer that puts every data line of new files into `rows` (typed) or, with the reason, into `rejects`.

    Every line below the header of its file comes out exactly once: as a row, or as blank, comment, wrong field count or
    header (a file with other columns). Both tables are Parquet with a folder per micro-batch; a batch that is done again
    after a failure overwrites its own folder in both, so neither loses nor repeats a line. Columns are found by name in
    every file's header. The types come from an earlier inference (`read_csv(...).types`), with their order of day and month.
    """
    o, kinds = options or CsvOptions(), declared(types)
    names = list(kinds)

    def write(batch: DataFrame, number: int) -> None:
        lines = materialize(batch.withColumn("__line", F.monotonically_increasing_id()))
        fields, left_out = split_lines(lines, folder, names, o, delimiter)
        typed = [
            convert(blank_nulls(F.col(f"c{i}"), o.null_tokens), t.kind, t.order).cast(SPARK_TYPES[t.kind]).alias(n) for i, (n, t) in enumerate(kinds.items())
        ]
        fields.select(*typed).write.mode("overwrite").parquet(f"{rows}/batch={number}")
        left_out.select(*LINE, "reason", "value").write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return csv_lines(spark, folder, files_per_batch).writeStream.foreachBatch(write)
