"""A project: a folder of Parquet tables, each also a temporary view."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colforge.functions.infer import SPARK_TYPES, SQL_NAMES
from colforge.sources import arrow_ipc
from colforge.sources.csv_ingest import list_files, table_name

log = logging.getLogger(__name__)


class Project:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _stored(self) -> list[str]:
        """Names of the folders one level down, partitioned tables or not; part files are not listed."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        if not system.exists(path):  # a new project has no folder yet
            return []
        names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def open(self) -> list[str]:
        """Register every stored table. A table that cannot be read is logged and left out."""
        self.names = []
        for name in self._stored():
            try:
                self.register(name, self.spark.read.parquet(self.path(name)))
            except Exception as e:
                log.warning("table %s left out: %s", name, e)
        return self.tables()

    refresh = open

    def open_arrow(self, folder: str) -> list[str]:
        """Register the Arrow IPC files of a folder, one table per file; bad files are logged and left out."""
        arrow_ipc.register(self.spark)
        for path in list_files(self.spark, folder, "*.arrow"):
            try:
                df = self.spark.read.format("arrow_ipc").load(path)
                self.register(table_name(path), df)
            except Exception as e:
                log.warning("file %s left out: %s", path, e)
        return self.tables()

    def register(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        if name not in self.names:
            self.names.append(name)
        return df

    def tables(self) -> list[str]:
        return sorted(self.names)

    def exists(self, name: str) -> bool:
        return name in self.names

    def load(self, name: str, limit: int | None = None, cached: bool = False) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"no table {name!r}; there are {', '.join(self.tables()) or 'none'}")
        if cached:
            self.spark.catalog.cacheTable(name)
        df = self.spark.table(name)
        return df if limit is None else df.limit(limit)

    def info(self, name: str) -> dict:
        df = self.load(name)
        columns = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields]
        return {"name": name, "rows": df.count(), "columns": columns}

    def declare(self, name: str, columns: dict[str, str]) -> DataFrame:
        """A new empty table; types by SQL name, unknown names are text."""
        kinds = {c: SPARK_TYPES[SQL_NAMES.get(t.upper().split("(")[0].strip(), "text")] for c, t in columns.items()}
        schema = T.StructType([T.StructField(c, T.DataType.fromDDL(k)) for c, k in kinds.items()])
        return self.save(name, self.spark.createDataFrame([], schema), mode="errorifexists")

    def save(self, name: str, df: DataFrame, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> DataFrame:
        writer = df.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        self.spark.catalog.refreshByPath(self.path(name))
        return self.register(name, self.spark.read.parquet(self.path(name)))

    def save_all(self, tables: dict[str, DataFrame], mode: str = "errorifexists") -> None:
        for name, df in tables.items():
            self.save(name, df, mode)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows; columns are matched by name, missing ones become NULL, extra ones are an error."""
        current = self.load(name)
        extra = [c for c in rows.columns if c not in current.columns]
        if extra:
            raise ValueError(f"table {name} has no column {', '.join(extra)}")
        aligned = current.limit(0).unionByName(rows, allowMissingColumns=True).select(*current.columns)
        return self.save(name, aligned, mode="append")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Swap the whole content. `rows` may not read from the same table."""
        return self.save(name, rows, mode="overwrite")

    def save_derived(self, name: str, df: DataFrame, source: str, config: dict | None = None) -> DataFrame:
        """Store a derived table next to its source, with a one-row JSON that says where it came from."""
        if name == source:
            raise ValueError("a derived table needs a name of its own")
        before = self.load(source).columns if self.exists(source) else []
        stored = self.save(name, df)
        note = {
            "table": name,
            "source": source,
            "config": json.dumps(config or {}, sort_keys=True, default=str),
            "columns_added": [c for c in stored.columns if c not in before],
            "rows": stored.count(),
        }
        line = self.spark.createDataFrame([note], "table string, source string, config string, columns_added array<string>, rows bigint")
        line.coalesce(1).write.mode("overwrite").json(f"{self.folder}/_derived/{name}")
        return stored

    def derived_note(self, name: str) -> DataFrame:
        return self.spark.read.json(f"{self.folder}/_derived/{name}")

    def save_clean(self, table: str, found, run_id: str | None = None) -> DataFrame:
        """Store a table without its duplicate groups as `<table>_clean_<run id>`."""
        name = f"{table}_clean_{run_id or time.strftime('%Y%m%d_%H%M%S')}"
        return self.save_derived(name, found.clean(), table, {"kept": found.keep, "mode": found.mode})


# --- exports --------------------------------------------------------------------------------------


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists", delimiter: str = ",") -> None:
    """CSV with a header in every part file. NULL is an empty cell, an empty text is quoted."""
    df.write.mode(mode).option("header", True).option("sep", delimiter).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, stringify: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines; with `stringify` every value is a text. NULL stays as null."""
    if stringify:
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def export_arrow(df: DataFrame, path: str, mode: str = "append") -> None:
    """One Arrow IPC file per task."""
    arrow_ipc.register(df.sparkSession)
    df.write.format("arrow_ipc").mode(mode).save(path)
