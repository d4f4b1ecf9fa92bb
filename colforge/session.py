"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# `SELECT "a"` names a column, as in standard SQL, instead of being the text a.
QUOTED_IDENTIFIERS = "spark.sql.ansi.doubleQuotedIdentifiers"


def get_session(app: str = "colforge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Recording a Python call site for every column expression costs more than building the plan.
    fast = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
    settings = SETTINGS | fast | {QUOTED_IDENTIFIERS: "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or what `setCheckpointDir` chose.

    Without either, one process (`local[...]`) gets a folder of its own that goes with it; a cluster raises, since a
    folder of the driver's machine would lose the rows that other machines write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_dir()
    return folder.rstrip("/")


@cache
def _own_dir() -> str:
    folder = tempfile.TemporaryDirectory(prefix="colforge-")
    atexit.register(folder.cleanup)
    return folder.name


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, keeps column pruning for the readers, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/colforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a bucket that is worth a task of its own.
BUCKET_ROWS = 200_000


def materialize_buckets(df: DataFrame, columns: list[str]) -> DataFrame:
    """`materialize`, with rows dealt to files by `columns` and sorted by them inside each file.

    Joins on all of `columns` read the files as they are, however often: only the other side is shuffled and sorted. For that,
    the session takes one file's rows in their written order. The name in the catalog, which Spark asks for, goes at once; the files stay.
    """
    spark = df.sparkSession
    name = f"colforge_{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    rows = materialize(df)
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_ROWS + 1)
    path = f"{shared_dir(spark)}/colforge/{uuid.uuid4().hex}"
    rows.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).option("path", path).format("parquet").saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept


BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a narrow side for broadcast after measuring it; a larger one is joined by shuffle, skew left to AQE.

    Without the mark a big table would be shuffled before its join partner turns out to be small.
    """
    cell = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    size = df.agg(F.sum(cell.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
