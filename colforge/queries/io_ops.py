"""Round trips through files, type inference and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colforge.functions.infer import blank_nulls, convert, infer_types
from colforge.queries.base import cents, query, table
from colforge.session import shared_dir
from colforge.sources import project
from colforge.sources.csv_ingest import LINE, CsvOptions, read_csv
from colforge.streaming import streams


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/colforge/{uuid.uuid4().hex}"


@query("csv_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(spark, d):
    """Export as CSV, read back as lines, infer all types."""
    path = scratch(spark)
    df = table(spark, d, "orders")
    project.export_csv(df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), path)
    return read_csv(spark, path).rows.drop(*LINE)


@query(
    "csv_null_tokens",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_type NOT IN ('view', 'error') THEN event_type END AS kind,
    CASE WHEN event_type <> 'view' THEN ts END AS at, epoch_us(ts) % 86400000000 // 1000 * 1000 AS clock FROM events""",
)
def _(spark, d):
    """Missing cells spelled in four ways, times of day, a chosen delimiter."""
    path = scratch(spark)
    bad, view = F.col("event_type") == "error", F.col("event_type") == "view"
    text = table(spark, d, "events").select(
        "event_id",
        F.when(bad, "N/A").otherwise(F.format_string("%.2f", "value")).alias("value"),
        F.when(bad, "-").when(view, "null").otherwise(F.col("event_type")).alias("kind"),
        F.when(view, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("at"),
        F.date_format("ts", "HH:mm:ss.SSS").alias("clock"),
    )
    project.export_csv(text, path, delimiter=";")
    return read_csv(spark, path, CsvOptions(delimiter=";")).rows.drop(*LINE)


@query(
    "infer_types_text",
    """SELECT 'k' AS "column", CASE WHEN bool_and(TRY_CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) IS NOT NULL) THEN 'integer' ELSE 'text' END AS kind FROM orders
    UNION ALL SELECT 'price', CASE WHEN bool_and(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NOT NULL) THEN 'real' ELSE 'text' END FROM orders
    UNION ALL SELECT 'day', CASE WHEN bool_and(TRY_CAST(strftime(o_orderdate, '%Y/%m/%d') AS DATE) IS NOT NULL) THEN 'date' ELSE 'text' END FROM orders
    UNION ALL SELECT 'at', CASE WHEN bool_and(TRY_CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) IS NOT NULL) THEN 'datetime' ELSE 'text' END FROM orders
    UNION ALL SELECT 'done', CASE WHEN bool_and(TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS BOOLEAN) IS NOT NULL) THEN 'boolean' ELSE 'text' END FROM orders
    UNION ALL SELECT 'prio', CASE WHEN bool_and(TRY_CAST(o_orderpriority AS DOUBLE) IS NOT NULL) THEN 'real' ELSE 'text' END FROM orders""",
)
def _(spark, d):
    text = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("done"),
        F.col("o_orderpriority").alias("prio"),
    )
    found = infer_types(text)
    return spark.createDataFrame([(c, t.kind) for c, t in found.items()], "column string, kind string")


@query(
    "convert_text",
    """SELECT o_orderkey, o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS done, CAST(NULL AS BIGINT) AS bad FROM orders""",
)
def _(spark, d):
    df = table(spark, d, "orders")
    value = lambda c, kind: convert(blank_nulls(c), kind)
    return df.select(
        "o_orderkey",
        value(F.col("o_custkey").cast("string"), "integer").alias("k"),
        value(F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")), "real").alias("price"),
        value(F.date_format("o_orderdate", "dd/MM/yyyy"), "date").alias("day"),
        value(F.when(F.col("o_orderstatus") == "F", "Y").otherwise("0"), "boolean").alias("done"),
        value(F.col("o_orderpriority"), "integer").alias("bad"),
    )


@query("arrow_roundtrip", "SELECT * FROM orders")
def _(spark, d):
    path = scratch(spark)
    project.export_arrow(table(spark, d, "orders").repartition(4), path)
    return spark.read.format("arrow_ipc").load(path)


@query("json_export", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def _(spark, d):
    path = scratch(spark)
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    project.export_json(df, path, stringify=True)
    return spark.read.json(path)


@query(
    "project_append",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
)
def _(spark, d):
    """A stored table built from two appends, opened again from its folder."""
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    store = project.Project(spark, scratch(spark))
    store.save("kept_orders", df.filter("o_orderstatus = 'F'"))
    store.append("kept_orders", df.filter("o_orderstatus <> 'F'"))
    again = project.Project(spark, store.folder)
    again.open()
    return again.load("kept_orders")


# --- streams --------------------------------------------------------------------------------------


def _events_stream(spark, d):
    return streams.parquet_stream(spark, d, "events.parquet")


@query(
    "stream_bin_counts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS rows
    FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL""",
)
def _(spark, d):
    """Windows that are final: the watermark (two hours behind the newest event) has passed them."""
    out = scratch(spark)
    streams.drain(streams.bin_counts(_events_stream(spark, d), "ts", "1 hour", "2 hours", keys=["event_type"]), f"{out}/cp", f"{out}/rows")
    return spark.read.parquet(f"{out}/rows")


@query(
    "stream_gap_sessions",
    """SELECT user_id, min(ts) AS session_start, max(ts) AS last_time, count(*) AS rows FROM (
      SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events))
    GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def _(spark, d):
    out = scratch(spark)
    streams.drain(streams.gap_sessions(_events_stream(spark, d), "ts", "6 hours", "1 hour", ["user_id"]), f"{out}/cp", f"{out}/rows")
    return spark.read.parquet(f"{out}/rows")


@query(
    "stream_drop_duplicates",
    "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events",
)
def _(spark, d):
    """Rows that repeat an earlier one of the same hour."""
    out = scratch(spark)
    rows = _events_stream(spark, d).select("user_id", "event_type", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"))
    streams.drain(streams.drop_duplicate_rows(rows, "hour", "30 days"), f"{out}/cp", f"{out}/rows")
    return spark.read.parquet(f"{out}/rows")


@query(
    "stream_keyed_running",
    """SELECT event_id, c - lag(c) OVER w AS delta, CAST(sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(spark, d):
    out = scratch(spark)
    rows = _events_stream(spark, d).withColumn("c", cents("value")).select("event_id", "ts", "user_id", "c")
    writer = streams.keyed_running(rows, "c", keys=["user_id"], order_by=["ts", "event_id"], output=f"{out}/rows", state=f"{out}/state")
    streams.drain(writer, f"{out}/cp")
    return spark.read.parquet(f"{out}/rows").select("event_id", "delta", "total")
