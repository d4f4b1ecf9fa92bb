"""Duplicate groups of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from colforge.operators import duplicates, quality
from colforge.operators.duplicates import DuplicateBlocks, DuplicateGroups
from colforge.queries.base import query, rounded, table
from colforge.queries.ordered_ops import ORDER, W



def documents(spark, d, **options):
    """Every document is a group; ids and sizes do not count as content."""
    df = table(spark, d, "documents").select("doc_id", "text")
    return DuplicateGroups(df, "doc_id", order_by="doc_id", **options)


COPIES = "SELECT min(doc_id) AS first_group, count(*) AS groups, count(*) AS rows, text FROM documents GROUP BY text HAVING count(*) > 1"


@query("dup_groups_documents", f"SELECT first_group, groups, rows, CAST(1 AS BIGINT) AS group_size FROM ({COPIES})")
def _(spark, d):
    return documents(spark, d).classes().drop("signature")


@query(
    "dup_members_documents",
    f"SELECT c.first_group, d.doc_id AS \"group\", d.doc_id = c.first_group AS kept FROM documents d JOIN ({COPIES}) c ON c.text = d.text",
)
def _(spark, d):
    return documents(spark, d, mode=duplicates.FIRST_ROW).members().select("first_group", "group", "kept")


@query(
    "dup_stats",
    """SELECT CAST(sum(n) AS BIGINT) AS groups, count(*) AS unique_groups, count(*) FILTER (WHERE n > 1) AS classes,
    CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS groups_in_classes, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_classes,
    CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS dropped_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text)""",
)
def _(spark, d):
    return documents(spark, d).statistics()


@query("dup_clean_documents", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _(spark, d):
    return documents(spark, d).clean()


@query("dup_frequency", """SELECT n AS copies, count(*) AS patterns, CAST(n * count(*) AS BIGINT) AS groups,
    round(n * count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM (SELECT count(*) AS n FROM documents GROUP BY text) GROUP BY n""")
def _(spark, d):
    return documents(spark, d).frequency().withColumn("percent", rounded("percent"))


@query(
    "dup_full_conversations",
    """SELECT min(conv_id) AS first_group, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM (
      SELECT conv_id, count(*) AS n, string_agg(role || chr(31) || text, chr(30) ORDER BY turn) AS s FROM conversations GROUP BY conv_id) GROUP BY s HAVING count(*) > 1""",
)
def _(spark, d):
    df = table(spark, d, "conversations")
    return DuplicateGroups(df, "conv_id", order_by="turn", ignore=["turn"]).classes().select("first_group", "groups", "rows")


@query(
    "dup_full_baskets",
    """SELECT min(o_custkey) AS first_group, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM (
      SELECT o_custkey, count(*) AS n, string_agg(o_orderpriority || '/' || o_orderstatus, ',' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey)
    GROUP BY s HAVING count(*) > 1""",
)
def _(spark, d):
    """Customers with the same sequence of order kinds."""
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    found = DuplicateGroups(df, "o_custkey", order_by="o_orderkey", ignore=["o_orderkey"], keep="first")
    # The kept group of a class is its first by row order; the smallest customer is asked for here.
    least = found.members().groupBy("signature").agg(F.min("group").alias("first_group"))
    return found.classes().select("signature", "groups", "rows").join(least, "signature").select("first_group", "groups", "rows")


BLOCKED = f"""SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS block
    FROM events"""
FOLDED = f"""SELECT block, count(*) AS n, min(event_id) AS lo, string_agg(event_type, ',' ORDER BY ts, event_id) AS s FROM ({BLOCKED})
    WHERE block >= 0 GROUP BY block"""


def event_blocks(spark, d):
    """Blocks start at every error event (its mark is empty); content is the sequence of event types."""
    df = table(spark, d, "events").select(
        "ts", "event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("mark_time")
    )
    return DuplicateBlocks(df, "mark_time", order_by=ORDER, ignore=["*time*", "ts", "event_id"])


@query(
    "dup_marker_blocks",
    f"SELECT min(block) AS first_group, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, min(n) AS group_size FROM ({FOLDED}) GROUP BY s HAVING count(*) > 1",
)
def _(spark, d):
    return event_blocks(spark, d).classes().drop("signature")


@query(
    "dup_marker_clean",
    f"""SELECT event_id, event_type FROM ({BLOCKED}) b JOIN (SELECT min(block) AS keep FROM ({FOLDED}) GROUP BY s) k ON k.keep = b.block""",
)
def _(spark, d):
    return event_blocks(spark, d).clean().select("event_id", "event_type")


RUN = f"""SELECT *, CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
    SELECT *, CASE WHEN row_number() OVER {W} > 1 AND event_type <> lag(event_type) OVER {W} THEN 1 ELSE 0 END AS f FROM events)"""
RUN_SIZES = f"SELECT run, event_type, count(*) AS rows, min(event_id) AS first_event, max(event_id) AS last_event FROM ({RUN}) GROUP BY run, event_type HAVING count(*) > 1"


def event_runs(spark, d):
    return duplicates.identical_runs(table(spark, d, "events").select(*ORDER, "event_type"), order_by=ORDER)


@query("identical_runs", f"SELECT run, rows, first_event, last_event FROM ({RUN_SIZES})")
def _(spark, d):
    return event_runs(spark, d).select(
        "run", "rows", F.col("first_key.event_id").alias("first_event"), F.col("last_key.event_id").alias("last_event")
    )


@query(
    "identical_run_stats",
    f"""SELECT CAST(sum(n) AS BIGINT) AS runs, min(lo) AS min_size, max(hi) AS max_size, round(sum(r) / sum(n), 6) AS avg_size, CAST(sum(r) AS BIGINT) AS rows_in_runs,
    count(*) FILTER (WHERE n > 1) AS repeated_contents FROM (SELECT event_type, count(*) AS n, sum(rows) AS r, min(rows) AS lo, max(rows) AS hi FROM ({RUN_SIZES}) GROUP BY event_type)""",
)
def _(spark, d):
    return duplicates.run_statistics(event_runs(spark, d)).withColumn("avg_size", rounded("avg_size"))


@query(
    "duplication_check",
    """SELECT n AS copies, count(*) AS patterns, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent,
    CASE n WHEN 2 THEN CAST(10 AS DOUBLE) WHEN 3 THEN CAST(5 AS DOUBLE) END AS target,
    abs(count(*) * 100.0 / sum(count(*)) OVER () - CASE n WHEN 2 THEN 10 WHEN 3 THEN 5 END) <= 5 AS ok
    FROM (SELECT count(*) AS n FROM documents GROUP BY text) GROUP BY n""",
)
def _(spark, d):
    out = quality.duplication_check(documents(spark, d).frequency(), {2: 10.0, 3: 5.0})
    return out.withColumn("percent", rounded("percent"))
