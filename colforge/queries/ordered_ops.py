"""Computed columns, time bins and group ids on the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colforge.operators import computed, groups, timebin
from colforge.operators.computed import Request
from colforge.plans.exact import exact_totals
from colforge.queries.base import cents, query, rounded, table

ORDER = ["ts", "event_id"]
W = "(ORDER BY ts, event_id)"
EV = "SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events"
# Some cells emptied by event type, for the rules about NULLs.
EVN = """SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS c,
    CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS t,
    CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN NULL ELSE event_type END AS e FROM events"""
SEC = "CAST(floor(epoch(ts)) AS BIGINT)"


def events(spark, d):
    return table(spark, d, "events").withColumn("c", cents("value"))


def events_null(spark, d):
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").withColumns(
        {
            "c": F.when(~bad, cents("value")),
            "t": F.when(~bad, F.col("ts")),
            "e": F.when(bad, "").when(F.col("event_type") == "view", None).otherwise(F.col("event_type")),
        }
    )


# --- computed columns -----------------------------------------------------------------------------


@query("delta_value", f"SELECT event_id, c - lag(c) OVER {W} AS d FROM ({EV})")
def _(spark, d):
    return computed.delta(events(spark, d), "c", "d", order_by=ORDER).select("event_id", "d")


@query(
    "delta_multi",
    """SELECT o_orderkey, c - lag(c) OVER w AS d_price, o_custkey - lag(o_custkey) OVER w AS d_cust
    FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) WINDOW w AS (ORDER BY o_orderkey)""",
)
def _(spark, d):
    df = table(spark, d, "orders").withColumn("c", cents("o_totalprice"))
    out = computed.delta(df, ["c", "o_custkey"], ["d_price", "d_cust"], order_by="o_orderkey")
    return out.select("o_orderkey", "d_price", "d_cust")


@query("delta_nulls_propagate", f"SELECT event_id, c - lag(c) OVER {W} AS d FROM ({EVN})")
def _(spark, d):
    return computed.delta(events_null(spark, d), "c", "d", order_by=ORDER).select("event_id", "d")


@query("delta_nulls_skip", f"SELECT event_id, c - lag(c IGNORE NULLS) OVER {W} AS d FROM ({EVN})")
def _(spark, d):
    return computed.delta(events_null(spark, d), "c", "d", order_by=ORDER, nulls="skip").select("event_id", "d")


@query("delta_nulls_zero", f"SELECT event_id, coalesce(c, 0) - lag(coalesce(c, 0)) OVER {W} AS d FROM ({EVN})")
def _(spark, d):
    return computed.delta(events_null(spark, d), "c", "d", order_by=ORDER, nulls="zero").select("event_id", "d")


@query("delta_by_user", f"SELECT event_id, c - lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM ({EV})")
def _(spark, d):
    return computed.delta(events(spark, d), "c", "d", order_by=ORDER, partition_by="user_id").select("event_id", "d")


@query("delta_first", f"SELECT event_id, c - first_value(c) OVER {W} AS d FROM ({EV})")
def _(spark, d):
    return computed.delta_from_first(events(spark, d), "c", "d", order_by=ORDER).select("event_id", "d")


@query("delta_offset3", f"SELECT event_id, c - lag(c, 3) OVER {W} AS d FROM ({EV})")
def _(spark, d):
    return computed.delta_offset(events(spark, d), "c", 3, "d", order_by=ORDER).select("event_id", "d")


@query("cumsum_value", f"SELECT event_id, CAST(sum(c) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM ({EV})")
def _(spark, d):
    return computed.cumulative_sum(events(spark, d), "c", "s", order_by=ORDER).select("event_id", "s")


# Doubles times 2^75 are whole numbers here; the text of their sum is read as the nearest double.
EXACT = "CAST(CAST(sum(CAST(value * pow(2::DOUBLE, 75) AS HUGEINT)) {over} AS VARCHAR) AS DOUBLE) / pow(2::DOUBLE, 75)"


@query("cumsum_exact", f"SELECT event_id, {EXACT.format(over='OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS s FROM events")
def _(spark, d):
    """Running total of doubles, each the double nearest to the true total."""
    return computed.cumulative_sum(table(spark, d, "events"), "value", "s", order_by=ORDER, exact=True).select("event_id", "s")


@query("totals_exact", f"SELECT user_id, {EXACT.format(over='')} AS value_total, {EXACT.format(over='')} / count(value) AS value_mean FROM events GROUP BY user_id")
def _(spark, d):
    """Totals and means of doubles per group that do not depend on the order of rows."""
    return exact_totals(table(spark, d, "events"), ["value"], ["user_id"])


@query(
    "cumsum_nulls",
    f"""SELECT event_id, CASE WHEN c IS NOT NULL THEN CAST(sum(c) OVER w AS BIGINT) END AS s,
    CAST(sum(c) OVER w AS BIGINT) AS s_skip, CAST(sum(coalesce(c, 0)) OVER w AS BIGINT) AS s_zero
    FROM ({EVN}) WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    steps = [Request("cumsum", ["c"], "s"), Request("cumsum", ["c"], "s_skip", "skip"), Request("cumsum", ["c"], "s_zero", "zero")]
    return computed.compute(events_null(spark, d), steps, order_by=ORDER).select("event_id", "s", "s_skip", "s_zero")


@query(
    "cumsum_by_user",
    f"""SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s
    FROM ({EV})""",
)
def _(spark, d):
    return computed.cumulative_sum(events(spark, d), "c", "s", order_by=ORDER, partition_by="user_id").select("event_id", "s")


@query("fill_forward", f"SELECT event_id, last_value(c IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM ({EVN})")
def _(spark, d):
    return computed.fill_forward(events_null(spark, d), "c", "f", order_by=ORDER).select("event_id", "f")


@query(
    "pct_of_total",
    "SELECT o_orderkey, round(CAST(c AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE) * 100, 9) AS pct FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)",
)
def _(spark, d):
    df = table(spark, d, "orders").withColumn("c", cents("o_totalprice"))
    return computed.percent_of_total(df, "c", "pct").select("o_orderkey", rounded("pct", 9).alias("pct"))


@query(
    "ratio_cols",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax / nullif(l_discount, 0), 6) AS r FROM lineitem",
)
def _(spark, d):
    out = computed.ratio(table(spark, d, "lineitem"), "l_tax", "l_discount", "r")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", rounded("r").alias("r"))


@query("moving_avg5", f"SELECT event_id, round(avg(c) OVER (ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS m FROM ({EV})")
def _(spark, d):
    return computed.moving_average(events(spark, d), "c", "m", 5, order_by=ORDER).select("event_id", rounded("m").alias("m"))


@query(
    "moving_avg_nulls",
    f"""SELECT event_id, round(CASE WHEN c IS NOT NULL THEN avg(c) OVER w END, 6) AS m FROM ({EVN})
    WINDOW w AS (ORDER BY ts, event_id ROWS 6 PRECEDING)""",
)
def _(spark, d):
    return computed.moving_average(events_null(spark, d), "c", "m", 7, order_by=ORDER).select("event_id", rounded("m").alias("m"))


@query(
    "moving_avg_by_user",
    f"SELECT event_id, round(avg(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS m FROM ({EV})",
)
def _(spark, d):
    out = computed.moving_average(events(spark, d), "c", "m", 5, order_by=ORDER, partition_by="user_id")
    return out.select("event_id", rounded("m").alias("m"))


@query("zscore", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / nullif(stddev_pop(p_size) OVER (), 0), 6) AS z FROM part")
def _(spark, d):
    return computed.z_score(table(spark, d, "part"), "p_size", "z").select("p_partkey", rounded("z").alias("z"))


@query("row_id", f"SELECT event_id, row_number() OVER {W} - 1 AS row_id FROM events")
def _(spark, d):
    return computed.row_id(table(spark, d, "events"), order_by=ORDER).select("event_id", "row_id")


@query(
    "row_id_grouped",
    f"""SELECT event_id, row_number() OVER {W} - 1 AS row_id, CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_id_group
    FROM (SELECT *, CASE WHEN row_number() OVER {W} = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER {W}
      OR user_id IS DISTINCT FROM lag(user_id) OVER {W} THEN 1 ELSE 0 END AS f FROM events)""",
)
def _(spark, d):
    out = computed.row_id(table(spark, d, "events"), order_by=ORDER, group_columns=["event_type", "user_id"])
    return out.select("event_id", "row_id", "row_id_group")


@query(
    "time_components",
    """SELECT event_id, CAST(extract(hour FROM ts) AS BIGINT) AS ts_hour, CAST(extract(minute FROM ts) AS BIGINT) AS ts_minute,
    CAST(floor(extract(second FROM ts)) AS BIGINT) AS ts_second, CAST(floor(epoch(ts) - epoch(date_trunc('day', ts))) AS BIGINT) AS since_midnight FROM events""",
)
def _(spark, d):
    df = computed.time_parts(table(spark, d, "events"), "ts")
    df = computed.time_between(df.withColumn("midnight", F.date_trunc("DAY", "ts").cast("timestamp_ntz")), "midnight", "ts", "since_midnight")
    return df.select("event_id", "ts_hour", "ts_minute", "ts_second", "since_midnight")


@query("custom_expression", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(spark, d):
    out = computed.expression(table(spark, d, "lineitem"), "round(l_extendedprice * (1 - l_discount), 4)", "net")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "net")


@query(
    "compute_chain",
    f"""SELECT event_id, d, CAST(sum(d) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS back,
      round(avg(d) OVER (ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS smooth
    FROM (SELECT *, coalesce(c, 0) - coalesce(lag(c) OVER {W}, 0) AS d FROM ({EV}))""",
)
def _(spark, d):
    """A pipeline whose later steps read earlier outputs."""
    steps = [
        Request("delta", ["c"], "raw"),
        Request("expression", [], "d", options={"text": "coalesce(raw, c)"}),
        Request("cumsum", ["d"], "back"),
        Request("moving_average", ["d"], "smooth", options={"window": 3}),
    ]
    out = computed.compute(events(spark, d), steps, order_by=ORDER)
    return out.select("event_id", "d", "back", rounded("smooth").alias("smooth"))


# --- time bins ------------------------------------------------------------------------------------


@query("bin_fixed_relative", f"SELECT event_id, ({SEC} - min({SEC}) OVER ()) // 3600 AS bin FROM events")
def _(spark, d):
    return timebin.bin_relative(table(spark, d, "events"), "ts", "1h").select("event_id", "bin")


@query("bin_fixed_absolute", f"SELECT event_id, {SEC} // 900 AS bin, CAST(floor(epoch_us(ts) / 500000.0) AS BIGINT) AS half FROM events")
def _(spark, d):
    df = timebin.bin_absolute(table(spark, d, "events"), "ts", 900)
    return timebin.bin_absolute(df, "ts", 0.5, "half").select("event_id", "bin", "half")


@query(
    "bin_manual",
    f"""SELECT event_id, CAST((CASE WHEN s >= 21600 THEN 1 ELSE 0 END) + (CASE WHEN s >= 43200 THEN 1 ELSE 0 END)
      + (CASE WHEN s >= 64800 THEN 1 ELSE 0 END) AS BIGINT) AS bin FROM (SELECT event_id, {SEC} % 86400 AS s FROM events)""",
)
def _(spark, d):
    return timebin.bin_manual(table(spark, d, "events"), "ts", ["18:00", "06:00", "12:00:00"]).select("event_id", "bin")


GAPS = f"""SELECT *, CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gap_id FROM (
    SELECT *, CASE WHEN {SEC} - lag({SEC}) OVER {W} > 600 THEN 1 ELSE 0 END AS f FROM ({EV}))"""


@query(
    "bin_gap",
    f"""SELECT gap_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(c) AS BIGINT) AS total
    FROM ({GAPS}) GROUP BY gap_id""",
)
def bin_gap(spark, d):
    df = timebin.bin_gaps(events(spark, d), "ts", 600, order_by=ORDER)
    return df.groupBy("gap_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("c").alias("total")
    )


@query(
    "bin_gap_nulls",
    f"""SELECT event_id, CASE WHEN t IS NULL THEN -1 ELSE CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS gap_id FROM (
    SELECT *, CASE WHEN t IS NOT NULL AND s - lag(s IGNORE NULLS) OVER {W} > 900 THEN 1 ELSE 0 END AS f
    FROM (SELECT *, CAST(floor(epoch(t)) AS BIGINT) AS s FROM ({EVN})))""",
)
def _(spark, d):
    return timebin.bin_gaps(events_null(spark, d), "t", "15:00", order_by=ORDER).select("event_id", "gap_id")


@query(
    "bin_gap_by_user",
    f"""SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gap_id FROM (
    SELECT *, CASE WHEN {SEC} - lag({SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600 THEN 1 ELSE 0 END AS f FROM events)""",
)
def _(spark, d):
    return timebin.bin_gaps(table(spark, d, "events"), "ts", "1h", order_by=ORDER, partition_by="user_id").select("event_id", "gap_id")


BINNED = f"SELECT ({SEC} - min({SEC}) OVER ()) // 3600 AS bin FROM events"


@query(
    "bin_preview",
    f"""SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(0 AS BIGINT) AS invalid_rows, count(*) AS bins, min(n) AS min_size,
    max(n) AS max_size, round(avg(n), 6) AS avg_size FROM (SELECT bin, count(*) AS n FROM ({BINNED}) GROUP BY bin)""",
)
def _(spark, d):
    out = timebin.bin_preview(timebin.bin_relative(table(spark, d, "events"), "ts", "1h"))
    return out.withColumn("avg_size", rounded("avg_size"))


@query("bin_counts", f"SELECT bin, CAST(bin AS VARCHAR) AS label, count(*) AS rows FROM ({BINNED}) GROUP BY bin")
def _(spark, d):
    return timebin.bin_counts(timebin.bin_relative(table(spark, d, "events"), "ts", "1h"))


@query(
    "bin_bounds",
    f"""SELECT event_id, b AS bin, make_timestamp((lo + b * 3600) * 1000000) AS bin_start, make_timestamp((lo + (b + 1) * 3600) * 1000000) AS bin_end
    FROM (SELECT event_id, min({SEC}) OVER () AS lo, ({SEC} - min({SEC}) OVER ()) // 3600 AS b FROM events)""",
)
def _(spark, d):
    return timebin.bin_bounds(table(spark, d, "events"), "ts", "1h").select("event_id", "bin", "bin_start", "bin_end")


@query(
    "time_parse_text",
    f"SELECT event_id, {SEC} AS from_iso, {SEC} AS from_zoned, {SEC} AS from_epoch, {SEC} % 86400 AS from_clock, {SEC} // 60 * 60 % 86400 AS from_hm FROM events",
)
def _(spark, d):
    """Every accepted spelling of a time, written from the event times and parsed back."""
    from colforge.functions.timeparse import parse_seconds

    def back(text):
        return parse_seconds(text)

    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id",
        back(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("from_iso"),
        back(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("from_zoned"),
        back(timebin._seconds(table(spark, d, "events"), "ts").cast("string")).alias("from_epoch"),
        back(F.date_format(ts, "HH:mm:ss.SSS")).alias("from_clock"),
        back(F.date_format(ts, "HH:mm")).alias("from_hm"),
    )


@query(
    "validate_time_column",
    "SELECT count(*) AS values, count(*) AS parsed, true AS usable FROM events",
)
def _(spark, d):
    df = table(spark, d, "events").select(F.date_format("ts", "HH:mm:ss.SSS").alias("good_time"))
    return timebin.validate_time_column(df, "good_time")


# --- group ids ------------------------------------------------------------------------------------

RUNS = f"""SELECT *, CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM (
    SELECT *, CASE WHEN row_number() OVER {W} > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER {W} THEN 1 ELSE 0 END AS f FROM events)"""


@query("group_value_change", f"SELECT event_id, g AS group_id FROM ({RUNS})")
def _(spark, d):
    rule = groups.value_change("event_type")
    return groups.add_groups(table(spark, d, "events"), rule, order_by=ORDER).select("event_id", "group_id")


@query(
    "group_value_change_reset",
    f"SELECT event_id, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) - 1 AS group_id FROM ({RUNS})",
)
def _(spark, d):
    rule = groups.value_change("event_type", reset=True)
    return groups.add_groups(table(spark, d, "events"), rule, order_by=ORDER).select("event_id", "group_id")


EQ = f"""SELECT *, CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM (
    SELECT *, CASE WHEN event_type = 'error' AND coalesce(lag(event_type) OVER {W}, '') <> 'error' THEN 1 ELSE 0 END AS f FROM events)"""


@query(
    "group_value_equals",
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN g ELSE -1 END AS group_id,
    CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY g, event_type = 'error' ORDER BY ts, event_id) - 1 ELSE -1 END AS place FROM ({EQ})""",
)
def _(spark, d):
    rules = [groups.value_equals("event_type", "error"), groups.value_equals("event_type", "error", "place", reset=True)]
    return groups.add_groups(table(spark, d, "events"), rules, order_by=ORDER).select("event_id", "group_id", "place")


EMPTY = f"""SELECT *, greatest(CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1, 0) AS g FROM (
    SELECT *, CASE WHEN coalesce(e, '') = '' AND NOT (row_number() OVER {W} > 1 AND coalesce(lag(e) OVER {W}, '') = '') THEN 1 ELSE 0 END AS f FROM ({EVN}))"""


@query("group_is_empty", f"SELECT event_id, g AS group_id FROM ({EMPTY})")
def _(spark, d):
    return groups.add_groups(events_null(spark, d), groups.is_empty("e"), order_by=ORDER).select("event_id", "group_id")


@query("group_is_empty_reset", f"SELECT event_id, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) - 1 AS group_id FROM ({EMPTY})")
def _(spark, d):
    rule = groups.is_empty("e", reset=True)
    return groups.add_groups(events_null(spark, d), rule, order_by=ORDER).select("event_id", "group_id")


@query(
    "group_composite",
    f"""SELECT event_id, CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_id FROM (
    SELECT *, CASE WHEN row_number() OVER {W} > 1 AND (event_type IS DISTINCT FROM lag(event_type) OVER {W}
      OR user_id % 2 IS DISTINCT FROM lag(user_id % 2) OVER {W}) THEN 1 ELSE 0 END AS f FROM events)""",
)
def _(spark, d):
    df = table(spark, d, "events").withColumn("side", F.col("user_id") % 2)
    return groups.add_groups(df, groups.composite(["event_type", "side"]), order_by=ORDER).select("event_id", "group_id")


@query("group_time_gap", f"SELECT event_id, gap_id AS group_id FROM ({GAPS})")
def _(spark, d):
    rule = groups.time_gap("ts", "10:00")
    return groups.add_groups(table(spark, d, "events"), rule, order_by=ORDER).select("event_id", "group_id")


@query(
    "group_several_rules",
    f"""SELECT r.event_id, g.gap_id AS gap, r.g AS kind, row_number() OVER (PARTITION BY r.g ORDER BY r.ts, r.event_id) - 1 AS place
    FROM ({RUNS}) r JOIN ({GAPS}) g ON g.event_id = r.event_id""",
)
def _(spark, d):
    rules = [
        groups.time_gap("ts", 600, "gap"),
        groups.value_change("event_type", "kind"),
        groups.value_change("event_type", "place", reset=True),
    ]
    return groups.add_groups(table(spark, d, "events"), rules, order_by=ORDER).select("event_id", "gap", "kind", "place")


BLOCKS = f"""SELECT *, CAST(sum(h) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inner_id FROM (
    SELECT *, CASE WHEN row_number() OVER {W} > 1 AND (g <> lag(g) OVER {W} OR event_type <> lag(event_type) OVER {W}) THEN 1 ELSE 0 END AS h
    FROM (SELECT *, greatest(CAST(sum(f) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1, 0) AS g FROM (
      SELECT *, CASE WHEN coalesce(e, '') = '' AND NOT (row_number() OVER {W} > 1 AND coalesce(lag(e) OVER {W}, '') = '') THEN 1 ELSE 0 END AS f FROM ({EVN}))))"""


@query(
    "group_hierarchy",
    f"""SELECT event_id, g AS block, inner_id - min(inner_id) OVER (PARTITION BY g) AS part,
    row_number() OVER (PARTITION BY inner_id ORDER BY ts, event_id) - 1 AS sequence FROM ({BLOCKS})""",
)
def _(spark, d):
    out = groups.hierarchy(events_null(spark, d), groups.is_empty("e", "block"), groups.value_change("event_type", "part"), order_by=ORDER)
    return out.select("event_id", "block", "part", "sequence")


@query(
    "group_statistics",
    f"""SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size
    FROM (SELECT g, count(*) AS n FROM ({RUNS}) GROUP BY g)""",
)
def _(spark, d):
    df = groups.add_groups(table(spark, d, "events"), groups.value_change("event_type"), order_by=ORDER)
    return groups.group_statistics(df, "group_id").withColumn("avg_size", rounded("avg_size"))


# --- the largest table ----------------------------------------------------------------------------

LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LW = f"(ORDER BY {', '.join(LINES)})"
LQ = f"SELECT {', '.join(LINES)}, CAST(l_quantity AS BIGINT) AS q, l_returnflag FROM lineitem"


def lines(spark, d):
    return table(spark, d, "lineitem").select(*LINES, F.col("l_quantity").cast("long").alias("q"), "l_returnflag")


@query("lines_delta", f"SELECT {', '.join(LINES)}, q - lag(q) OVER {LW} AS d FROM ({LQ})")
def _(spark, d):
    return computed.delta(lines(spark, d), "q", "d", order_by=LINES).select(*LINES, "d")


@query("lines_total", f"SELECT {', '.join(LINES)}, CAST(sum(q) OVER ({LW[1:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ({LQ})")
def _(spark, d):
    return computed.cumulative_sum(lines(spark, d), "q", "total", order_by=LINES).select(*LINES, "total")


@query(
    "lines_flag_runs",
    f"""SELECT {', '.join(LINES)}, CAST(sum(f) OVER ({LW[1:-1]} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM (
      SELECT *, CASE WHEN l_returnflag <> lag(l_returnflag) OVER {LW} THEN 1 ELSE 0 END AS f FROM ({LQ}))""",
)
def _(spark, d):
    return groups.add_groups(lines(spark, d), groups.value_change("l_returnflag", "g"), order_by=LINES).select(*LINES, "g")
