"""Profiles, quality checks and summary statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colforge.operators import quality, stats, timebin
from colforge.queries.base import query, rounded, table
from colforge.queries.ordered_ops import EVN, GAPS, ORDER, SEC, W, events, events_null

PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({c}) AS nulls, count({c}) AS filled, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percent FROM ({EVN})"
    for c in ("event_id", "c", "t", "e")
)


@query("structure", "SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns, 'device' AS missing, 'props' AS extra FROM events")
def _(spark, d):
    return quality.structure(table(spark, d, "events"), ["event_id", "ts", "user_id", "event_type", "value", "device"])


@query("null_profile", PROFILE)
def _(spark, d):
    return quality.null_profile(events_null(spark, d), ["event_id", "c", "t", "e"]).withColumn("null_percent", rounded("null_percent"))


@query(
    "token_rates",
    f"""SELECT 'e' AS "column", count(*) FILTER (WHERE coalesce(e, '') = '') AS hits, round(count(*) FILTER (WHERE coalesce(e, '') = '') / count(*), 6) AS rate,
    abs(count(*) FILTER (WHERE coalesce(e, '') = '') / count(*) - 0.4) <= 0.02 AS ok FROM ({EVN})""",
)
def _(spark, d):
    return quality.token_rates(events_null(spark, d), ["e"], "", 0.4, 0.02).withColumn("rate", rounded("rate"))


@query(
    "format_check",
    "SELECT count(*) AS values, count(*) FILTER (WHERE NOT regexp_full_match(url, 'https://[a-z.]+/[a-z]{2}/[0-9]+')) AS bad FROM pages",
)
def _(spark, d):
    return quality.format_check(table(spark, d, "pages"), "url", r"^https://[a-z.]+/[a-z]{2}/[0-9]+$")


@query(
    "format_examples",
    """SELECT page_id, url FROM pages WHERE NOT regexp_full_match(url, 'https://[a-z.]+/[a-z]{2}/[0-9]+') ORDER BY page_id LIMIT 5""",
)
def _(spark, d):
    return quality.format_examples(table(spark, d, "pages").select("page_id", "url"), "url", r"^https://[a-z.]+/[a-z]{2}/[0-9]+$", order_by="page_id")


@query(
    "after_check",
    f"""SELECT count(*) AS pairs, count(*) FILTER (WHERE dd < 0 AND dd > -43200000000) AS violations FROM (
    SELECT epoch_us(ts + INTERVAL 30 MINUTE) % 86400000000 - epoch_us(ts) % 86400000000 AS dd FROM events)""",
)
def _(spark, d):
    df = table(spark, d, "events").withColumn("later", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    return quality.after_check(df, "ts", "later")


@query(
    "order_check",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE back) AS violations FROM (
    SELECT c < lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events))""",
)
def _(spark, d):
    return quality.order_check(events(spark, d), "c", order_by=ORDER, group_by="user_id")


@query(
    "order_check_wrap",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE s < p AND p - s <= 82800) AS violations FROM (
    SELECT s, lag(s) OVER {W} AS p FROM (SELECT *, {SEC} % 86400 AS s FROM events))""",
)
def _(spark, d):
    df = table(spark, d, "events").withColumn("s", F.floor(quality.day_micros(table(spark, d, "events"), "ts") / 1_000_000).cast("long"))
    return quality.order_check(df, "s", order_by=ORDER, wrap=82_800)


@query(
    "range_check",
    """SELECT 'l_quantity' AS "column", count(l_quantity) AS values, count(*) - count(l_quantity) AS nulls, count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS outside, count(*) FILTER (WHERE round(l_quantity, 0) <> l_quantity) AS bad_decimals FROM lineitem
    UNION ALL SELECT 'l_discount', count(l_discount), count(*) - count(l_discount), count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05), count(*) FILTER (WHERE round(l_discount, 1) <> l_discount) FROM lineitem""",
)
def _(spark, d):
    return quality.range_check(table(spark, d, "lineitem"), {"l_quantity": (5, 45), "l_discount": (0, 0.05)}, {"l_quantity": 0, "l_discount": 1})


@query(
    "text_decimals_check",
    """SELECT count(*) AS values, CAST(0 AS BIGINT) AS not_numbers, count(*) FILTER (WHERE NOT regexp_full_match(CAST(o_totalprice AS VARCHAR), '[+-]?[0-9]+[.][0-9]{2}')) AS bad_decimals
    FROM orders""",
)
def _(spark, d):
    # Plain decimal notation, as a CSV export would write it.
    text = F.regexp_replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), r"(\.\d)0$", "$1")
    return quality.text_decimals_check(table(spark, d, "orders").select(text.alias("p")), "p", 2)


@query("allowed_values", "SELECT event_type AS value, count(*) AS rows FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def _(spark, d):
    return quality.allowed_values(table(spark, d, "events"), "event_type", ["click", "view"])


@query(
    "distribution",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS values, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
        for c in ("l_quantity", "l_linenumber")
    ),
)
def _(spark, d):
    out = quality.distribution(table(spark, d, "lineitem"), ["l_quantity", "l_linenumber"])
    return out.withColumns({"mean": rounded("mean"), "std": rounded("std")})


@query(
    "group_sizes",
    "SELECT count(*) AS groups, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size FROM (SELECT count(*) AS n FROM events GROUP BY user_id)",
)
def _(spark, d):
    return quality.group_sizes(table(spark, d, "events"), "user_id").withColumn("avg_size", rounded("avg_size"))


@query("size_distribution", "SELECT n AS size, count(*) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n")
def _(spark, d):
    return quality.size_distribution(table(spark, d, "lineitem"), "l_orderkey")


@query(
    "repeated_in_groups",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS groups, count(*) FILTER (WHERE u < n) AS repeated FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS u FROM lineitem GROUP BY l_orderkey) WHERE n > 1"
        for c in ("l_suppkey", "l_quantity")
    ),
)
def _(spark, d):
    return quality.repeated_in_groups(table(spark, d, "lineitem"), "l_orderkey", ["l_suppkey", "l_quantity"])


@query(
    "gap_classes",
    f"""SELECT count(*) FILTER (WHERE gap < 660) AS small, count(*) FILTER (WHERE gap >= 660 AND gap < 1200) AS medium, count(*) FILTER (WHERE gap >= 1200) AS large,
    round(count(*) FILTER (WHERE gap >= 3600) * 100.0 / count(gap), 6) AS hour_percent, max(gap) AS largest FROM (
      SELECT lo - lag(hi) OVER (ORDER BY gap_id) AS gap FROM (SELECT gap_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS lo, CAST(floor(epoch(max(ts))) AS BIGINT) AS hi FROM ({GAPS}) GROUP BY gap_id)) WHERE gap IS NOT NULL""",
)
def _(spark, d):
    from colforge.functions.timeparse import seconds_of

    df = timebin.bin_gaps(table(spark, d, "events"), "ts", 600, order_by=ORDER)
    gaps = quality.group_gaps(df, "gap_id", seconds_of(F.col("ts"), df.schema["ts"].dataType), order_by=ORDER)
    return quality.gap_classes(gaps, 660, 1200).withColumn("hour_percent", rounded("hour_percent"))


@query(
    "time_span",
    "SELECT min(ts) AS first, max(ts) AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 < 24 AS within_day FROM events",
)
def _(spark, d):
    return quality.time_span(table(spark, d, "events"), "ts").withColumn("hours", rounded("hours"))


@query(
    "constraint_check",
    """SELECT 'o_orderkey' AS "column", 'not_null' AS "constraint", count(*) - count(o_orderkey) AS violations FROM orders
    UNION ALL SELECT 'o_orderkey', 'unique', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'o_custkey', 'unique', count(o_custkey) - count(DISTINCT o_custkey) FROM orders""",
)
def _(spark, d):
    return quality.constraint_check(table(spark, d, "orders"), not_null=["o_orderkey"], unique=["o_orderkey", "o_custkey"])


@query(
    "quality_report",
    f"""SELECT 'order of values' AS "check", CASE WHEN v > 0 THEN 'error' ELSE 'info' END AS level, v AS value, CAST(0 AS BIGINT) AS expected FROM (
      SELECT count(*) FILTER (WHERE value < p) AS v FROM (SELECT value, lag(value) OVER {W} AS p FROM events))
    UNION ALL SELECT 'duplicate keys', CASE WHEN v > 0 THEN 'warning' ELSE 'info' END, v, 0 FROM (SELECT count(*) - count(DISTINCT event_id) AS v FROM events)""",
)
def _(spark, d):
    df = table(spark, d, "events")
    return quality.report(
        ("order of values", quality.order_check(df, "value", order_by=ORDER), "violations", 0, quality.ERROR),
        ("duplicate keys", quality.constraint_check(df, unique=["event_id"]), "violations", 0, quality.WARNING),
    )


# --- summary statistics ---------------------------------------------------------------------------

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


def _summary_sql(where="", extra=""):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS values, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean,
        round(median({c}), 6) AS median, round(stddev_pop({c}), 6) AS std{extra} FROM lineitem {where}"""
        for c in COLUMNS
    )


def _tidy(df):
    return df.withColumns({c: rounded(c) for c in ("mean", "median", "std")})


@query("summary_stats", _summary_sql())
def _(spark, d):
    return _tidy(stats.summary(table(spark, d, "lineitem"), COLUMNS))


BIG = "SELECT l_orderkey % 2000 * 4503599627370497 + l_linenumber AS big, l_partkey FROM lineitem"


def _integer_sql(column):
    middle = f"(SELECT CAST(sum({column}) AS DECIMAL(38,1)) FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) AS r, count(*) OVER () AS n FROM ({BIG}) WHERE {column} IS NOT NULL) WHERE r IN ((n + 1) // 2, n // 2 + 1))"
    halves = f"(SELECT CASE WHEN count(*) % 2 = 1 THEN 1 ELSE 2 END FROM ({BIG}) WHERE {column} IS NOT NULL)"
    return f"""SELECT '{column}' AS "column", count({column}) AS "values", min({column}) AS min, max({column}) AS max,
    CAST({middle} * CASE WHEN {halves} = 1 THEN 2 ELSE 1 END AS VARCHAR) AS twice_median, CAST(CAST(sum({column}::HUGEINT) AS VARCHAR) AS DOUBLE) / count({column}) AS mean FROM ({BIG})"""


@query("summary_bigint", f"{_integer_sql('big')} UNION ALL {_integer_sql('l_partkey')}")
def _(spark, d):
    """Integers beyond 2^53 keep all their digits; the median is compared doubled, as text."""
    big = F.expr("l_orderkey % 2000 * 4503599627370497 + l_linenumber")
    df = table(spark, d, "lineitem").select(big.alias("big"), "l_partkey")
    out = stats.summary_integers(df, ["big", "l_partkey"])
    return out.select("column", "values", "min", "max", (F.col("median") * 2).cast("decimal(38,1)").cast("string").alias("twice_median"), "mean")


@query("summary_stats_narrowing", _summary_sql())
def _(spark, d):
    """The path for big tables: medians by narrowing bands instead of one value map."""
    return _tidy(stats.summary(table(spark, d, "lineitem"), COLUMNS, small=0))


@query(
    "summary_selected",
    _summary_sql(
        "WHERE l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.06",
        ", count(*) AS selected_rows, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 6) AS selected_percent",
    ),
)
def _(spark, d):
    ranges = {"l_quantity": (10, 30), "l_discount": (0.02, 0.06)}
    out = stats.summary_selected(table(spark, d, "lineitem"), COLUMNS, ranges)
    return _tidy(out).withColumn("selected_percent", rounded("selected_percent"))


HIST = """SELECT CAST(least(floor((x - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS rows{extra}
    FROM (SELECT *, l_extendedprice AS x, min(l_extendedprice) OVER () AS lo, max(l_extendedprice) OVER () AS hi FROM lineitem) GROUP BY 1"""


@query("histogram30", HIST.format(extra=", round(min(lo) + CAST(least(floor((min(x) - min(lo)) / ((min(hi) - min(lo)) / 30)), 29) AS INTEGER) * ((min(hi) - min(lo)) / 30), 4) AS low"))
def _(spark, d):
    out = stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30)
    return out.select("bin", "rows", rounded("low", 4).alias("low"))


@query("histogram_crossfilter", HIST.format(extra=", count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 30) AS selected"))
def _(spark, d):
    out = stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30, {"l_quantity": (10, 30)})
    return out.select("bin", "rows", "selected")


@query(
    "systematic_sample",
    """SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, greatest(1, count(*) OVER () // 700) AS step FROM events)
    WHERE i % step = 0 AND i < step * 700""",
)
def _(spark, d):
    return stats.systematic_sample(table(spark, d, "events"), 700, order_by=ORDER).select("event_id", "event_type")


@query(
    "category_codes",
    """SELECT e.event_id, k.code AS event_type_code FROM events e JOIN (
      SELECT event_type, row_number() OVER (ORDER BY min(ROW(ts, event_id))) - 1 AS code FROM events GROUP BY event_type) k USING (event_type)""",
)
def _(spark, d):
    return stats.category_codes(table(spark, d, "events"), "event_type", order_by=ORDER).select("event_id", "event_type_code")


@query(
    "numeric_form",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS done, epoch(o_orderdate) AS o_orderdate FROM orders",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("done"), "o_orderdate")
    return df.select("o_orderkey", *[stats.numeric_form(F.col(c), df.schema[c].dataType).alias(c) for c in ("done", "o_orderdate")])


@query("export_selection", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_tax BETWEEN 0.01 AND 0.03")
def _(spark, d):
    df = stats.select_ranges(table(spark, d, "lineitem"), {"l_quantity": (10, 12), "l_tax": (0.01, 0.03)})
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
