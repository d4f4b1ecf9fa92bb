"""SQL constructs, each over whole tables. The same text runs in both engines unless dialects differ."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from colforge import query as q
from colforge.queries.base import QUERIES, query, rounded, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")


def views(spark, d, text):
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, d, name).createOrReplaceTempView(name)


def sql(name: str, text: str, duck: str | None = None):
    def run(spark, d):
        views(spark, d, text)
        return q.run_sql(spark, text)

    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = (run, duck or text)


CENTS = "CAST(round({} * 100) AS BIGINT)"
EP, TP, DISC = CENTS.format("l_extendedprice"), CENTS.format("o_totalprice"), CENTS.format("l_discount")
VAL = CENTS.format("value")
NET = f"({EP} * (100 - {DISC}))"
# Events with empty cells, for the NULL rules.
EVN = f"(SELECT event_id, ts, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE {VAL} END AS c FROM events) AS evn"

sql("sql_select_columns", "SELECT c_custkey AS id, c_name, c_mktsegment AS segment FROM customer")
sql("sql_filter_compare", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' OR l_discount < 0.01 AND l_tax = 0.08")
sql("sql_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
sql("sql_boolean", "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus = 'F' AS done, o_totalprice > 200000 AS big FROM orders) AS t WHERE done = true AND big = false")
sql(
    "sql_time_of_day",
    "SELECT event_id FROM events WHERE date_format(ts, 'HH:mm:ss') > '12:00:00' AND date_format(ts, 'HH:mm:ss') BETWEEN '10:00:00' AND '18:30:00'",
    "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') > '12:00:00' AND strftime(ts, '%H:%M:%S') BETWEEN '10:00:00' AND '18:30:00'",
)
sql("sql_is_null", f"SELECT event_id, c IS NULL AS missing FROM {EVN} WHERE c IS NULL OR c IS NOT NULL AND event_type = 'click'")
sql("sql_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND p_name NOT LIKE 'red%'")
sql("sql_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
sql("sql_quoted_identifier", 'SELECT "o_orderkey" AS "order key" FROM orders WHERE "o_orderstatus" = \'P\'')
sql("sql_counts", f"SELECT event_type, count(*) AS n, count(c) AS filled, count(DISTINCT user_id) AS users FROM {EVN} GROUP BY event_type")
sql("sql_min_max_avg", f"SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi, min({TP}) AS cheapest, round(avg({TP}), 4) AS mean FROM orders")
sql(
    "sql_sum_stddev",
    f"SELECT l_returnflag, sum({EP}) AS total, round(stddev(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
    f"SELECT l_returnflag, CAST(sum({EP}) AS BIGINT) AS total, round(stddev(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
)
sql("sql_group_by", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey")
sql(
    "sql_conditional_agg",
    f"SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, sum(CASE WHEN c > 2000 THEN c ELSE 0 END) AS big, count(*) FILTER (WHERE c IS NULL) AS missing, round(avg(CASE WHEN c > 2000 THEN c END), 6) AS mean_big FROM {EVN} GROUP BY user_id",
    f"SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, CAST(sum(CASE WHEN c > 2000 THEN c ELSE 0 END) AS BIGINT) AS big, count(*) FILTER (WHERE c IS NULL) AS missing, round(avg(CASE WHEN c > 2000 THEN c END), 6) AS mean_big FROM {EVN} GROUP BY user_id",
)
sql("sql_round_arithmetic", f"SELECT event_type, round(1e2 * count(c) / count(*), 2) AS filled_percent, count(*) - count(c) AS missing FROM {EVN} GROUP BY event_type")
sql("sql_coalesce_nullif_case", f"SELECT event_id, coalesce(c, 0) AS c0, nullif(event_type, 'view') AS kind, CASE WHEN c IS NULL THEN 'none' WHEN c < 1000 THEN 'low' ELSE 'high' END AS level FROM {EVN}")
sql(
    "sql_cast",
    "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS t, CAST(o_totalprice AS INTEGER) AS i, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, try_cast(o_orderpriority AS INTEGER) AS bad FROM orders",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(trunc(o_totalprice) AS INTEGER) AS i, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, try_cast(o_orderpriority AS INTEGER) AS bad FROM orders",
)
sql("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("sql_order_nulls", f"SELECT event_id, c, row_number() OVER (PARTITION BY user_id ORDER BY c ASC NULLS FIRST, event_id DESC) AS place FROM {EVN}",
    f"SELECT event_id, c, CAST(row_number() OVER (PARTITION BY user_id ORDER BY c ASC NULLS FIRST, event_id DESC) AS INT) AS place FROM {EVN}")
sql("sql_order_nulls_last", f"SELECT event_id, c, row_number() OVER (PARTITION BY user_id ORDER BY c DESC NULLS LAST, event_id) AS place FROM {EVN}",
    f"SELECT event_id, c, CAST(row_number() OVER (PARTITION BY user_id ORDER BY c DESC NULLS LAST, event_id) AS INT) AS place FROM {EVN}")
sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
sql("sql_limit_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
sql("sql_derived_table", "SELECT count(*) AS total FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) AS t WHERE n > 2")
sql("sql_extract", "SELECT extract(HOUR FROM ts) AS hour, count(*) AS n FROM events GROUP BY extract(HOUR FROM ts)",
    "SELECT CAST(extract(HOUR FROM ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")

sql("sql_join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
sql("sql_join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey")
sql("sql_join_right", "SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
sql("sql_join_full", "SELECT coalesce(s.s_nationkey, c.c_nationkey) AS nation, s.ns, c.nc FROM (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY c_nationkey) c ON s.s_nationkey = c.c_nationkey")
sql("sql_join_using", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)")
sql("sql_join_theta", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate AND l_extendedprice > o_totalprice / 10")
sql("sql_semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000",
    "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
sql("sql_anti_join", "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON l.doc_id = d.doc_id",
    "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")

sql(
    "sql_window_ranks",
    f"SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY {TP} NULLS LAST, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority NULLS LAST)",
)
sql(
    "sql_window_values",
    f"SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS lg, lead(o_orderkey, 2) OVER w AS ld, first_value({TP}) OVER w AS fv, last_value({TP}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value({TP}, 2) OVER w AS nv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
sql(
    "sql_window_frames",
    f"SELECT o_orderkey, sum({TP}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS in_range FROM orders",
    f"SELECT o_orderkey, CAST(sum({TP}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS in_range FROM orders",
)
sql(
    "sql_window_groups_frame",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority NULLS LAST) AS g FROM orders) AS t",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority NULLS LAST GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
)
sql(
    "sql_cte",
    f"WITH spend AS (SELECT o_custkey, sum({TP}) AS s FROM orders GROUP BY o_custkey), big AS (SELECT o_custkey, s FROM spend WHERE s > 50000000) SELECT c_mktsegment, count(*) AS n, max(s) AS top FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    f"WITH spend AS (SELECT o_custkey, CAST(sum({TP}) AS BIGINT) AS s FROM orders GROUP BY o_custkey), big AS (SELECT o_custkey, s FROM spend WHERE s > 50000000) SELECT c_mktsegment, count(*) AS n, max(s) AS top FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
)
sql(
    "sql_subqueries",
    "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
)
sql(
    "sql_subquery_correlated",
    "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem a WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)",
)
sql("sql_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 AND max(l_discount) > 0.05")
sql("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("sql_union_all", "SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
sql("sql_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
sql("sql_except", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
sql("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql("sql_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
sql("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql(
    "sql_statistics",
    "SELECT l_returnflag, median(l_quantity) AS med, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(stddev_pop(l_quantity), 6) AS sp, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(corr(l_quantity, l_extendedprice), 6) AS co, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS rc FROM lineitem GROUP BY l_returnflag",
)
sql(
    "sql_bit_bool_aggregates",
    "SELECT o_custkey, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx, bool_and(o_totalprice > 1000) AS al, bool_or(o_totalprice > 400000) AS an FROM orders GROUP BY o_custkey",
)
sql(
    "sql_collect",
    "SELECT c_nationkey, size(collect_set(c_mktsegment)) AS segments, listagg(DISTINCT c_mktsegment, ',') WITHIN GROUP (ORDER BY c_mktsegment) AS names FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, CAST(len(list(DISTINCT c_mktsegment)) AS INTEGER) AS segments, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS names FROM customer GROUP BY c_nationkey",
)
sql(
    "sql_first_last",
    "SELECT user_id, min_by(event_type, ts) AS first_kind, max_by(event_type, ts) AS last_kind FROM events GROUP BY user_id",
    "SELECT user_id, arg_min(event_type, ts) AS first_kind, arg_max(event_type, ts) AS last_kind FROM events GROUP BY user_id",
)
sql(
    "sql_strings",
    "SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_brand) AS lo, trim(concat('  ', p_type, ' ')) AS tr, substr(p_name, 2, 4) AS su, replace(p_name, 'e', '*') AS rp, split_part(p_name, ' ', 2) AS sp, concat_ws('-', p_brand, p_type) AS cw, lpad(p_brand, 12, '.') AS lp, rpad(p_brand, 12, '.') AS rpd, reverse(p_name) AS rv, repeat(p_type, 2) AS rt, instr(p_name, 'i') AS st, startswith(p_name, 'red') AS sw, translate(p_name, 'abc', 'xyz') AS ts, levenshtein(p_name, p_type) AS lv, left(p_name, 3) AS lf, right(p_name, 3) AS rg, ascii(p_name) AS asc FROM part",
    "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS u, lower(p_brand) AS lo, trim(concat('  ', p_type, ' ')) AS tr, substr(p_name, 2, 4) AS su, replace(p_name, 'e', '*') AS rp, split_part(p_name, ' ', 2) AS sp, concat_ws('-', p_brand, p_type) AS cw, lpad(p_brand, 12, '.') AS lp, rpad(p_brand, 12, '.') AS rpd, reverse(p_name) AS rv, repeat(p_type, 2) AS rt, CAST(instr(p_name, 'i') AS INTEGER) AS st, starts_with(p_name, 'red') AS sw, translate(p_name, 'abc', 'xyz') AS ts, CAST(levenshtein(p_name, p_type) AS INTEGER) AS lv, left(p_name, 3) AS lf, right(p_name, 3) AS rg, ascii(p_name) AS asc FROM part",
)
sql(
    "sql_regex",
    "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, regexp_replace(url, '[0-9]+', '#') AS masked, regexp_like(url, 'page=[0-9]') AS paged, regexp_count(url, '/') AS slashes FROM pages",
    "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)', 2) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_matches(url, 'page=[0-9]') AS paged, CAST(length(url) - length(replace(url, '/', '')) AS INTEGER) AS slashes FROM pages",
)
sql(
    "sql_initcap",
    "SELECT c_custkey, initcap(lower(c_mktsegment)) AS s FROM customer",
    "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS s FROM customer",
)
sql(
    "sql_math",
    "SELECT l_orderkey, l_partkey, l_linenumber, abs(l_quantity - 25) AS ab, ceil(l_extendedprice) AS ce, floor(l_extendedprice) AS fl, sign(l_extendedprice - 30000) * floor(abs(l_extendedprice - 30000)) AS tr, round(power(l_quantity, 2), 4) AS pw, round(sqrt(l_quantity), 6) AS sq, round(ln(l_quantity), 6) AS l, round(log10(l_quantity), 6) AS lg, round(exp(l_discount), 6) AS ex, round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS cs, sign(l_discount) AS sg, l_partkey % 7 AS md FROM lineitem",
    "SELECT l_orderkey, l_partkey, l_linenumber, abs(l_quantity - 25) AS ab, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, CAST(floor(l_extendedprice) AS BIGINT) AS fl, trunc(l_extendedprice - 30000) + 0.0 AS tr, round(power(l_quantity, 2), 4) AS pw, round(sqrt(l_quantity), 6) AS sq, round(ln(l_quantity), 6) AS l, round(log10(l_quantity), 6) AS lg, round(exp(l_discount), 6) AS ex, round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS cs, CAST(sign(l_discount) AS DOUBLE) AS sg, l_partkey % 7 AS md FROM lineitem",
)
sql(
    "sql_dates",
    "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS mo, year(o_orderdate) AS y, quarter(o_orderdate) AS qu, dayofyear(o_orderdate) AS doy, CAST(o_orderdate + INTERVAL 90 DAYS AS DATE) AS plus90, datediff(DATE'2000-01-01', o_orderdate) AS dd, CAST(last_day(o_orderdate) AS DATE) AS ld, make_date(year(o_orderdate), 2, 1) AS feb, date_format(o_orderdate, 'yyyy-MM-dd') AS txt, to_date(date_format(o_orderdate, 'dd/MM/yyyy'), 'dd/MM/yyyy') AS back FROM orders",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS qu, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS plus90, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS dd, last_day(o_orderdate) AS ld, make_date(year(o_orderdate), 2, 1) AS feb, strftime(o_orderdate, '%Y-%m-%d') AS txt, CAST(o_orderdate AS DATE) AS back FROM orders",
)
sql(
    "sql_date_bin",
    "SELECT window.start AS bucket, count(*) AS n FROM events GROUP BY window(ts, '15 minutes')",
    "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS n FROM events GROUP BY 1",
)
sql(
    "sql_arrays",
    "SELECT vec_id, size(embedding) AS n, round(CAST(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x) AS DOUBLE), 4) AS norm, size(filter(embedding, x -> x > 0)) AS positive, array_contains(transform(embedding, x -> x < -0.4), true) AS far FROM embeddings",
    "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive, list_contains(list_transform(embedding, lambda x: x < CAST(-0.4 AS DOUBLE)), true) AS far FROM embeddings",
)
sql(
    "sql_explode",
    "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) AS t GROUP BY word",
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) AS t GROUP BY word",
)
sql(
    "sql_maps_structs",
    "SELECT o_orderkey, element_at(map('a', o_orderstatus, 'b', o_orderpriority), 'b') AS b, named_struct('k', o_custkey, 's', o_orderstatus).k AS k FROM orders",
    "SELECT o_orderkey, map {'a': o_orderstatus, 'b': o_orderpriority}['b'] AS b, {'k': o_custkey, 's': o_orderstatus}.k AS k FROM orders",
)
sql(
    "sql_hashes",
    "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s, base64(CAST(lang AS BINARY)) AS b, hex(lang) AS h FROM documents",
    "SELECT doc_id, md5(text) AS m, sha256(text) AS s, base64(CAST(lang AS BLOB)) AS b, hex(lang) AS h FROM documents",
)
sql(
    "sql_json",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)

# --- whole business questions ---------------------------------------------------------------------

sql(
    "sql_pricing_summary",
    f"SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, sum({EP}) AS sum_base, sum({NET}) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg({EP}), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ'2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    f"SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum({EP}) AS BIGINT) AS sum_base, CAST(sum({NET}) AS BIGINT) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg({EP}), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
)
sql(
    "sql_shipping_priority",
    f"SELECT l_orderkey, sum({NET}) AS revenue, o_orderdate, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC NULLS LAST, l_orderkey LIMIT 10",
    f"SELECT l_orderkey, CAST(sum({NET}) AS BIGINT) AS revenue, o_orderdate, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC NULLS LAST, l_orderkey LIMIT 10",
)
sql(
    "sql_region_revenue",
    f"SELECT r_name, n_name, sum({NET}) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name",
    f"SELECT r_name, n_name, CAST(sum({NET}) AS BIGINT) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name",
)
sql(
    "sql_forecast_revenue",
    f"SELECT sum({EP} * {DISC}) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ'1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ'1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    f"SELECT CAST(sum({EP} * {DISC}) AS BIGINT) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
)


# --- paging and guided tools ----------------------------------------------------------------------


@query("page_of_orders", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return q.page_rows(df, 2, 25, ["o_orderkey"])


@query(
    "page_with_total",
    "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_rows FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40",
)
def _(spark, d):
    page = q.paginate(table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"), 2, 20, ["o_orderkey"])
    return page.rows.withColumn("total_rows", F.lit(page.total_rows).cast("long"))


@query("guided_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 90000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE '%HIGH%'")
def _(spark, d):
    tests = [("o_totalprice", "between", (50000, 90000)), ("o_orderstatus", "in", ["F", "P"]), ("o_orderpriority", "like", "%HIGH%")]
    return q.filter_rows(table(spark, d, "orders"), tests).select("o_orderkey")


@query("guided_sort", "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INT) AS place FROM orders")
def _(spark, d):
    """The whole table in order; what is compared is each order's place among those of its customer."""
    rows = q.sort_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"])
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("__at"))
    return rows.withColumn("__at", F.monotonically_increasing_id()).select("o_orderkey", "o_totalprice", place.alias("place"))


@query("page_after", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > '1995-03-01' OR (o_orderdate = '1995-03-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 25")
def _(spark, d):
    """The page behind a given row, however deep it lies."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    after = [F.lit("1995-03-01").cast(rows.schema["o_orderdate"].dataType), 100]
    return q.page_after(rows, ["o_orderdate", "o_orderkey"], after, 25)


@query(
    "guided_aggregate",
    "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(o_custkey) AS BIGINT) AS keys, round(avg(o_custkey), 6) AS mean_key FROM orders GROUP BY o_orderstatus",
)
def _(spark, d):
    out = q.aggregate_groups(
        table(spark, d, "orders"),
        ["o_orderstatus"],
        {"n": ("count", "*"), "customers": ("count_distinct", "o_custkey"), "keys": ("sum", "o_custkey"), "mean_key": ("avg", "o_custkey")},
    )
    return out.withColumn("mean_key", rounded("mean_key"))
