"""Relational queries: scans, filters, joins, aggregation, windows, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import relational as R
from quillon.plans.registry import query, sql_query

# ------------------------------------------------------------------ scans, projections, filters
sql_query("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity < 5")
sql_query("scan_reverse_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
sql_query("index_skip_scan", "SELECT DISTINCT o_orderpriority FROM orders")
sql_query("zigzag_conjunction", "SELECT p_partkey, p_name FROM part WHERE p_size = 11 AND p_type = 'ECONOMY'")
sql_query("interleaved_join", "SELECT o_orderkey, o_orderstatus, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND o_orderstatus = 'F'")
sql_query("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
sql_query("unary_row", "SELECT 1 AS one")
sql_query("zero_rows", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0")
sql_query("comparison_filters", "SELECT o_orderkey FROM orders WHERE o_totalprice <> 0 AND o_totalprice <= 200000 AND o_custkey > 100 AND o_custkey >= 101 AND o_custkey < 900 AND o_orderstatus = 'O'")
sql_query(
    "arithmetic_projection",
    "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - 1 AS b, l_quantity * 2 AS c, l_quantity / 4 AS d, CAST(l_orderkey % 7 AS BIGINT) AS m, l_orderkey div 3 AS q, l_linenumber & 3 AS band, l_linenumber | 8 AS bor, l_linenumber ^ 5 AS bxor, shiftleft(l_linenumber, 2) AS sl, shiftright(l_linenumber, 1) AS sr, ~l_linenumber AS inv FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - 1 AS b, l_quantity * 2 AS c, l_quantity / 4 AS d, CAST(l_orderkey % 7 AS BIGINT) AS m, l_orderkey // 3 AS q, l_linenumber & 3 AS band, l_linenumber | 8 AS bor, xor(l_linenumber, 5) AS bxor, l_linenumber << 2 AS sl, l_linenumber >> 1 AS sr, ~l_linenumber AS inv FROM lineitem",
)
sql_query("and_or_three_valued", "SELECT id, (a AND b) AS conj, (a OR b) AS disj, (NOT a) AS neg FROM (VALUES (1, true, NULL), (2, false, NULL), (3, CAST(NULL AS BOOLEAN), NULL), (4, true, false)) AS t(id, a, b)")
sql_query("in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
sql_query("like_filters", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%bolt' OR p_name LIKE '%ed w%' OR p_name ILIKE 'BLUE RI__'")
sql_query("regex_filters", "SELECT p_partkey FROM part WHERE p_name RLIKE '^(small|red) [a-m]' AND NOT p_brand RLIKE '(?i)BRAND#1$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(small|red) [a-m]') AND NOT regexp_matches(p_brand, '(?i)BRAND#1$')")
sql_query("null_tests", "SELECT id, x IS NULL AS n, x IS NOT NULL AS nn, coalesce(isnan(x), false) AS nan FROM (VALUES (1, CAST(1.5 AS DOUBLE)), (2, NULL), (3, CAST('NaN' AS DOUBLE))) AS t(id, x)")
sql_query("is_distinct_from", "SELECT id, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM (VALUES (1, 1, 1), (2, 1, NULL), (3, CAST(NULL AS INT), NULL), (4, 1, 2)) AS t(id, a, b)")
sql_query("between_symmetric", "SELECT o_orderkey, o_totalprice BETWEEN 100000 AND 200000 AS b, o_totalprice BETWEEN least(200000, 100000) AND greatest(200000, 100000) AS s FROM orders")
sql_query("case_expressions", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS simple, CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 100000 THEN 2 END AS searched FROM orders")
sql_query("casts", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS i, CAST(o_custkey AS STRING) AS s, CAST(o_orderdate AS DATE) AS d, try_cast(o_orderpriority AS INT) AS bad FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 500 AND o_totalprice - floor(o_totalprice) < 0.4", "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS i, CAST(o_custkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS d, try_cast(o_orderpriority AS INT) AS bad FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 500 AND o_totalprice - floor(o_totalprice) < 0.4")
sql_query("constants_and_typed_nulls", "SELECT n_nationkey, 42 AS i, 'x' AS s, true AS b, CAST(NULL AS INT) AS n, TIMESTAMP '2024-01-02 03:04:05' AS t FROM nation", None)
sql_query("conditionals", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS c, if(n_regionkey > 2, 'hi', 'lo') AS i, ifnull(nullif(n_name, 'NATION_3'), 'none') AS f FROM nation", None)
sql_query("iferror", "SELECT n_nationkey, coalesce(try_divide(10, n_regionkey), -1) AS r, try_divide(1, n_regionkey) IS NULL AS is_error FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN -1 ELSE 10 / n_regionkey END AS r, n_regionkey = 0 AS is_error FROM nation")
sql_query("ts_noop_post_process", "SELECT user_id, value * 2 AS v2 FROM events WHERE value > 50 ORDER BY event_id LIMIT 10 OFFSET 5")
sql_query("any_some_all", "SELECT n_nationkey, exists(array(1, 2, 3), x -> x = n_regionkey) AS any_eq, forall(array(0, 1, 2), x -> x < n_regionkey) AS all_lt, exists(array('%_1%', '%_2%'), p -> n_name LIKE p) AS like_any FROM nation", "SELECT n_nationkey, list_contains([1, 2, 3], n_regionkey) AS any_eq, 0 < n_regionkey AND 1 < n_regionkey AND 2 < n_regionkey AS all_lt, n_name LIKE '%_1%' OR n_name LIKE '%_2%' AS like_any FROM nation")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(small|red).*(t|g)')")
def similar_to(t):
    return t.part.where(F.col("p_name").rlike(R.similar_to("(small|red)%(t|g)"))).select("p_partkey")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name, n_nationkey) AS ordinality FROM nation")
def with_ordinality(t):
    return R.with_ordinality(t.nation.select("n_nationkey", "n_name"), ["n_name", "n_nationkey"])


@query("SELECT r_regionkey, CASE WHEN i <= 3 THEN i END AS a, CASE WHEN i <= r_regionkey + 1 THEN 10 * i END AS b FROM region, generate_series(1, 5) AS g(i) WHERE i <= greatest(3, r_regionkey + 1)")
def project_set_rows_from(t):
    a = F.sequence(F.lit(1), F.lit(3))
    b = F.transform(F.sequence(F.lit(1), F.col("r_regionkey") + 1), lambda x: 10 * x)
    return R.rows_from(t.region.select("r_regionkey"), a=a, b=b)


sql_query("generate_series", "SELECT r_regionkey, explode(sequence(1, 5, 2)) AS i FROM region", "SELECT r_regionkey, unnest(generate_series(1, 5, 2)) AS i FROM region")

# ------------------------------------------------------------------ joins
sql_query("join_agg_having_sort", "SELECT n_name, count(*) AS n_orders, round(avg(o_totalprice), 8) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY n_name HAVING count(*) > 3 ORDER BY n_orders DESC, n_name")
sql_query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
sql_query("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
sql_query("join_full", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey + 23")
sql_query("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
sql_query("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 450000)")
sql_query("exists_in_not_in", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.079)")
sql_query("not_in_with_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)")
sql_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_theta_range", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_acctbal BETWEEN a.s_acctbal - 100 AND a.s_acctbal + 100 AND a.s_suppkey < b.s_suppkey")
sql_query("join_using", "SELECT l_orderkey, o_totalprice, l_quantity FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 2) JOIN (SELECT o_orderkey AS l_orderkey, o_totalprice FROM orders) USING (l_orderkey)")
sql_query("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region)")
sql_query("join_lateral", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
sql_query("join_apply_scalar", "SELECT c_custkey, (SELECT round(max(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
sql_query("join_hash_hint", "SELECT /*+ SHUFFLE_HASH(customer) */ o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_merge_hint", "SELECT /*+ MERGE(customer) */ o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_lookup", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 48")
sql_query("fk_existence_check", "SELECT o_orderkey FROM orders LEFT ANTI JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
sql_query("update_from", "SELECT c_custkey, c_name, coalesce(t.total, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) t ON c_custkey = o_custkey")


@query("SELECT c_nationkey, CAST(count(o_totalprice) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, round(avg(o_totalprice), 8) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def eager_aggregation_below_join(t):
    dim = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    out = R.eager_aggregate_join(t.orders.select("o_custkey", "o_totalprice"), dim, ["o_custkey"], ["c_nationkey"], "o_totalprice")
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 8))


# ------------------------------------------------------------------ aggregation
sql_query("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 8) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus")
sql_query("scalar_aggregate", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 8) AS mean FROM orders")
sql_query("distinct_aggregates", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS key_sum FROM orders GROUP BY o_orderstatus")
sql_query("aggregate_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS n_big, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 8) AS urgent FROM orders GROUP BY o_orderstatus")
sql_query("group_by_alias_ordinal", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY y, 2")
sql_query("having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550")
sql_query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql_query("cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
sql_query("count_rows", "SELECT count(*) AS n FROM lineitem")
sql_query("sum_int_widened", "SELECT CAST(sum(CAST(l_orderkey AS DECIMAL(38, 0))) AS DECIMAL(38, 0)) AS s FROM lineitem", "SELECT CAST(sum(l_orderkey) AS DECIMAL(38, 0)) AS s FROM lineitem")
sql_query("boolean_aggregates", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 499000) AS o FROM orders GROUP BY o_orderpriority")
sql_query("xor_agg", "SELECT l_returnflag, bit_xor(l_orderkey) AS x FROM lineitem GROUP BY l_returnflag")
sql_query("stddev_variance", "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 3) AS sd, round(var_samp(o_totalprice) / 1e6, 3) AS v FROM orders GROUP BY o_orderstatus")
sql_query("corr", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 8) AS c FROM lineitem GROUP BY l_returnflag")
sql_query("concat_agg", "SELECT n_regionkey, listagg(n_name) WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("string_agg", "SELECT n_regionkey, string_agg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql_query("any_not_null", "SELECT k, any_value(x, true) AS x FROM (VALUES (1, CAST(NULL AS INT)), (1, 5), (2, NULL)) AS t(k, x) GROUP BY k", "SELECT k, max(x) AS x FROM (VALUES (1, CAST(NULL AS INT)), (1, 5), (2, NULL)) AS t(k, x) GROUP BY k")
sql_query("bit_and_or", "SELECT l_returnflag, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o FROM lineitem GROUP BY l_returnflag")
sql_query("percentiles", "SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS med, quantile_disc(o_totalprice, 0.9) AS p90 FROM orders GROUP BY o_orderstatus")


@query("SELECT n_regionkey, to_json(list(n_nationkey ORDER BY n_nationkey)) AS j FROM nation GROUP BY n_regionkey")
def json_agg(t):
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_nationkey"))).alias("j"))


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
def array_agg_ordered(t):
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")), asc=False)
    return t.nation.groupBy("n_regionkey").agg(F.transform(rows, lambda r: r["n_name"]).alias("names"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def distinct_on(t):
    return R.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2")
def max_one_row(t):
    return R.max_one_row(t.region.where("r_regionkey = 2"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice < 0")
def error_if_rows(t):
    return R.error_if_rows(t.orders.where("o_totalprice < 0").select("o_orderkey", "o_custkey"), "negative price")


@query()
def approximate_distinct(t):
    """HyperLogLog++ sketch, an estimate; SQL has no such rows."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


# ------------------------------------------------------------------ windows
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql_query("window_row_number_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer")
sql_query("window_relative_rank", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 9) AS cd, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nt FROM customer")
sql_query("window_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER w AS lag1, lead(o_totalprice, 2) OVER w AS lead2, first_value(o_orderkey) OVER w AS fv, nth_value(o_orderkey, 2) OVER w AS nv FROM orders WINDOW w AS ({_W})")
sql_query("window_aggregates_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS c, min(o_totalprice) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM orders")
sql_query("window_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '12' HOUR PRECEDING AND INTERVAL '12' HOUR FOLLOWING) AS hi FROM events")
sql_query("window_filter", f"SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER ({_W}) AS n_done FROM orders", f"SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER ({_W}) AS n_done FROM orders")
sql_query("window_named", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS q, max(l_quantity) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS q, max(l_quantity) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")


@query("SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM customer")
def window_groups_frame(t):
    return R.groups_frame(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", 1, 0, F.sum("c_custkey"), "s").select("c_custkey", "s")


@query("SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS BIGINT) AS no_group, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS no_row, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS BIGINT) AS no_ties FROM customer")
def window_exclude(t):
    """A sum over a frame less what is excluded, as differences of two frames; null where nothing is left."""
    x = F.col("c_custkey")
    every, peers = W.partitionBy("c_nationkey"), W.partitionBy("c_nationkey", "c_mktsegment")
    total, group, n, g = F.sum(x).over(every), F.sum(x).over(peers), F.count(x).over(every), F.count(x).over(peers)
    return t.customer.select("c_custkey", F.when(n > g, total - group).alias("no_group"), F.when(n > 1, total - x).alias("no_row"), (total - group + x).alias("no_ties"))


@query("SELECT event_id, (SELECT count(DISTINCT b.event_type) FROM events b WHERE b.user_id = a.user_id AND b.ts <= a.ts) AS kinds FROM events a")
def window_count_distinct(t):
    """A running sum of first occurrences: the frame ends with the peers of a row, as the default frame does."""
    first = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts")) == 1
    rows = t.events.withColumn("new", (first & F.col("event_type").isNotNull()).cast("long"))
    return rows.select("event_id", F.sum("new").over(W.partitionBy("user_id").orderBy("ts")).alias("kinds"))


# ------------------------------------------------------------------ sort, limit
sql_query("sort_nulls", "SELECT id, x, row_number() OVER (ORDER BY x ASC NULLS FIRST, id) AS up, row_number() OVER (ORDER BY x DESC NULLS LAST, id) AS down FROM (VALUES (1, 3), (2, NULL), (3, 1)) AS t(id, x)")
sql_query("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
sql_query("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
sql_query("top_k_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")

# ------------------------------------------------------------------ set operations, CTEs, subqueries
sql_query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
sql_query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql_query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql_query("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000")
sql_query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql_query("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE n > 15) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE c_custkey IN (SELECT o_custkey FROM top)")
sql_query("recursive_cte", "WITH RECURSIVE walk(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM walk WHERE n < 20) SELECT n, total FROM walk")
sql_query("subqueries", "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
sql_query("row_comparison", "SELECT n_nationkey FROM nation WHERE n_regionkey > 2 OR (n_regionkey = 2 AND n_nationkey > 10)", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (2, 10)")
sql_query("view_query", "SELECT k, n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) WHERE n > 50")
sql_query("prepared_statement_shape", "SELECT o_orderkey FROM orders WHERE o_custkey = 10 AND o_totalprice > 1000.0")
sql_query("shipping_volume", "SELECT n_name, year(l_shipdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY n_name, year(l_shipdate)")
sql_query("promotion_effect", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'ECON%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey")
sql_query("large_volume_customers", "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) SELECT c_custkey, o_orderkey, q FROM big JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", "SELECT c_custkey, o_orderkey, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_custkey, o_orderkey")
