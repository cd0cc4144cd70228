"""Scalar functions by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import geometry as G
from quillon.functions import scalar as S
from quillon.plans.registry import query, sql_query

sql_query(
    "math_functions",
    "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(-value) AS BIGINT) AS f, CAST(sign(value - 50) AS INT) AS s, round(sqrt(value), 8) AS sq, round(cbrt(value), 8) AS cb, round(exp(value / 100), 8) AS e, round(ln(value + 1), 8) AS l, round(power(value, 1.5), 6) AS p, CAST(event_id % 7 AS BIGINT) AS m, round(pi(), 10) AS pi, round(radians(value), 8) AS r, round(degrees(value), 6) AS dg FROM events",
    "SELECT event_id, abs(value - 50) AS a, CAST(ceil(value) AS BIGINT) AS c, CAST(floor(-value) AS BIGINT) AS f, CAST(sign(value - 50) AS INT) AS s, round(sqrt(value), 8) AS sq, round(cbrt(value), 8) AS cb, round(exp(value / 100), 8) AS e, round(ln(value + 1), 8) AS l, round(power(value, 1.5), 6) AS p, CAST(event_id % 7 AS BIGINT) AS m, round(pi(), 10) AS pi, round(radians(value), 8) AS r, round(degrees(value), 6) AS dg FROM events",
)
sql_query("trigonometry", "SELECT event_id, round(sin(value), 8) AS s, round(cos(value), 8) AS c, round(atan2(value, 2.0), 8) AS a, round(asin(value / 1000), 8) AS asn, round(acos(value / 1000), 8) AS acs, round(atan(value), 8) AS atn FROM events")
sql_query("greatest_least", "SELECT event_id, greatest(value, 50.0, user_id) AS g, least(value, 50.0, user_id) AS l FROM events")
sql_query("width_bucket", "SELECT event_id, width_bucket(value, 0, 100, 5) AS b FROM events", "SELECT event_id, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 6 ELSE floor(value / 20) + 1 END AS BIGINT) AS b FROM events")
sql_query(
    "string_functions",
    "SELECT p_partkey, ascii(p_name) AS a, char_length(p_name) AS len, bit_length(p_name) AS bits, octet_length(p_name) AS bytes, lower(p_brand) AS lo, upper(p_name) AS up, substring(p_name, 2, 3) AS sub, replace(p_name, 'e', '3') AS rep, repeat('ab', 3) AS rpt, reverse(p_name) AS rev, trim('  x ') AS t, ltrim('  x ') AS lt, rtrim('  x ') AS rt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, left(p_name, 2) AS lf, right(p_name, 2) AS rg, split_part(p_name, ' ', 2) AS sp, CAST(instr(p_name, 'e') AS BIGINT) AS pos, translate(p_name, 'aeiou', 'AEIOU') AS tr, chr(65) AS ch FROM part",
    "SELECT p_partkey, ascii(p_name) AS a, length(p_name) AS len, bit_length(p_name) AS bits, octet_length(encode(p_name)) AS bytes, lower(p_brand) AS lo, upper(p_name) AS up, substring(p_name, 2, 3) AS sub, replace(p_name, 'e', '3') AS rep, repeat('ab', 3) AS rpt, reverse(p_name) AS rev, trim('  x ') AS t, ltrim('  x ') AS lt, rtrim('  x ') AS rt, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, left(p_name, 2) AS lf, right(p_name, 2) AS rg, split_part(p_name, ' ', 2) AS sp, instr(p_name, 'e') AS pos, translate(p_name, 'aeiou', 'AEIOU') AS tr, chr(65) AS ch FROM part",
)
sql_query("initcap", "SELECT p_partkey, initcap(p_name) AS i FROM part", "SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS i FROM part")
sql_query("digests", "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s FROM part", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
sql_query("encode_decode", "SELECT p_partkey, lower(hex(p_name)) AS h, base64(encode(p_name, 'UTF-8')) AS b, decode(unhex(hex(p_name)), 'UTF-8') AS back FROM part", "SELECT p_partkey, lower(hex(p_name)) AS h, to_base64(encode(p_name)) AS b, p_name AS back FROM part")
sql_query(
    "extract_parts",
    "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS DOUBLE) AS y, CAST(extract(QUARTER FROM o_orderdate) AS DOUBLE) AS q, CAST(extract(MONTH FROM o_orderdate) AS DOUBLE) AS m, CAST(extract(WEEK FROM o_orderdate) AS DOUBLE) AS w, CAST(extract(DAY FROM o_orderdate) AS DOUBLE) AS d, CAST(extract(DOY FROM o_orderdate) AS DOUBLE) AS doy, CAST(dayofweek(o_orderdate) - 1 AS DOUBLE) AS dow FROM orders",
    "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS DOUBLE) AS y, CAST(extract(QUARTER FROM o_orderdate) AS DOUBLE) AS q, CAST(extract(MONTH FROM o_orderdate) AS DOUBLE) AS m, CAST(extract(WEEK FROM o_orderdate) AS DOUBLE) AS w, CAST(extract(DAY FROM o_orderdate) AS DOUBLE) AS d, CAST(extract(DOY FROM o_orderdate) AS DOUBLE) AS doy, CAST(extract(DOW FROM o_orderdate) AS DOUBLE) AS dow FROM orders",
)
sql_query("interval_arithmetic", "SELECT event_id, ts + INTERVAL '90' MINUTE AS a, ts - INTERVAL '2' DAY AS b, o.d AS days FROM (SELECT event_id, ts FROM events) JOIN (SELECT o_orderkey AS k, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders) o ON event_id = k", "SELECT event_id, ts + INTERVAL '90' MINUTE AS a, ts - INTERVAL '2' DAY AS b, o.d AS days FROM (SELECT event_id, ts FROM events) JOIN (SELECT o_orderkey AS k, CAST(DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS d FROM orders) o ON event_id = k")
sql_query("epoch_conversions", "SELECT event_id, timestamp_seconds(1700000000 + event_id) AS t, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events", "SELECT event_id, make_timestamp((1700000000 + event_id) * 1000000) AS t, epoch_us(ts) AS us FROM events")
sql_query("at_time_zone", "SELECT event_id, convert_timezone('UTC', 'Asia/Shanghai', ts) AS local FROM events", "SELECT event_id, ts + INTERVAL '8 hours' AS local FROM events")
sql_query("array_functions", "SELECT n_nationkey, cardinality(array(n_nationkey, n_regionkey, 7)) AS n, array_contains(array(1, 2, 3), n_regionkey) AS has, element_at(array(10, 20, 30, 40, 50), n_regionkey + 1) AS item, try_element_at(array(1, 2), n_regionkey + 1) AS maybe, array_append(array(1), n_regionkey) AS app, concat(array(1, 2), array(n_regionkey)) AS cat, array_join(array('a', n_name), '-') AS j, array_remove(array(1, 2, 1), 1) AS rem FROM nation", "SELECT n_nationkey, len([n_nationkey, n_regionkey, 7]) AS n, list_contains([1, 2, 3], n_regionkey) AS has, [10, 20, 30, 40, 50][n_regionkey + 1] AS item, [1, 2][n_regionkey + 1] AS maybe, list_append([1], n_regionkey) AS app, [1, 2] || [n_regionkey] AS cat, 'a-' || n_name AS j, [2] AS rem FROM nation")
sql_query("unnest_subscripts", "SELECT n_nationkey, pos + 1 AS i, x FROM nation LATERAL VIEW posexplode(array(n_regionkey, n_nationkey)) e AS pos, x", "SELECT n_nationkey, i, [n_regionkey, n_nationkey][i] AS x FROM nation, (VALUES (1), (2)) AS t(i)")
sql_query("string_to_array", "SELECT p_partkey, split(p_name, ' ') AS words FROM part", "SELECT p_partkey, string_split(p_name, ' ') AS words FROM part")
sql_query("json_path", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, CAST(variant_get(parse_json(props), '$.k', 'int') AS BIGINT) AS v, get_json_object(props, '$.none') IS NULL AS missing FROM events", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v, json_extract(props, '$.none') IS NULL AS missing FROM events")
sql_query("json_build", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'name', n_name)) AS j FROM nation", "SELECT n_nationkey, CAST(json_object('k', n_nationkey, 'name', n_name) AS VARCHAR) AS j FROM nation")
sql_query("json_array_elements", "SELECT n_nationkey, CAST(x AS BIGINT) AS x FROM (SELECT n_nationkey, explode(from_json(concat('[', n_nationkey, ',', n_regionkey, ']'), 'array<bigint>')) AS x FROM nation)", "SELECT n_nationkey, CAST(unnest([n_nationkey, n_regionkey]) AS BIGINT) AS x FROM nation")
sql_query("array_overlap_contains", "SELECT n_nationkey, arrays_overlap(array(n_regionkey, 9), array(1, 2)) AS o, size(array_except(array(n_regionkey), array(1, 2, 3))) = 0 AS c FROM nation", "SELECT n_nationkey, list_has_any([n_regionkey, 9], [1, 2]) AS o, list_has_all([1, 2, 3], [n_regionkey]) AS c FROM nation")
sql_query("uuid_shape", "SELECT count(*) AS n FROM nation WHERE uuid() RLIKE '^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$'", "SELECT count(*) AS n FROM nation")
sql_query("scalar_sql_udf_shape", "SELECT n_nationkey, aggregate(sequence(1, n_regionkey + 1), 1L, (a, x) -> a * x) AS f FROM nation", "SELECT n_nationkey, CAST(factorial(n_regionkey + 1) AS BIGINT) AS f FROM nation")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_orderkey / l_linenumber, 6) AS DOUBLE) AS d, CAST(trunc(-l_quantity / l_linenumber) AS BIGINT) AS t FROM lineitem")
def dialect_division(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.true_div(F.col("l_orderkey"), F.col("l_linenumber")), 6).cast("double").alias("d"), S.trunc_div(-F.col("l_quantity"), F.col("l_linenumber")).alias("t"))


@query("SELECT event_id, round(log10(value + 1), 8) AS a, round(ln(value + 1) / ln(3), 8) AS b, trunc(50 - value) AS tr, round(cot(value), 6) AS c FROM events")
def dialect_math(t):
    v = F.col("value")
    return t.events.select("event_id", S.round_scaled(S.log(v + 1), 8).alias("a"), S.round_scaled(S.log(v + 1, 3), 8).alias("b"), S.trunc(50 - v).alias("tr"), S.round_scaled(F.cot(v), 6).alias("c"))


@query("SELECT n_nationkey, n_name || '!' AS c, regexp_replace(n_name, '[A-Z]', '*') AS r, '''' || replace(n_name, 'A', '''') || '''' AS raw, '''' || replace(replace(n_name, 'A', ''''), '''', '''''') || '''' AS q FROM nation")
def dialect_strings(t):
    odd = F.replace("n_name", F.lit("A"), F.lit("'"))
    return t.nation.select("n_nationkey", S.concat(F.col("n_name"), F.lit(None).cast("string"), F.lit("!")).alias("c"), S.regexp_replace_first(F.col("n_name"), "[A-Z]", "*").alias("r"), F.concat(F.lit("'"), odd, F.lit("'")).alias("raw"), S.quote_literal(odd).alias("q"))


@query("SELECT n_nationkey, list_aggregate(list_transform(string_split(CAST(n_nationkey AS VARCHAR), ''), lambda d: ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][CAST(d AS INT) + 1]), 'string_agg', '-') AS words FROM nation")
def to_english(t):
    return t.nation.select("n_nationkey", S.to_english(F.col("n_nationkey")).alias("words"))


@query("SELECT o_orderkey, date_trunc('decade', o_orderdate) AS dec, date_trunc('month', o_orderdate) AS mon, date_trunc('week', o_orderdate) AS wk, strftime(o_orderdate, '%Y/%m/%d %H') AS s, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS p FROM orders")
def dialect_dates(t):
    d = F.col("o_orderdate")
    ntz = lambda c: c.cast("timestamp_ntz")
    return t.orders.select("o_orderkey", S.date_trunc("decade", d).alias("dec"), ntz(S.date_trunc("month", d)).alias("mon"), ntz(S.date_trunc("week", d)).alias("wk"), S.strftime(d, "%Y/%m/%d %H").alias("s"), S.strptime(S.strftime(d, "%d.%m.%Y"), "%d.%m.%Y").alias("p"))


@query("SELECT event_id, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts) AS INT) AS s FROM events")
def time_to_sec(t):
    return t.events.select("event_id", S.time_to_sec(F.col("ts")).alias("s"))


@query("SELECT n_nationkey, nullif(coalesce(list_position([4, 3, 2], n_regionkey), 0), 0) AS p, nullif(len(range(n_regionkey)), 0) AS u FROM nation")
def dialect_arrays(t):
    r = F.col("n_regionkey")
    return t.nation.select("n_nationkey", S.array_position(F.array(F.lit(4), F.lit(3), F.lit(2)), r).alias("p"), S.array_upper(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: x < r)).cast("long").alias("u"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'object' WHEN event_id % 3 = 1 THEN 'array' ELSE 'number' END AS kind FROM events")
def json_typeof(t):
    j = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "[1]").otherwise("2.5")
    return t.events.select("event_id", S.json_typeof(j).alias("kind"))


@query()
def non_cryptographic_hashes(t):
    """FNV, CRC-32C: not in SQL; checked against known values in the tests."""
    n = F.col("n_name")
    return t.nation.select("n_nationkey", S.fnv32(n).alias("fnv32"), S.fnv32a(n).alias("fnv32a"), S.fnv64(n).alias("fnv64"), S.fnv64a(n).alias("fnv64a"), S.crc32c(n).alias("crc32c"), F.crc32(n.cast("binary")).alias("crc32ieee"))


@query("SELECT c_custkey, c_custkey % 256 < 128 AS inside FROM customer")
def inet_contained(t):
    k = F.col("c_custkey")
    ip = F.concat(F.lit("10.0.0."), (k % 256).cast("string"))
    return t.customer.select("c_custkey", S.inet_contained(ip, F.lit("10.0.0.0/25")).alias("inside"))


@query("SELECT s_suppkey, CAST((s_nationkey + 1) * 2 AS DOUBLE) AS area, s_nationkey >= 5 AS inside, round(CAST(greatest(0, 5 - (s_nationkey + 1)) AS DOUBLE), 6) AS dist FROM supplier")
def geometry(t):
    """A rectangle of the nation's width against a point."""
    w = (F.col("s_nationkey") + 1).cast("string")
    box = F.concat(F.lit("POLYGON((0 0, "), w, F.lit(" 0, "), w, F.lit(" 2, 0 2, 0 0))"))
    point = F.lit("POINT(5 1)")
    return t.supplier.select("s_suppkey", G.st_area(box).alias("area"), G.st_contains(box, point).alias("inside"), F.round(G.st_distance(box, point), 6).alias("dist"))
