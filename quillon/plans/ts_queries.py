"""Time-series queries over events: a user is an entity, ts its time, value its metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import buckets as B
from quillon.operators import first_last as L
from quillon.operators import group_windows as G
from quillon.plans.registry import query

# ------------------------------------------------------------------ scans


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' AND user_id = 8")
def ts_scan_span(t):
    return t.series().span("2024-01-05", "2024-01-07").where("user_id = 8").df.select("event_id", "ts", "value")


@query("SELECT event_id FROM events WHERE value BETWEEN 10 AND 12 AND props IS NOT NULL AND event_type IS NOT NULL")
def ts_block_filter(t):
    return t.events.where("value between 10 and 12 and props is not null and event_type is not null").select("event_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def tag_scan(t):
    return t.series().tag_table()


@query("SELECT c_mktsegment, count(*) AS n, round(avg(value), 8) AS mean FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey < 10 GROUP BY c_mktsegment")
def hash_tag_scan_join(t):
    dim = t.customer.where("c_nationkey < 10").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return t.series().join_tags(dim, ["user_id"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))


@query("SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, round(sum(value), 2) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def statistic_scan(t):
    return t.events.agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def aggregating_scan(t):
    return t.events.groupBy("event_type", B.time_bucket("ts", "1h").alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 8).alias("mean"))


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC LIMIT 50 OFFSET 10")
def sorted_scan_offset(t):
    return t.events.select("event_id", "ts", "value").orderBy(F.desc("ts")).offset(10).limit(50)


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def lastpoint(t):
    row = F.max(F.struct("ts", "event_id", "value")).alias("r")
    return t.events.groupBy("user_id").agg(row).select("user_id", "r.event_id", "r.ts", "r.value")


# ------------------------------------------------------------------ first and last
_X = "CASE WHEN value > 20 THEN value END"


def _sparse(t):
    """Half the metric is null, so that null handling shows."""
    return t.events.withColumn("x", F.when(F.col("value") > 20, F.col("value")))


@query(f"""SELECT user_id, arg_min(x, ts) FILTER (WHERE x IS NOT NULL) AS first, min(ts) FILTER (WHERE x IS NOT NULL) AS firstts,
    first(x ORDER BY ts) AS first_row, min(ts) AS first_row_ts FROM (SELECT *, {_X} AS x FROM events) GROUP BY user_id""")
def first_family(t):
    return _sparse(t).groupBy("user_id").agg(L.first("x", "ts").alias("first"), L.first_ts("x", "ts").alias("firstts"), L.first_row("x", "ts").alias("first_row"), L.first_row_ts("ts").alias("first_row_ts"))


@query(f"""SELECT user_id, arg_max(x, ts) FILTER (WHERE x IS NOT NULL) AS last, max(ts) FILTER (WHERE x IS NOT NULL) AS lastts,
    first(x ORDER BY ts DESC) AS last_row, max(ts) AS last_row_ts FROM (SELECT *, {_X} AS x FROM events) GROUP BY user_id""")
def last_family(t):
    return _sparse(t).groupBy("user_id").agg(L.last("x", "ts").alias("last"), L.last_ts("x", "ts").alias("lastts"), L.last_row("x", "ts").alias("last_row"), L.last_row_ts("ts").alias("last_row_ts"))


@query(f"SELECT user_id, arg_max(x, ts) FILTER (WHERE x IS NOT NULL AND ts <= TIMESTAMP '2024-01-10') AS last, max(ts) FILTER (WHERE x IS NOT NULL AND ts <= TIMESTAMP '2024-01-10') AS lastts FROM (SELECT *, {_X} AS x FROM events) GROUP BY user_id")
def last_with_bound(t):
    bound = F.lit("2024-01-10").cast("timestamp_ntz")
    return _sparse(t).groupBy("user_id").agg(L.last("x", "ts", bound).alias("last"), L.last_ts("x", "ts", bound).alias("lastts"))


@query("""SELECT user_id, arg_max(event_id, ts) AS "last(event_id)", max(ts) AS "last(ts)", arg_max(event_type, ts) AS "last(event_type)", arg_max(value, ts) AS "last(value)" FROM events GROUP BY user_id""")
def last_star(t):
    return t.events.drop("props").groupBy("user_id").agg(*L.expand_star(L.last, t.events.drop("props"), "ts", ["user_id"]))


# ------------------------------------------------------------------ buckets
for _width, _seconds in (("10s", 10), ("5m", 300), ("1h", 3600), ("1d", 86400), ("86400s", 86400)):

    def _bucket(t, width=_width):
        return t.events.groupBy("user_id", B.time_bucket("ts", width).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))

    _bucket.__name__ = f"time_bucket_{_width}"
    query(f"SELECT user_id, make_timestamp(CAST(floor(epoch_us(ts) / {_seconds}000000.0) AS BIGINT) * {_seconds}000000) AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")(_bucket)


@query("SELECT make_timestamp(CAST(1900 + ((year(o_orderdate) - 1900) * 12 + month(o_orderdate) - 1) // 5 * 5 // 12 AS BIGINT), CAST(((year(o_orderdate) - 1900) * 12 + month(o_orderdate) - 1) // 5 * 5 % 12 + 1 AS BIGINT), 1, 0, 0, 0.0) AS bucket, count(*) AS n FROM orders GROUP BY ALL")
def time_bucket_months(t):
    return t.orders.groupBy(B.time_bucket("o_orderdate", "5mon").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT make_timestamp(CAST(1900 + (year(o_orderdate) - 1900) // 3 * 3 AS BIGINT), 1, 1, 0, 0, 0.0) AS bucket, count(*) AS n FROM orders GROUP BY ALL")
def time_bucket_years(t):
    return t.orders.groupBy(B.time_bucket("o_orderdate", "3y").alias("bucket")).agg(F.count("*").alias("n"))


_HOURS = "SELECT user_id, date_trunc('day', ts) AS bucket, round(avg(value), 8) AS mean, count(*) AS n FROM events GROUP BY ALL"
_GAPS = f"WITH h AS ({_HOURS}), g AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL '1 day')) AS bucket FROM h GROUP BY user_id) SELECT user_id, bucket, mean, n FROM g LEFT JOIN h USING (user_id, bucket)"


def _gaps(t):
    h = t.events.groupBy("user_id", B.time_bucket("ts", "1d").alias("bucket")).agg(F.round(F.avg("value"), 8).alias("mean"), F.count("*").alias("n"))
    return B.gap_fill(h, "bucket", "1d", ["user_id"])


@query(_GAPS)
def time_bucket_gapfill(t):
    return _gaps(t)


_FILLS = {
    "null": "mean",
    "prev": "last_value(mean IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "next": "first_value(mean IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "constant": "coalesce(mean, 7.5)",
    "linear": """CASE WHEN mean IS NOT NULL THEN mean ELSE
        last_value(mean IGNORE NULLS) OVER b + (first_value(mean IGNORE NULLS) OVER a - last_value(mean IGNORE NULLS) OVER b)
        * (epoch_us(bucket) - epoch_us(last_value(CASE WHEN mean IS NOT NULL THEN bucket END IGNORE NULLS) OVER b))
        / (epoch_us(first_value(CASE WHEN mean IS NOT NULL THEN bucket END IGNORE NULLS) OVER a) - epoch_us(last_value(CASE WHEN mean IS NOT NULL THEN bucket END IGNORE NULLS) OVER b)) END""",
}
for _mode, _sql in _FILLS.items():

    def _interpolated(t, mode=_mode):
        gaps = _gaps(t)
        return gaps.select("user_id", "bucket", F.round(B.interpolate(gaps, "mean", mode, "bucket", ["user_id"], 7.5), 6).alias("x"))

    _interpolated.__name__ = f"interpolate_{_mode}"
    query(f"WITH f AS ({_GAPS}) SELECT user_id, bucket, round({_sql}, 6) AS x FROM f WINDOW b AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")(_interpolated)

# ------------------------------------------------------------------ point fill: each entity at noon of each of its days
_POINTS = "SELECT DISTINCT user_id, date_trunc('day', ts) + INTERVAL '12 hours' AS ts FROM events"
_NEAR = f"""WITH p AS ({_POINTS}), n AS (SELECT p.user_id, p.ts,
    arg_max(e.value, e.ts) FILTER (WHERE e.ts <= p.ts) AS px, max(e.ts) FILTER (WHERE e.ts <= p.ts) AS pt,
    arg_min(e.value, e.ts) FILTER (WHERE e.ts >= p.ts) AS nx, min(e.ts) FILTER (WHERE e.ts >= p.ts) AS nt
    FROM p JOIN events e ON e.user_id = p.user_id AND e.ts BETWEEN p.ts - INTERVAL '6 hours' AND p.ts + INTERVAL '6 hours' GROUP BY ALL)
    SELECT p.user_id, p.ts, {{x}} AS value FROM p LEFT JOIN n USING (user_id, ts)"""
_MODES = {
    "exact": "CASE WHEN pt = p.ts THEN px END",
    "previous": "px",
    "next": "nx",
    "closer": "CASE WHEN px IS NULL THEN nx WHEN nx IS NULL THEN px WHEN p.ts - pt <= nt - p.ts THEN px ELSE nx END",
    "linear": "round(CASE WHEN pt = p.ts THEN px ELSE px + (nx - px) * (epoch_us(p.ts) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt)) END, 6)",
    "constant": "CASE WHEN pt = p.ts THEN px ELSE -1.0 END",
}
for _mode, _sql in _MODES.items():

    def _filled(t, mode=_mode):
        points = t.events.select("user_id", (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("ts")).distinct()
        six = 6 * 3600 * 1000
        out = B.point_fill(points, t.events, ["user_id"], "ts", "value", mode, six, six, -1.0)
        return out.withColumn("value", F.round("value", 6)) if mode == "linear" else out

    _filled.__name__ = f"fill_{_mode}"
    query(_NEAR.format(x=_sql))(_filled)

# ------------------------------------------------------------------ row-group windows
_GROUPS = ["user_id", "group_id"]


def _summary(df, keys=("user_id", "group_id")):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 2).alias("total"))


_SUM = "count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 2) AS total"


@query(f"""WITH s AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS state FROM events),
    p AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s),
    g AS (SELECT *, sum(CASE WHEN state IS NOT NULL AND (prev IS NULL OR state <> prev) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM p)
    SELECT user_id, CAST(nullif(run, 0) AS BIGINT) AS group_id, {_SUM} FROM g GROUP BY ALL""")
def state_window(t):
    """The state is null for errors, so nulls inside and before states show."""
    return _summary(G.state_window(t.series(), F.when(F.col("event_type") != "error", F.col("event_type"))))


@query(f"""WITH f AS (SELECT *, value > 30 AS s, value < 5 AS e FROM events),
    g AS (SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM f),
    m AS (SELECT *, max(s) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS opened, max(e) OVER (PARTITION BY user_id, seg) AS closed FROM g)
    SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY seg) AS group_id, n, first_ts, last_ts, total FROM (SELECT user_id, seg, {_SUM} FROM m WHERE opened AND closed GROUP BY ALL)""")
def event_window(t):
    return _summary(G.event_window(t.series(), F.col("value") > 30, F.col("value") < 5))


@query(f"""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '6 hours' AS cut FROM events),
    r AS (SELECT *, CAST(1 + sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS group_id FROM g)
    SELECT user_id, group_id, {_SUM} FROM r GROUP BY ALL""")
def session_window(t):
    return _summary(G.session_window(t.series(), "6h"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT user_id, CAST(i // 10 AS BIGINT) AS group_id, {_SUM} FROM r GROUP BY ALL")
def count_window(t):
    return _summary(G.count_window(t.series(), 10))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) SELECT user_id, CAST(k AS BIGINT) AS group_id, {_SUM} FROM r, generate_series(0, 200000) AS g(k) WHERE k * 4 <= i AND i < k * 4 + 10 AND k <= 200000 GROUP BY ALL")
def count_window_sliding(t):
    return _summary(G.count_window(t.series(), 10, 4))


@query(f"SELECT user_id, time_bucket(INTERVAL '12 hours', ts) AS window_start, time_bucket(INTERVAL '12 hours', ts) + INTERVAL '12 hours' AS window_end, {_SUM} FROM events GROUP BY ALL")
def time_window_tumbling(t):
    return _summary(G.time_window(t.series(), "12h"), ["user_id", "window_start", "window_end"])


@query(f"WITH w AS (SELECT *, unnest([0, 1]) AS back FROM events), v AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) - back * INTERVAL '6 hours' AS window_start FROM w) SELECT user_id, window_start, window_start + INTERVAL '12 hours' AS window_end, {_SUM} FROM v GROUP BY ALL")
def time_window_sliding(t):
    return _summary(G.time_window(t.series(), "12h", "6h"), ["user_id", "window_start", "window_end"])


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d FROM events")
def diff(t):
    return t.events.select("event_id", F.round(G.diff(t.series(), "value"), 6).alias("d"))


# ------------------------------------------------------------------ device-metrics shapes
@query("SELECT date_trunc('minute', ts) AS minute, max(value) AS hi FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04' GROUP BY ALL")
def single_groupby(t):
    return t.series().span("2024-01-03", "2024-01-04").where("user_id = 8").df.groupBy(B.time_bucket("ts", "1m").alias("minute")).agg(F.max("value").alias("hi"))


@query("SELECT date_trunc('hour', ts) AS hour, max(value) AS hi FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13, 21, 34) GROUP BY ALL")
def cpu_max_all(t):
    return t.events.where(F.col("user_id").isin(1, 2, 3, 5, 8, 13, 21, 34)).groupBy(B.time_bucket("ts", "1h").alias("hour")).agg(F.max("value").alias("hi"))


@query("SELECT date_trunc('hour', ts) AS hour, user_id, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def double_groupby(t):
    return t.events.groupBy(B.time_bucket("ts", "1h").alias("hour"), "user_id").agg(F.round(F.avg("value"), 8).alias("mean"))


@query("SELECT event_id, user_id, ts, value FROM events WHERE value > 90 AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'")
def high_cpu(t):
    return t.series().span("2024-01-02", "2024-01-20").where("value > 90").df.select("event_id", "user_id", "ts", "value")


@query("SELECT date_trunc('minute', ts) AS minute, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL ORDER BY minute DESC LIMIT 5")
def groupby_orderby_limit(t):
    return t.series().span(end="2024-01-15").df.groupBy(B.time_bucket("ts", "1m").alias("minute")).agg(F.max("value").alias("hi")).orderBy(F.desc("minute")).limit(5)


@query("""SELECT n_name, time_bucket(INTERVAL '1 day', ts) AS bucket, count(*) AS n, round(avg(value), 8) AS mean, min(value) AS lo, max(value) AS hi
    FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 3""")
def multi_model_bucket_join(t):
    """Entities join relational dimensions on tags, then buckets are aggregated; the few groups combine before the shuffle."""
    dim = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), "n_name")
    joined = t.series().join_tags(dim, ["user_id"])
    return joined.groupBy("n_name", B.time_bucket("ts", "1d").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("n > 3")


@query("""SELECT a.bucket, a.user_id, a.n AS clicks, b.n AS views FROM
    (SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL) a
    JOIN (SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL) b USING (bucket, user_id)""")
def bucket_equality_join(t):
    def side(kind, name):
        return t.events.where(F.col("event_type") == kind).groupBy(B.time_bucket("ts", "1d").alias("bucket"), "user_id").agg(F.count("*").alias(name))

    return side("click", "clicks").join(side("view", "views"), ["bucket", "user_id"])


# ------------------------------------------------------------------ ingest rules
def _twice(t):
    """Each event, and a later version of every third one with the same entity and time."""
    again = t.events.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("value", F.col("value") + 1)
    return type(t.series())(t.events.unionByName(again), "ts", ["user_id"], ["value"])


_TWICE = "(SELECT * FROM events UNION ALL SELECT event_id + 1000000, ts, user_id, event_type, value + 1, props FROM events WHERE event_id % 3 = 0)"


@query(f"SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM {_TWICE}) WHERE n = 1")
def dedup_override(t):
    return _twice(t).deduplicate("override", "event_id").df.select("event_id", "user_id", "value")


@query(f"SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS n FROM {_TWICE}) WHERE n = 1")
def dedup_discard(t):
    return _twice(t).deduplicate("discard", "event_id").df.select("event_id", "user_id", "value")


@query(f"SELECT count(*) AS n, round(sum(value), 2) AS total FROM {_TWICE}")
def dedup_keep(t):
    return _twice(t).deduplicate("keep", "event_id").df.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '7 days'")
def retention(t):
    return t.series().retain(F.lit("2024-01-31").cast("timestamp_ntz"), "7 days").df.select("event_id")


@query("SELECT event_id FROM events WHERE NOT (user_id = 8 AND ts < TIMESTAMP '2024-01-15')")
def delete_by_tag_and_span(t):
    return t.series().delete((F.col("user_id") == 8) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))).df.select("event_id")


@query("SELECT event_id, CASE WHEN user_id = 8 THEN 'vip' ELSE event_type END AS event_type FROM events")
def tag_update(t):
    return t.events.select("event_id", F.when(F.col("user_id") == 8, "vip").otherwise(F.col("event_type")).alias("event_type"))
