"""Continuous queries run to the end of their input; their rows equal those of batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources.storage import scratch
from quillon.streaming import streams as S


def _run(t, name, transform, where=None, output_mode="append"):
    """All of events through a stream into a new table; one far row at the end moves the watermark past all windows."""
    source = scratch(t.spark)
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    rows.write.parquet(source)
    stream = S.Stream(f"{name}_{source[-8:]}", source, scratch(t.spark), rows.schema, transform, scratch(t.spark), where, output_mode=output_mode)
    stream.start(t.spark, available_now=True).awaitTermination()
    last = rows.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    last.write.mode("append").parquet(source)
    stream.start(t.spark, available_now=True).awaitTermination()
    out = t.spark.read.parquet(stream.target)
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in out.dtypes])


@query("SELECT event_id, ts, value FROM events WHERE value > 40 AND event_type = 'click'")
def stream_filter(t):
    return _run(t, "filter", lambda r: r.select("event_id", "ts", "value"), "value > 40 and event_type = 'click'")


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS window_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS window_end, count(*) AS n, max(value) AS hi FROM events GROUP BY ALL")
def stream_tumbling(t):
    return _run(t, "tumbling", lambda r: S.windowed(r, "ts", "30 days", "6 hours", None, ["event_type"], F.count("*").alias("n"), F.max("value").alias("hi")))


@query("WITH w AS (SELECT *, unnest([0, 1]) AS back FROM events) SELECT time_bucket(INTERVAL '6 hours', ts) - back * INTERVAL '6 hours' AS window_start, time_bucket(INTERVAL '6 hours', ts) - back * INTERVAL '6 hours' + INTERVAL '12 hours' AS window_end, count(*) AS n FROM w GROUP BY ALL")
def stream_sliding(t):
    return _run(t, "sliding", lambda r: S.windowed(r, "ts", "30 days", "12 hours", "6 hours", [], F.count("*").alias("n")))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '6 hours' THEN 1 ELSE 0 END AS cut FROM events),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, count(*) AS n FROM r GROUP BY user_id, k""")
def stream_session(t):
    return _run(t, "session", lambda r: S.sessions(r, "ts", "30 days", "6 hours", ["user_id"], F.count("*").alias("n")))


_R = "row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1"


@query(f"SELECT user_id, CAST(i // 8 + 1 AS BIGINT) AS group_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, {_R} AS i FROM events) GROUP BY ALL HAVING count(*) = 8")
def stream_count_window(t):
    return _run(t, "count", lambda r: S.row_groups(r, "user_id", "ts", "count", count=8))


@query("""WITH p AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS cut FROM events),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM p), s AS (SELECT user_id, CAST(k AS BIGINT) AS group_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY ALL)
    SELECT * FROM s QUALIFY group_id < max(group_id) OVER (PARTITION BY user_id)""")
def stream_state_window(t):
    return _run(t, "state", lambda r: S.row_groups(r, "user_id", "ts", "state", state="event_type"))


@query("""WITH f AS (SELECT *, coalesce(sum(CAST(value < 5 AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events),
    m AS (SELECT *, max(value > 30) OVER (PARTITION BY user_id, seg ORDER BY ts) AS opened, max(value < 5) OVER (PARTITION BY user_id, seg) AS closed FROM f)
    SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY seg) AS group_id, n, first_ts, last_ts FROM (SELECT user_id, seg, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM m WHERE opened AND closed GROUP BY ALL)""")
def stream_event_window(t):
    return _run(t, "event", lambda r: S.row_groups(r.withColumn("s", F.col("value") > 30).withColumn("e", F.col("value") < 5), "user_id", "ts", "event", start="s", end="e"))
