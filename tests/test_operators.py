"""Operators on small inputs: known values, state machines, errors."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import geometry as G
from quillon.functions import scalar as S
from quillon.operators import buckets as B
from quillon.operators import first_last as L
from quillon.operators import group_windows as W
from quillon.operators import relational as R
from quillon.sources.ts_table import TimeSeriesTable
from quillon.streaming.streams import Stream, Streams


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    rows = [(e, at(i * 10 + rng.randint(0, 9)), rng.choice([None, 1, 2, 3]), rng.random() < 0.3, rng.random() < 0.3) for e in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "e int, ts timestamp_ntz, v int, s boolean, t boolean")
    return rows, TimeSeriesTable(df, "ts", ["e"], ["v"])


def by_entity(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_event_window_is_the_state_machine(series):
    rows, t = series
    want = set()
    for e, rs in by_entity(rows).items():
        group, held = 0, []
        for r in rs:
            if held or r[3]:
                held.append(r)
                if r[4]:
                    group += 1
                    want |= {(e, x[1], group) for x in held}
                    held = []
    got = {(r.e, r.ts, r.group_id) for r in W.event_window(t, F.col("s"), F.col("t")).collect()}
    assert got == want


def test_state_window_nulls(series):
    rows, t = series
    want = set()
    for e, rs in by_entity(rows).items():
        group, now = None, None
        for r in rs:
            if r[2] is not None and r[2] != now:
                group, now = (group or 0) + 1, r[2]
            want.add((e, r[1], group))
    assert {(r.e, r.ts, r.group_id) for r in W.state_window(t, "v").collect()} == want


def test_count_window_of_one_and_sliding(series):
    rows, t = series
    assert W.count_window(t, 1).groupBy("e", "group_id").count().where("count <> 1").count() == 0
    want = set()
    for e, rs in by_entity(rows).items():
        for k in range(0, len(rs), 3):
            want |= {(e, r[1], k // 3) for r in rs[k : k + 7]}
    assert {(r.e, r.ts, r.group_id) for r in W.count_window(t, 7, 3).collect()} == want
    with pytest.raises(ValueError):
        W.count_window(t, 3, 4)


def test_session_boundary_is_strict(spark):
    t = TimeSeriesTable(spark.createDataFrame([(1, at(0)), (1, at(60)), (1, at(121))], "e int, ts timestamp_ntz"), "ts", ["e"], [])
    assert [r.group_id for r in W.session_window(t, "60s").orderBy("ts").collect()] == [1, 1, 2]


def test_first_last_of_nulls(spark):
    df = spark.createDataFrame([(1, at(0), None), (1, at(1), 5), (1, at(2), 6), (1, at(3), None), (2, at(0), None)], "e int, ts timestamp_ntz, x int")
    bound = F.lit("2024-01-01 00:00:01").cast("timestamp_ntz")
    r = df.groupBy("e").agg(L.first("x", "ts").alias("a"), L.first_row("x", "ts").alias("b"), L.last("x", "ts").alias("c"), L.last_row("x", "ts").alias("d"), L.last("x", "ts", bound).alias("f"), L.last_ts("x", "ts").alias("g")).orderBy("e").collect()
    assert tuple(r[0])[1:] == (5, None, 6, None, 5, at(2)) and tuple(r[1])[1:] == (None,) * 6


def test_buckets_before_the_epoch_and_months(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 55),), (dt.datetime(2024, 5, 17),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(B.time_bucket("ts", "10s")).collect()] == [dt.datetime(1969, 12, 31, 23, 59, 50), dt.datetime(2024, 5, 17)]
    assert [r[0] for r in df.select(B.time_bucket("ts", "7mon")).collect()] == [dt.datetime(1969, 6, 1), dt.datetime(2024, 4, 1)]
    with pytest.raises(ValueError):
        B.time_bucket("ts", "5 parsecs")


def test_gap_fill_and_fill(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(900), 4.0), ("b", at(300), 2.0)], "k string, b timestamp_ntz, x double")
    filled = B.gap_fill(df, "b", 300, ["k"])
    assert [(r.k, r.b, r.x) for r in filled.orderBy("k", "b").collect()] == [("a", at(0), 1.0), ("a", at(300), None), ("a", at(600), None), ("a", at(900), 4.0), ("b", at(300), 2.0)]
    linear = filled.select("k", "b", B.interpolate(filled, "x", "linear", "b", ["k"]).alias("x")).where("k = 'a'").orderBy("b").collect()
    assert [r.x for r in linear] == [1.0, 2.0, 3.0, 4.0]
    points = spark.createDataFrame([("a", at(500)), ("a", at(5000)), ("c", at(0))], "k string, b timestamp_ntz")
    near = {r.b: r.x for r in B.point_fill(points.where("k = 'a'"), df, ["k"], "b", "x", "previous", 600_000).collect()}
    assert near == {at(500): 1.0, at(5000): None}
    assert B.point_fill(points, df, ["k"], "b", "x", "closer", 600_000, 600_000).where("x is null").count() == 2


def test_hashes_known_values(spark):
    df = spark.createDataFrame([("foobar",), ("",), ("a",), (None,)], "s string")
    r = df.select(S.fnv32("s"), S.fnv32a("s"), S.fnv64("s"), S.fnv64a("s"), S.crc32c("s")).collect()
    unsigned = [[None if x is None else x % (1 << 64) for x in row] for row in r]
    assert unsigned[0][:4] == [0x31F0B262, 0xBF9CF968, 0x340D8765A4DDA9C2, 0x85944171F73967E8]
    assert unsigned[1] == [0x811C9DC5, 0x811C9DC5, 0xCBF29CE484222325, 0xCBF29CE484222325, 0]
    assert unsigned[3] == [None] * 5
    assert spark.createDataFrame([("123456789",)], "s string").select(S.crc32c("s")).first()[0] == 0xE3069283


def test_geometry():
    square, inner = G.parse("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), G.parse("POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))")
    assert G.contains(square, inner) and not G.contains(inner, square) and G.covers(square, G.parse("POINT(0 2)")) and not G.contains(square, G.parse("POINT(0 2)"))
    assert G.touches(square, G.parse("POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))")) and not G.touches(square, inner)
    assert G.distance(square, G.parse("LINESTRING(7 8, 7 9)")) == pytest.approx(5)
    assert G.intersects(G.parse("LINESTRING(0 0, 2 2)"), G.parse("LINESTRING(0 2, 2 0)"))
    with pytest.raises(ValueError):
        G.parse("CIRCLE(0 0, 1)")


def test_similar_to_patterns(spark):
    cases = [("abc", "a%", True), ("abc", "a_c", True), ("abc", "(b|a)%c", True), ("a.c", "a.c", True), ("abc", "a.c", False), ("a%", "a\\%", True), ("ab", "a\\%", False), ("x1", "x[0-9]+", True)]
    df = spark.createDataFrame([(s, i) for i, (s, _, _) in enumerate(cases)], "s string, i int")
    for i, (_, p, want) in enumerate(cases):
        assert df.where(f"i = {i}").select(F.col("s").rlike(R.similar_to(p))).first()[0] is want, p


def test_runtime_errors(spark):
    with pytest.raises(Exception, match="more than one row"):
        R.max_one_row(spark.range(3)).collect()
    assert R.max_one_row(spark.range(0)).count() == 0
    with pytest.raises(Exception, match="no rows wanted"):
        R.error_if_rows(spark.range(3), "no rows wanted").collect()
    with pytest.raises(Exception, match="square root"):
        spark.range(1).select(S.checked_sqrt(F.lit(-1.0))).collect()


def test_trunc_of_odd_doubles(spark):
    cases = [(-0.3, -0.0), (0.3, 0.0), (-0.0, -0.0), (0.0, 0.0), (-5e-324, -0.0), (-2.7, -2.0), (2.7, 2.0), (2.0**52 - 0.5, 2.0**52 - 1), (-(2.0**53), -(2.0**53)), (-1e300, -1e300), (float("inf"), float("inf")), (float("-inf"), float("-inf")), (float("nan"), float("nan")), (None, None)]
    got = [(repr(r.x), repr(r.t)) for r in spark.createDataFrame(cases, "x double, want double").select("x", S.trunc(F.col("x")).alias("t")).collect()]
    assert got == [(repr(x), repr(want)) for x, want in cases]
    d = spark.sql("SELECT CAST('0.99999999999999999999' AS DECIMAL(38, 20)) AS d, CAST('-9007199254740993.7' AS DECIMAL(20, 1)) AS e, -9223372036854775808L AS l")
    assert tuple(d.select(S.trunc(F.col("d")), S.trunc(F.col("e")), S.trunc(F.col("l"))).first()) == (0.0, -9007199254740992.0, -(2.0**63))


def test_round_of_odd_doubles(spark):
    rng = random.Random(3)
    values = [-0.0, 0.0, -4e-9, 4e-9, -2.5, 2.5, 1.005, 2.474596545, 1e300, -1e300, 1.7e308, float("inf"), float("-inf"), float("nan"), None, *(round(rng.uniform(-9, 9), 9) for _ in range(2000))]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", S.round_scaled(F.col("x"), 8).alias("r"), S.round_scaled(F.col("x"), 0).alias("z")).toArrow()
    want = duckdb.sql("SELECT x, round(x, 8) AS r, round(x, 0) AS z FROM got")
    assert [tuple(repr(v) for v in r.values()) for r in got.to_pylist()] == [tuple(repr(v) for v in r) for r in want.fetchall()]


def test_row_comparison_nulls(spark):
    df = spark.createDataFrame([(1, None, 1, 3), (1, 2, 2, None), (1, None, None, 3)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(S.row_less([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])).collect()]
    assert got == [None, True, None]


def test_stream_states(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    stream = Stream("ids", source, str(tmp_path / "out"), spark.range(1).schema, lambda r: r.where("id > 4"), str(tmp_path / "cp"))
    streams = Streams(spark)
    streams.create(stream)
    stream.query.processAllAvailable()
    assert streams.show() == [("ids", source, str(tmp_path / "out"), "running")]
    streams.alter("ids", False)
    assert streams.show()[0][3] == "stopped"
    spark.range(10, 12).write.mode("append").parquet(source)
    streams.alter("ids", True)
    stream.query.processAllAvailable()
    streams.drop("ids")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [5, 6, 7, 8, 9, 10, 11]
    assert streams.show() == []


def test_late_rows_are_dropped(spark, tmp_path):
    from quillon.streaming.streams import windowed

    source = str(tmp_path / "in")
    schema = "ts timestamp, k string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    write([(at(0), "a"), (at(7200), "a")])
    stream = Stream("late", source, str(tmp_path / "out"), spark.createDataFrame([], schema).schema, lambda r: windowed(r, "ts", "10 minutes", "1 hour", None, ["k"], F.count("*").alias("n")), str(tmp_path / "cp"))
    stream.start(spark, available_now=True).awaitTermination()
    write([(at(60), "a"), (at(20000), "a")])
    stream.start(spark, available_now=True).awaitTermination()
    write([(at(40000), "a")])
    stream.start(spark, available_now=True).awaitTermination()
    counts = {r.window_start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert counts[at(0)] == 1 and counts[at(7200)] == 1


def test_ordinality_over_many_partitions(spark):
    """Further columns and more rows than one partition takes: each row has its own number, in order."""
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("k"), F.col("id").alias("other"), F.lit("x").alias("more"))
    out = R.with_ordinality(df.repartition(9), ["k"])
    got = out.agg(F.count("*"), F.countDistinct("ordinality"), F.min("ordinality"), F.max("ordinality"), F.sum((F.col("ordinality") != F.col("k") + 1).cast("int"))).first()
    assert tuple(got) == (60_000, 60_000, 1, 60_000, 0)


def test_bucket_of_the_last_microsecond(spark):
    ts = F.lit("2999-12-31 23:59:59.999999").cast("timestamp_ntz")
    got = spark.range(1).select(B.time_bucket(ts, "1h").cast("string"), B.time_bucket(ts, "1 hour").cast("string"), B.time_bucket(ts, "2 months").cast("string")).first()
    assert tuple(got) == ("2999-12-31 23:00:00", "2999-12-31 23:00:00", "2999-11-01 00:00:00")
    assert B.width_seconds("1000000secs") == 1_000_000 and B.width_months("2years") == 24
    with pytest.raises(ValueError):
        B.width_seconds("3 fortnights")


def test_gap_fill_by_months(spark):
    rows = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ'2024-01-01' AS b, 1.0D AS x UNION ALL SELECT 1, TIMESTAMP_NTZ'2024-05-01', 5.0D")
    filled = B.gap_fill(rows, "b", "1mon", ["k"])
    got = [(str(r.b)[:10], r.x, r.n) for r in filled.withColumn("n", B.interpolate(filled, "x", "next", "b", ["k"])).orderBy("b").collect()]
    assert got == [("2024-01-01", 1.0, 1.0), ("2024-02-01", None, 5.0), ("2024-03-01", None, 5.0), ("2024-04-01", None, 5.0), ("2024-05-01", 5.0, 5.0)]
