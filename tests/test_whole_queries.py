"""Queries that once had conditions on ids, against their SQL over whole tables at sf0.01."""

import os

import duckdb
import pytest
from test_queries import ordered

from quillon.plans import catalog  # noqa: F401
from quillon.plans.registry import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

USERS = ["time_bucket_gapfill", *(f"interpolate_{m}" for m in ("null", "prev", "next", "constant", "linear")), *(f"fill_{m}" for m in ("exact", "previous", "next", "closer", "linear", "constant"))]
CONDITIONS = {"interval_arithmetic": " WHERE event_id < 200", "tag_scan": " WHERE user_id < 50"} | dict.fromkeys(USERS, " WHERE user_id < 60")
CONDITIONS |= {"window_count_distinct": " WHERE a.user_id < 40", "window_named": " WHERE l_orderkey < 3000", "arithmetic_projection": " WHERE l_orderkey < 2000", "dialect_division": " WHERE l_orderkey < 2000", "inet_contained": " WHERE c_custkey < 500"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(CONDITIONS))
def test_whole_table(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert CONDITIONS[name] not in ORACLE_SQL[name]
    result = duck.execute(ORACLE_SQL[name])
    at = [[c[0] for c in result.description].index(c) for c in columns]
    want = ordered(tuple(r[i] for i in at) for r in result.fetchall())
    assert ordered(df.select(*columns).collect()) == want


def test_dialect_math_to_the_last_digit(spark, tmp_path):
    """Values that smaller tables lack or plain() hides: signed zeros of trunc and round, cot(0), and logarithms of 1924.79 (base 3) and 298.26 (base 10) next to a tie of round."""
    values = [0.0, 49.7, 50.0, 50.3, 51.0, 1923.79, 297.261051773073, 171.2168, 1e-300, 1e18, 1e300, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    result = con.execute(ORACLE_SQL["dialect_math"] + " ORDER BY event_id")
    columns = [c[0] for c in result.description]
    want = [[repr(v) for v in r] for r in result.fetchall()]
    assert [[repr(v) for v in r] for r in QUERIES["dialect_math"](spark, str(tmp_path)).select(*columns).orderBy("event_id").collect()] == want
