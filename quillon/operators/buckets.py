"""Time buckets, gap filling, interpolation and point fill."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The spellings of the width units, and their seconds.
UNITS = {
    "s": ("s", "sec", "secs", "second", "seconds"),
    "m": ("m", "min", "mins", "minute", "minutes"),
    "h": ("h", "hr", "hrs", "hour", "hours"),
    "d": ("d", "day", "days"),
    "w": ("w", "week", "weeks"),
    "mon": ("mon", "mons", "month", "months"),
    "y": ("y", "yr", "yrs", "year", "years"),
}
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def width_parts(width: str) -> tuple[int, str]:
    """The number and the unit of a width in any spelling."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", width.lower())
    unit = next((u for u, names in UNITS.items() if m and m[2] in names), None)
    if unit is None or int(m[1]) == 0:
        raise ValueError(f"no bucket width: {width!r}")
    return int(m[1]), unit


def width_seconds(width: str | int) -> int:
    """'10s', '5 mins', '1hour', '1d', '2w' or a number of seconds; widths in months have none."""
    if isinstance(width, int):
        return width
    n, unit = width_parts(width)
    if unit not in SECONDS:
        raise ValueError(f"no width in seconds: {width!r}")
    return n * SECONDS[unit]


def width_months(width: str | int) -> int:
    """Months of a width in months or years, 0 for any other."""
    n, unit = (0, "") if isinstance(width, int) else width_parts(width)
    return n * {"mon": 1, "y": 12}.get(unit, 0)


def time_bucket(ts: Column | str, width: str | int) -> Column:
    """Start of the bucket of ts: a floor from the epoch in local time, for instants before it too.

    Widths in months or years ('3mon', '1y') count from January 1900.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    if n := width_months(width):
        months = (F.year(ts) - 1900) * 12 + F.month(ts) - 1
        start = F.floor(months / F.lit(n)) * n
        return F.make_timestamp_ntz((1900 + F.floor(start / 12)).cast("int"), (start % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    w = F.lit(width_seconds(width) * 1_000_000).cast("long")
    local = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.timestamp_add("MICROSECOND", local - F.pmod(local, w), F.lit("1970-01-01").cast("timestamp_ntz"))


def gap_fill(buckets: DataFrame, bucket: str, width: str | int, keys: list[str]) -> DataFrame:
    """All buckets from the first to the last of each key; new rows have nulls.

    buckets: one row a key and bucket.  Each row repeats up to the next row's bucket, so
    no second scan or join is needed.  Widths in months or years step by calendar months.
    """
    months = width_months(width)
    step = F.expr(f"interval {months} months" if months else f"interval {width_seconds(width)} seconds")
    nxt = F.lead(bucket).over(W.partitionBy(*keys).orderBy(bucket))
    filled = buckets.withColumn("_own", F.col(bucket)).withColumn("_next", nxt)
    filled = filled.withColumn(bucket, F.explode(F.when(F.col("_next").isNull(), F.array(bucket)).otherwise(F.sequence(F.col(bucket), F.col("_next") - step, step))))
    keep = [c for c in buckets.columns if c not in (bucket, *keys)]
    return filled.select(*keys, bucket, *[F.when(F.col("_own") == F.col(bucket), F.col(c)).alias(c) for c in keep])


def interpolate(df: DataFrame, value: str, mode: str, bucket: str, keys: list[str], constant: float | None = None) -> Column:
    """Value of a gap: null, prev, next, linear or constant.

    The next value is the last one before in descending order, so that frames only grow.
    """
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*keys).orderBy(F.desc(bucket)).rowsBetween(W.unboundedPreceding, 0)
    x = F.col(value)
    if mode == "null":
        return x
    if mode == "constant":
        return F.coalesce(x, F.lit(constant))
    if mode == "prev":
        return F.last(x, ignorenulls=True).over(before)
    if mode == "next":
        return F.last(x, ignorenulls=True).over(after)
    if mode != "linear":
        raise ValueError(f"no interpolation mode: {mode!r}")
    at = F.when(x.isNotNull(), F.struct(F.col(bucket).alias("t"), x.alias("x")))
    p, n = F.last(at, ignorenulls=True).over(before), F.last(at, ignorenulls=True).over(after)
    span = F.timestamp_diff("MICROSECOND", p["t"], n["t"])
    share = F.timestamp_diff("MICROSECOND", p["t"], F.col(bucket)) / span
    return F.when(x.isNotNull(), x).otherwise(p["x"] + (n["x"] - p["x"]) * share)


def point_fill(points: DataFrame, series: DataFrame, keys: list[str], ts: str, value: str, mode: str, before_ms: int = 0, after_ms: int = 0, constant: float | None = None) -> DataFrame:
    """keys, ts and value for each row of points (keys, ts): the value at that time, or one nearby.

    mode: exact, previous, next, closer, linear or constant.  A row with a null value where
    nothing lies in range.  One shuffle: points and series are merged in time order.
    """
    none = F.lit(None).cast(series.schema[value].dataType)
    rows = series.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    asked = points.select(*keys, F.col(ts).alias("_t"), F.lit(2).alias("_kind"), none.alias("_x"))
    at = F.when(F.col("_kind") == 1, F.struct(F.col("_t").alias("t"), F.col("_x").alias("x")))
    w = W.partitionBy(*keys).orderBy(F.col("_t"), F.col("_kind"))
    back = W.partitionBy(*keys).orderBy(F.desc("_t"), F.col("_kind"))
    both = rows.unionByName(asked).withColumn("_p", F.last(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.last(at, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)))
    micro = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    ahead, behind = micro(F.col("_p.t"), F.col("_t")), micro(F.col("_t"), F.col("_n.t"))
    p = F.when(ahead <= before_ms * 1000, F.col("_p"))
    n = F.when(behind <= after_ms * 1000, F.col("_n"))
    exact = F.when(ahead == 0, F.col("_p.x"))
    out = {
        "exact": exact,
        "previous": F.coalesce(exact, p["x"]),
        "next": F.coalesce(exact, n["x"]),
        "closer": F.coalesce(exact, F.when(p.isNull(), n["x"]).when(n.isNull(), p["x"]).when(ahead <= behind, p["x"]).otherwise(n["x"])),
        "linear": F.coalesce(exact, p["x"] + (n["x"] - p["x"]) * (ahead / (ahead + behind))),
        "constant": F.coalesce(exact, F.lit(constant)),
    }[mode]
    return both.where(F.col("_kind") == 2).select(*keys, F.col("_t").alias(ts), out.alias(value))
