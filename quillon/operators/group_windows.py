"""Row-group windows of a series: each adds a group id to group by, restarting at every entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.buckets import width_seconds
from quillon.sources.ts_table import TimeSeriesTable


def state_window(t: TimeSeriesTable, state: Column | str, name: str = "group_id") -> DataFrame:
    """A new group whenever the state changes; nulls stay in the current group, leading ones have none."""
    state = F.col(state) if isinstance(state, str) else state
    w = t.series()
    df = t.df.withColumn("_state", state).withColumn("_prev", F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.col("_state").isNotNull() & (F.col("_prev").isNull() | (F.col("_state") != F.col("_prev")))
    run = F.sum(start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(run > 0, run)).drop("_state", "_prev")


def event_window(t: TimeSeriesTable, start: Column, end: Column, name: str = "group_id") -> DataFrame:
    """Rows from one where start holds to the next where end holds, both included; unclosed windows are dropped."""
    w = t.series()
    df = t.df.withColumn("_s", F.coalesce(start, F.lit(False)).cast("int")).withColumn("_e", F.coalesce(end, F.lit(False)).cast("int"))
    df = df.withColumn("_seg", F.coalesce(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # an end outside a window closes nothing, yet cutting there is harmless: a window opens at its own start and ends at the first end from there on
    seg = Window.partitionBy(*t.primary_tags, "_seg")
    df = df.withColumn("_open", F.max("_s").over(seg.orderBy(t.ts, *t.tie_breakers).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_closed", F.max("_e").over(seg))
    kept = df.where("_open = 1 and _closed = 1")
    return kept.withColumn(name, F.dense_rank().over(Window.partitionBy(*t.primary_tags).orderBy("_seg")).cast("long")).drop("_s", "_e", "_seg", "_open", "_closed")


def session_window(t: TimeSeriesTable, gap: str | int, name: str = "group_id") -> DataFrame:
    """A new group where the time since the row before exceeds gap."""
    w = t.series()
    since = F.timestamp_diff("MICROSECOND", F.lag(t.ts).over(w), F.col(t.ts))
    df = t.df.withColumn("_new", (since > width_seconds(gap) * 1_000_000).cast("long"))
    return df.withColumn(name, 1 + F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_new")


def count_window(t: TimeSeriesTable, n: int, slide: int | None = None, name: str = "group_id") -> DataFrame:
    """Groups of n rows, every slide rows; short groups at the end stay."""
    slide = n if slide is None else slide
    if not 0 < slide <= n:
        raise ValueError("0 < slide <= n is needed")
    df = t.df.withColumn("_i", (F.row_number().over(t.series()) - 1).cast("long"))
    first = F.greatest(F.lit(0), F.floor((F.col("_i") - n) / F.lit(slide)) + 1)
    return df.withColumn(name, F.explode(F.sequence(first, F.floor(F.col("_i") / F.lit(slide))))).drop("_i")


def time_window(t: TimeSeriesTable, duration: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with columns window_start and window_end; rows repeat in overlapping ones."""
    w = F.window(t.ts, f"{width_seconds(duration)} seconds", f"{width_seconds(slide or duration)} seconds")
    return t.df.withColumn("_w", w).select(*t.df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def diff(t: TimeSeriesTable, x: str) -> Column:
    """Difference to the entity's row before."""
    return F.col(x) - F.lag(x).over(t.series())
