"""Continuous queries: a stream reads rows of a table as they arrive and writes a target table.

Windows by time and session are Spark's own, with a watermark; state, event and count
windows keep a small state an entity in applyInPandasWithState.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Stream:
    """A named continuous query from a folder of Parquet files into a folder of Parquet files."""

    name: str
    source: str
    target: str
    schema: T.StructType
    transform: Callable[[DataFrame], DataFrame]
    checkpoint: str
    where: Column | str | None = None
    columns: list[str] = field(default_factory=list)
    max_files: int | None = None
    output_mode: str = "append"
    query: object = None

    def read(self, spark: SparkSession) -> DataFrame:
        """Filter and projection run before the transformation, as capture does."""
        reader = spark.readStream.schema(self.schema).option("pathGlobFilter", "*.parquet")
        if self.max_files:
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        rows = reader.parquet(self.source)
        rows = rows.where(self.where) if self.where is not None else rows
        return rows.select(*self.columns) if self.columns else rows

    def start(self, spark: SparkSession, available_now: bool = False):
        """Enable the stream: it goes on from its checkpoint."""
        out = self.transform(self.read(spark))
        writer = out.writeStream.queryName(self.name).format("parquet").option("checkpointLocation", self.checkpoint).outputMode(self.output_mode)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
        self.query = writer.start(self.target)
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def status(self) -> str:
        return "running" if self.query is not None and self.query.isActive else "stopped"


class Streams:
    """The streams of a session: create, alter (on, off), drop and show."""

    def __init__(self, spark: SparkSession):
        self.spark, self.by_name = spark, {}

    def create(self, stream: Stream, enable: bool = True) -> None:
        if stream.name in self.by_name:
            raise ValueError(f"stream {stream.name} exists")
        self.by_name[stream.name] = stream
        if enable:
            stream.start(self.spark)

    def alter(self, name: str, enable: bool) -> None:
        stream = self.by_name[name]
        if enable and stream.status() == "stopped":
            stream.start(self.spark)
        elif not enable:
            stream.stop()

    def drop(self, name: str) -> None:
        self.by_name.pop(name).stop()

    def show(self) -> list[tuple[str, str, str, str]]:
        return [(s.name, s.source, s.target, s.status()) for s in self.by_name.values()]


def windowed(rows: DataFrame, ts: str, delay: str, duration: str, slide: str | None, keys: list[str], *aggs: Column) -> DataFrame:
    """Tumbling or sliding windows; rows later than the watermark by delay are dropped."""
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    out = rows.withWatermark(ts, delay).groupBy(w, *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(rows: DataFrame, ts: str, delay: str, gap: str, keys: list[str], *aggs: Column) -> DataFrame:
    out = rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return out.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *[c for c in out.columns if c != "session_window"])


GROUP_STATE = T.StructType([T.StructField("group_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("first_ts", T.TimestampType()), T.StructField("last_ts", T.TimestampType()), T.StructField("mark", T.StringType())])


def row_groups(rows: DataFrame, key: str, ts: str, kind: str, state: str | None = None, count: int = 0, start: str | None = None, end: str | None = None) -> DataFrame:
    """State, event or count windows over a stream: closed groups as key, group_id, n, first_ts, last_ts.

    kind: state (column state), count (of count rows) or event (boolean columns start and
    end).  Rows of an entity must arrive in time order over batches; each batch is sorted.
    The open group of an entity is its whole state.
    """
    out_schema = T.StructType([rows.schema[key], *[f for f in GROUP_STATE.fields if f.name != "mark"]])

    def run(group_key, batches, held: GroupState):
        group, n, first, last, mark = held.get if held.exists else (0, 0, None, None, None)
        closed = []
        table = pd.concat(list(batches)).sort_values(ts, kind="stable")
        marks = table[state] if kind == "state" else [None] * len(table)
        starts = table[start] if kind == "event" else [False] * len(table)
        ends = table[end] if kind == "event" else [False] * len(table)
        for at, m, s, e in zip(table[ts], marks, starts, ends, strict=True):
            if kind == "state" and m is not None and mark is not None and m != mark:
                closed.append((group, n, first, last))
                n = 0
            if kind == "event" and n == 0 and not s:
                continue
            if kind == "state" and m is None and mark is None:
                continue  # nulls before any state have no group
            if n == 0:
                group, first = group + 1, at
            n, last, mark = n + 1, at, m if m is not None else mark
            if kind == "event" and e or kind == "count" and n == count:
                closed.append((group, n, first, last))
                n = 0
        held.update((group, n, first, last, mark))
        yield pd.DataFrame([(group_key[0], *c) for c in closed], columns=[f.name for f in out_schema.fields])

    return rows.groupBy(key).applyInPandasWithState(run, out_schema, GROUP_STATE, "append", GroupStateTimeout.NoTimeout)
