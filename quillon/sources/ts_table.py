"""The time-series table: a wide DataFrame with a time column, metrics, tags and primary tags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeSeriesTable:
    """Column roles of a time-series table.  Primary tags name the entity whose rows form a series."""

    df: DataFrame
    ts: str
    primary_tags: list[str]
    metrics: list[str]
    tags: list[str] = field(default_factory=list)
    tie_breakers: list[str] = field(default_factory=list)

    def series(self) -> WindowSpec:
        """Rows of an entity in time order."""
        return Window.partitionBy(*self.primary_tags).orderBy(self.ts, *self.tie_breakers)

    def span(self, start: str | None = None, end: str | None = None) -> TimeSeriesTable:
        """Rows with start <= ts < end; a plain comparison, so it reaches the Parquet scan."""
        df = self.df
        if start is not None:
            df = df.where(F.col(self.ts) >= F.lit(start).cast(df.schema[self.ts].dataType))
        if end is not None:
            df = df.where(F.col(self.ts) < F.lit(end).cast(df.schema[self.ts].dataType))
        return self.of(df)

    def where(self, condition: Column | str) -> TimeSeriesTable:
        return self.of(self.df.where(condition))

    def of(self, df: DataFrame) -> TimeSeriesTable:
        return TimeSeriesTable(df, self.ts, self.primary_tags, self.metrics, self.tags, self.tie_breakers)

    def tag_table(self) -> DataFrame:
        """One row an entity, metrics unread."""
        return self.df.select(*self.primary_tags, *self.tags).distinct()

    def join_tags(self, dimension: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
        """Join relational rows on tag columns; the optimiser broadcasts the dimension if it is small enough."""
        return self.df.join(dimension, on, how)

    def deduplicate(self, rule: str, sequence: str) -> TimeSeriesTable:
        """Rows equal in entity and time: override keeps the last by sequence, discard the first, keep all."""
        if rule == "keep":
            return self
        last = {"override": True, "discard": False}[rule]
        packed = F.struct(sequence, *[c for c in self.df.columns if c != sequence])
        pick = (F.max if last else F.min)(packed).alias("r")  # one aggregation, with map-side combining
        return self.of(self.df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*self.primary_tags, self.ts])]).agg(pick).select(*[F.col(f"r.{c}") for c in self.df.columns]))

    def retain(self, now: Column, lifetime: str) -> TimeSeriesTable:
        """Rows younger than the retention period."""
        return self.of(self.df.where(F.col(self.ts) >= now - F.expr(f"interval {lifetime}")))

    def delete(self, condition: Column) -> TimeSeriesTable:
        """All rows but those of the tags and time span in condition."""
        return self.of(self.df.where(~F.coalesce(condition, F.lit(False))))
