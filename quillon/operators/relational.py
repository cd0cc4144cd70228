"""Relational operators that Spark lacks or words differently."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.storage import scratch


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def with_ordinality(df: DataFrame, order: list[str], name: str = "ordinality") -> DataFrame:
    """Row numbers from 1 in the given total order, without sorting all rows in one task.

    Rows are range-partitioned by the order and written once with the number of their
    partition, since a range partitioning that is planned twice may cut at other bounds.
    Counts of partitions, one row each, then give each partition its first number.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    local = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = parts.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(counts), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_c", "_before")


def rows_from(df: DataFrame, **series: Column) -> DataFrame:
    """Several arrays side by side as rows, the shorter padded with nulls."""
    zipped = F.arrays_zip(*[c.alias(k) for k, c in series.items()])
    named = F.transform(zipped, lambda r: F.struct(*[r[k].alias(k) for k in series]))
    return df.select("*", F.explode(named).alias("_r")).select(*df.columns, *[F.col(f"_r.{k}").alias(k) for k in series])


def max_one_row(df: DataFrame) -> DataFrame:
    """df, failing at run time if it has two rows or more."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    two = df.limit(2).withColumn("_n", n)
    return two.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row returned by a subquery")).cast("boolean")).otherwise(True)).drop("_n")


def error_if_rows(df: DataFrame, message: str) -> DataFrame:
    """No rows, failing at run time if df has any."""
    return df.limit(1).where(F.raise_error(F.lit(message)).cast("boolean"))


def groups_frame(df: DataFrame, keys: list[str], order: str, before: int, after: int, aggregate, name: str) -> DataFrame:
    """aggregate over peer groups from before to after the current one (a GROUPS frame)."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.withColumn(name, aggregate.over(Window.partitionBy(*keys).orderBy("_g").rangeBetween(-before, after))).drop("_g")


def similar_to(pattern: str, escape: str = "\\") -> str:
    """An anchored regular expression for a SIMILAR TO pattern."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif inside:
            inside = ch != "]"
            out.append(ch)
        elif ch == "[":
            inside = True
            out.append(ch)
        else:
            out.append({"%": ".*", "_": "."}.get(ch, ch if ch in "|*+?{}()" or ch.isalnum() else re.escape(ch)))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def eager_aggregate_join(facts: DataFrame, dimension: DataFrame, on: list[str], group: list[str], metric: str) -> DataFrame:
    """count, sum, min, max and avg of metric by dimension columns, aggregated by the join keys before the join.

    The dimension's join keys must be unique.  The shuffle then carries a row a key, not a fact.
    """
    part = facts.groupBy(*on).agg(F.count(metric).alias("_n"), F.sum(metric).alias("_s"), F.min(metric).alias("_lo"), F.max(metric).alias("_hi"))
    joined = part.join(dimension, on)
    return joined.groupBy(*group).agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("total"), F.min("_lo").alias("lowest"), F.max("_hi").alias("highest"), (F.sum("_s") / F.sum("_n")).alias("mean")
    )
