"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize

#: A key that holds more than 1 / HOT_SHARE of the rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def attach_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with least: the smallest value among the rows of the same key.

    Rows of hot keys get it from a broadcast of fewer than HOT_SHARE rows, so no task has to
    hold one key's rows; the others by a shuffle.
    """
    least = rows.groupBy(key).agg(F.min(value).alias("least"), F.count("*").alias("_n"))
    most = F.lit(max(1, rows.count() // HOT_SHARE))
    hot = F.broadcast(least.where(F.col("_n") > most).select(F.col(key).alias("_hot"), F.col("least").alias("_least")))
    split = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    spread = split.where("_hot is not null").select(*rows.columns, F.col("_least").alias("least"))
    rest = split.where("_hot is null").select(*rows.columns).join(least.where(F.col("_n") <= most).drop("_n"), key)
    return spread.unionByName(rest.select(spread.columns))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable, for every node that has an edge.

    Rounds of two star steps: each node links its larger neighbours to the smallest node it
    knows (large star), then its smaller ones (small star), until no edge changes.  The
    number of rounds grows with the logarithm of the longest path.  Nulls and self-loops make
    no edge.  The edges of a round are deleted once the next one is written.
    """
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    digest = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    was = e.agg(*digest).first()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = attach_least(both, "u", "v")
        star = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        large = materialize(star)
        near = attach_least(large, "u", "v")
        small = near.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        new = materialize(small)
        discard(e)
        discard(large)
        e, now = new, new.agg(*digest).first()
        if was == now:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
