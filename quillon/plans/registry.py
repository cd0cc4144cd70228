"""Registration of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.ts_table import TimeSeriesTable

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def series(self) -> TimeSeriesTable:
        """events as a time-series table: a user is an entity."""
        return TimeSeriesTable(self.events, "ts", ["user_id"], ["value"], ["event_type"], ["event_id"])


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a query written in SQL; oracle: the same for DuckDB, if it is worded differently."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for t in TABLES:
            if t in words:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql
