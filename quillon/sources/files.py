"""CSV and SQL text in and out, with the dialect's import and export options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def import_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, delimiter: str = ",", enclosed: str = '"', escaped: str = '"', null_as: str = "", skip_header: bool = False, charset: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Rows of the schema, and rejected lines with their text.

    A line whose fields do not fit the schema is rejected; NOT NULL fields reject nulls.
    """
    read = spark.read.schema(T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema], T.StructField("_rejected", T.StringType())]))
    read = read.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    rows = read.csv(paths, sep=delimiter, quote=enclosed, escape=escaped, nullValue=null_as, header=skip_header, mode="PERMISSIVE", columnNameOfCorruptRecord="_rejected", encoding=charset)
    missing = F.lit(False)
    for f in schema:
        if not f.nullable:
            missing = missing | F.col(f"`{f.name}`").isNull()
    bad = F.col("_rejected").isNotNull() | missing
    return rows.where(~bad).drop("_rejected"), rows.where(bad).select(F.coalesce("_rejected", F.concat_ws(delimiter, *[f"`{f.name}`" for f in schema])).alias("line"))


def export_csv(df: DataFrame, path: str, delimiter: str = ",", enclosed: str = '"', escaped: str = '"', null_as: str = "", header: bool = False, rows_a_file: int = 0) -> None:
    """Write df; chunk files of rows_a_file rows at most where that is set."""
    writer = df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write
    writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path, sep=delimiter, quote=enclosed, escape=escaped, nullValue=null_as, emptyValue="", header=header)


def export_sql(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement a row."""

    def literal(f: T.StructField):
        c = F.col(f"`{f.name}`")
        text = c.cast("string")
        if isinstance(f.dataType, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    names = ", ".join(df.columns)
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), F.concat_ws(", ", *[literal(f) for f in df.schema]), F.lit(");")).alias("statement"))


def save_time_partitioned(df: DataFrame, path: str, ts: str, unit: str = "day") -> None:
    """Parquet in directories by time, so that time spans prune files; the partition interval of a database.

    The rebalance hint lets the engine split a day that is too large for a task.
    """
    part = F.date_trunc(unit, ts).cast("date")
    df.withColumn("_part", part).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)


def read_time_span(spark: SparkSession, path: str, ts: str, start: str, end: str, unit: str = "day") -> DataFrame:
    """Rows with start <= ts < end, reading only the directories that can hold them."""
    df = spark.read.parquet(path)
    kind = df.schema[ts].dataType
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    return df.where((F.col("_part") >= F.date_trunc(unit, lo).cast("date")) & (F.col("_part") <= F.date_trunc(unit, hi).cast("date")) & (F.col(ts) >= lo) & (F.col(ts) < hi)).drop("_part")
