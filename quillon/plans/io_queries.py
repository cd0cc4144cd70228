"""Sources, sinks, statements that write, and the procedural surface."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.registry import query
from quillon.sources import files
from quillon.sources.storage import scratch


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(t):
    path = scratch(t.spark)
    files.export_csv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path, delimiter="|", null_as="NULL")
    schema = T.StructType([T.StructField("c_custkey", T.LongType(), False), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])
    return files.import_csv(t.spark, path, schema, delimiter="|", null_as="NULL")[0]


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END || ',' || c_nationkey AS line FROM customer WHERE c_custkey % 5 = 0")
def csv_import_reject(t):
    path = scratch(t.spark)
    key = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    files.export_csv(t.customer.select(key.alias("k"), "c_nationkey"), path)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    return files.import_csv(t.spark, path, schema)[1]


@query("""SELECT 'INSERT INTO nation (n_nationkey, n_name) VALUES (' || n_nationkey || ', ''' || n_name || ''');' AS statement FROM nation""")
def export_sql(t):
    return files.export_sql(t.nation.select("n_nationkey", "n_name"), "nation")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-03 06:00:00' AND ts < TIMESTAMP '2024-01-05 06:00:00'")
def time_partitioned_table(t):
    path = scratch(t.spark)
    files.save_time_partitioned(t.events.select("event_id", "ts", "value"), path, "ts")
    return files.read_time_span(t.spark, path, "ts", "2024-01-03 06:00:00", "2024-01-05 06:00:00").select("event_id", "value")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def create_table_as(t):
    path = scratch(t.spark)
    t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).write.parquet(path)
    return t.spark.read.parquet(path)


@query("SELECT n_nationkey, upper(n_name) AS name FROM nation WHERE n_regionkey < 3")
def json_and_orc_sources(t):
    a, b = scratch(t.spark), scratch(t.spark)
    t.nation.where("n_regionkey < 2").write.json(a)
    t.nation.where("n_regionkey = 2").write.orc(b)
    both = t.spark.read.schema(t.nation.schema).json(a).unionByName(t.spark.read.orc(b))
    return both.select("n_nationkey", F.upper("n_name").alias("name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 1000000 + s_suppkey, s_acctbal FROM supplier")
def dml_insert_update_delete(t):
    """UPDATE by a condition, DELETE by one, INSERT of a query: a new version of the table."""
    kept = t.customer.where("c_custkey % 10 <> 3").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return kept.union(t.supplier.select(F.col("s_suppkey") + 1_000_000, "s_acctbal"))


@query("SELECT c_custkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def dml_upsert(t):
    new = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("new"))
    return t.customer.select("c_custkey", "c_acctbal").join(new, "c_custkey", "full").select("c_custkey", F.coalesce("new", "c_acctbal").alias("c_acctbal"))


@query("SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket, count(*) AS n, count(DISTINCT o_totalprice) AS kinds, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL")
def statistics_histogram(t):
    return t.orders.groupBy(F.floor(F.col("o_totalprice") / 50000).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("o_totalprice").alias("kinds"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS y FROM nation")
def scalar_sql_udf(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quillon_double_one(x INT) RETURNS INT RETURN x * 2 + 1")
    t.nation.createOrReplaceTempView("quillon_nation")
    return t.spark.sql("SELECT n_nationkey, quillon_double_one(n_nationkey) AS y FROM quillon_nation")


@query("SELECT n_nationkey, i FROM nation, generate_series(1, 25) AS g(i) WHERE i <= n_regionkey")
def table_function(t):
    return t.nation.select("n_nationkey", F.explode(F.filter(F.sequence(F.lit(1).cast("long"), F.lit(25).cast("long")), lambda i: i <= F.col("n_regionkey"))).alias("i"))


@query("SELECT 55 AS total")
def procedure_loop(t):
    return t.spark.sql("BEGIN DECLARE i INT = 0; DECLARE s INT = 0; WHILE i < 10 DO SET i = i + 1; SET s = s + i; END WHILE; SELECT s AS total; END")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 10 AND o_totalprice > 1000")
def prepared_statement(t):
    return t.spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey = :key AND o_totalprice > :least", args={"key": 10, "least": 1000.0}, orders=t.orders)


@query()
def virtual_tables(t):
    """The catalog's functions as rows; the engine's own, so no SQL has them."""
    return t.spark.sql("SHOW SYSTEM FUNCTIONS")
