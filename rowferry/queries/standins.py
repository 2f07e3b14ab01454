"""Run history, schedules and spec tables derived from the given tables.

The application keeps these in its own database; here every row of a given table
becomes one row of history or one spec, so the queries grow with the data. Each
stand-in exists twice, as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

NOW = "2024-01-31 00:00:00"

# events as run history -----------------------------------------------------

RUNS_SQL = """
runs AS (
  SELECT event_id AS run_id, user_id AS sync_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status,
         CASE WHEN event_id % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS "trigger",
         ts AS started_at,
         CASE WHEN event_type <> 'view' THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS finished_at,
         100 + k AS records_read,
         CASE WHEN event_type = 'error' THEN 0 ELSE k END AS records_written,
         CASE WHEN event_type = 'error' THEN CASE WHEN k % 3 = 0 THEN '' ELSE 'timeout ' || k END END AS error_message,
         ts - to_minutes(k % 10) AS due_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    seconds = (F.round(F.col("value") * 1000000).cast("decimal(18,0)") / 1000000).cast("decimal(18,6)")
    zero = F.lit(0)
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("success")
    return (
        table(spark, folder, "events")
        .withColumn("k", k)
        .select(
            F.col("event_id").alias("run_id"),
            F.col("user_id").alias("sync_id"),
            status.alias("status"),
            F.when(F.col("event_id") % 2 == 0, "scheduled").otherwise("manual").alias("trigger"),
            F.col("ts").alias("started_at"),
            F.when(F.col("event_type") != "view", F.col("ts") + F.make_dt_interval(zero, zero, zero, seconds)).alias("finished_at"),
            (100 + F.col("k")).alias("records_read"),
            F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.col("k")).cast("bigint").alias("records_written"),
            F.when(
                F.col("event_type") == "error",
                F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("timeout "), F.col("k").cast("string"))),
            ).alias("error_message"),
            (F.col("ts") - F.make_dt_interval(zero, zero, (F.col("k") % 10).cast("int"))).alias("due_at"),
        )
    )


# customer as syncs ---------------------------------------------------------

SYNCS_SQL = """
syncs AS (
  SELECT c_custkey AS sync_id, c_name AS name,
         CAST(c_custkey % 100 AS BIGINT) AS source_id, CAST(c_nationkey AS BIGINT) AS destination_id,
         CAST(c_custkey % 250 AS BIGINT) AS mapping_id,
         CAST(1 + c_custkey % 12 AS INT) AS interval_value,
         CASE WHEN c_custkey % 2 = 0 THEN 'hours' ELSE 'days' END AS interval_unit,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':30' END AS run_at_time,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 00:00:00' + to_minutes(c_custkey) END AS next_run,
         CASE c_custkey % 4 WHEN 2 THEN 'paused' WHEN 3 THEN 'inactive' ELSE 'active' END AS status
  FROM customer
)"""


def syncs(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    start = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return table(spark, folder, "customer").select(
        key.alias("sync_id"),
        F.col("c_name").alias("name"),
        (key % 100).alias("source_id"),
        F.col("c_nationkey").cast("bigint").alias("destination_id"),
        (key % 250).alias("mapping_id"),
        (1 + key % 12).cast("int").alias("interval_value"),
        F.when(key % 2 == 0, "hours").otherwise("days").alias("interval_unit"),
        F.when(key % 5 != 0, F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lit(":30"))).alias("run_at_time"),
        F.when(key % 17 != 0, start + F.make_dt_interval(F.lit(0), F.lit(0), key.cast("int"))).alias("next_run"),
        F.when(key % 4 == 2, "paused").when(key % 4 == 3, "inactive").otherwise("active").alias("status"),
    )


# supplier as sources, nation as destinations -------------------------------

SOURCES_SQL = """
sources AS (
  SELECT s_suppkey AS source_id, s_name AS name,
         CASE s_suppkey % 3 WHEN 0 THEN 'clickhouse' ELSE 'postgres' END AS type
  FROM supplier
)"""
DESTINATIONS_SQL = """
destinations AS (
  SELECT CAST(n_nationkey AS BIGINT) AS destination_id, n_name AS name,
         CASE n_nationkey % 2 WHEN 0 THEN 'bitrix24' ELSE 'amocrm' END AS type
  FROM nation
)"""


def sources(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 3 == 0, "clickhouse").otherwise("postgres")
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), kind.alias("type")
    )


def destinations(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("n_nationkey") % 2 == 0, "bitrix24").otherwise("amocrm")
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("destination_id"), F.col("n_name").alias("name"), kind.alias("type")
    )


# part as the columns of many tables, 50 columns each ------------------------

COLUMNS_SQL = """
catalog AS (
  SELECT CASE t % 10 WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'sales' ELSE 'public' END AS table_schema,
         'table_' || t AS table_name,
         CASE WHEN t % 7 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
         replace(p_name, ' ', '_') || '_' || p_partkey AS column_name,
         CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE 'Nullable(' || lower(p_type) || ')' END AS data_type,
         CASE WHEN p_size % 2 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
         p_partkey AS ordinal_position
  FROM (SELECT *, p_partkey // 50 AS t FROM part)
)"""


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    size, kind, t = F.col("p_size"), F.lower("p_type"), F.col("t")
    return table(spark, folder, "part").withColumn("t", F.call_function("div", F.col("p_partkey"), F.lit(50))).select(
        F.when(t % 10 == 0, "pg_catalog").when(t % 10 == 1, "sales").otherwise("public").alias("table_schema"),
        F.concat(F.lit("table_"), t.cast("string")).alias("table_name"),
        F.when(t % 7 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")).alias("column_name"),
        F.when(size % 2 == 0, kind).otherwise(F.concat(F.lit("Nullable("), kind, F.lit(")"))).alias("data_type"),
        F.when(size % 2 == 0, "NO").otherwise("YES").alias("is_nullable"),
        F.col("p_partkey").alias("ordinal_position"),
    )


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH" + ",".join(ctes) + "\n" + body
