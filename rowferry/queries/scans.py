"""Reads: full, columns, predicate, preview, catalogs and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import staging_path
from ..sources import catalog as catalogs
from ..sources.daily import DISTINCT_BOUND, FREQUENT_BOUND, RANK_BOUND, DailyProfiles
from ..sources.profile import profile
from ..sources.relations import preview, scan
from ..sources.splits import equal_splits, split_of
from . import standins as S
from .registry import query, table


@query("scan_full", "SELECT * FROM customer")
def scan_full(spark, folder):
    return scan(table(spark, folder, "customer"))


@query("scan_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_columns(spark, folder):
    return scan(table(spark, folder, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(
    "scan_where",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def scan_where(spark, folder):
    where = "o_totalprice > 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')"
    return scan(table(spark, folder, "orders"), ["o_orderkey", "o_custkey"], where)


@query(
    "preview_rows",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 20",
)
def preview_rows(spark, folder):
    return preview(table(spark, folder, "customer"), "c_custkey, c_name , c_mktsegment", order_by="c_custkey")


@query(
    "catalog_tables",
    S.with_ctes(
        S.COLUMNS_SQL,
        body="""
SELECT DISTINCT table_name AS name, table_schema AS "schema",
       CASE WHEN table_type = 'VIEW' THEN 'view' ELSE 'table' END AS kind
FROM catalog WHERE table_schema NOT IN ('pg_catalog', 'information_schema')""",
    ),
)
def catalog_tables(spark, folder):
    tables = S.catalog(spark, folder).select("table_schema", "table_name", "table_type").distinct()
    return catalogs.list_tables(tables)


@query(
    "catalog_engine_tables",
    S.with_ctes(
        S.COLUMNS_SQL,
        body="""
SELECT DISTINCT table_name AS name, table_schema AS "schema",
       CASE WHEN table_type = 'VIEW' THEN 'view' ELSE 'table' END AS kind
FROM catalog WHERE table_schema = 'sales'""",
    ),
)
def catalog_engine_tables(spark, folder):
    engine = F.when(F.col("table_type") == "VIEW", "MaterializedView").otherwise("MergeTree")
    tables = S.catalog(spark, folder).select(
        F.col("table_schema").alias("database"), F.col("table_name").alias("name"), engine.alias("engine")
    )
    return catalogs.list_engine_tables(tables.distinct(), "sales")


@query(
    "catalog_columns",
    S.with_ctes(
        S.COLUMNS_SQL,
        body="""
SELECT table_schema, table_name, ordinal_position, column_name AS name, data_type,
       is_nullable = 'YES' AS nullable, ordinal_position % 9 = 0 AS is_primary_key
FROM catalog""",
    ),
)
def catalog_columns(spark, folder):
    columns = S.catalog(spark, folder)
    # Every ninth column is in its table's primary key, every ninth plus one in a unique constraint.
    position = F.col("ordinal_position") % 9
    usage = columns.where(position < 2).select(
        "table_schema",
        "table_name",
        "column_name",
        F.concat(F.col("table_name"), F.when(position == 0, "_pkey").otherwise("_unique")).alias("constraint_name"),
    )
    kind = F.when(F.col("constraint_name").endswith("_pkey"), "PRIMARY KEY").otherwise("UNIQUE")
    constraints = usage.select("table_schema", "table_name", "constraint_name", kind.alias("constraint_type")).distinct()
    return catalogs.describe_columns(columns, constraints, usage)


@query(
    "catalog_engine_columns",
    S.with_ctes(
        S.COLUMNS_SQL,
        body="""
SELECT table_schema, table_name, ordinal_position, column_name AS name, data_type,
       starts_with(data_type, 'Nullable(') AS nullable, ordinal_position % 9 = 0 AS is_primary_key
FROM catalog""",
    ),
)
def catalog_engine_columns(spark, folder):
    columns = S.catalog(spark, folder).select(
        F.col("table_schema").alias("database"),
        F.col("table_name").alias("table"),
        F.col("ordinal_position").alias("position"),
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        F.when(F.col("ordinal_position") % 9 == 0, 1).otherwise(0).alias("is_in_primary_key"),
    )
    return catalogs.describe_engine_columns(columns)


@query(
    "catalog_entity_fields",
    """
WITH standard(entity, name, data_type, nullable, is_primary_key) AS (VALUES
  ('leads', 'id', 'integer', false, true), ('leads', 'name', 'string', false, false),
  ('leads', 'price', 'integer', true, false), ('leads', 'status_id', 'integer', true, false),
  ('leads', 'pipeline_id', 'integer', true, false), ('leads', 'responsible_user_id', 'integer', true, false),
  ('contacts', 'id', 'integer', false, true), ('contacts', 'name', 'string', false, false),
  ('contacts', 'first_name', 'string', true, false), ('contacts', 'last_name', 'string', true, false),
  ('contacts', 'responsible_user_id', 'integer', true, false),
  ('companies', 'id', 'integer', false, true), ('companies', 'name', 'string', false, false),
  ('companies', 'responsible_user_id', 'integer', true, false),
  ('tasks', 'id', 'integer', false, true), ('tasks', 'text', 'string', false, false),
  ('tasks', 'complete_till', 'integer', true, false), ('tasks', 'task_type_id', 'integer', true, false),
  ('tasks', 'responsible_user_id', 'integer', true, false))
SELECT * FROM standard
UNION ALL
SELECT entity, 'custom_fields_values.' || p_partkey, coalesce(CASE WHEN p_size > 5 THEN lower(p_type) END, 'text'),
       CASE WHEN p_size % 3 = 0 THEN p_size % 2 <> 0 ELSE true END, false
FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'leads' WHEN 1 THEN 'contacts' WHEN 2 THEN 'companies' ELSE 'tasks' END AS entity FROM part)
WHERE entity <> 'tasks'
""",
)
def catalog_entity_fields(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    entity = F.when(key % 4 == 0, "leads").when(key % 4 == 1, "contacts").when(key % 4 == 2, "companies").otherwise("tasks")
    custom = table(spark, folder, "part").select(
        entity.alias("entity"),
        key.alias("field_id"),
        F.when(size > 5, F.lower("p_type")).alias("type"),
        F.when(size % 3 == 0, size % 2 == 0).alias("is_required"),
    )
    return catalogs.entity_fields(catalogs.standard_fields(spark), custom)


@query(
    "catalog_declared_fields",
    """
SELECT lower(p_brand) AS entity, CASE WHEN p_size = 1 THEN 'ID' ELSE upper(replace(p_name, ' ', '_')) END AS name,
       coalesce(CASE WHEN p_size > 5 THEN lower(p_type) END, 'string') AS data_type,
       coalesce(CASE WHEN p_size % 3 = 0 THEN 'Y' WHEN p_size % 3 = 1 THEN 'N' END, 'N') <> 'Y' AS nullable,
       p_size = 1 AS is_primary_key
FROM part
""",
)
def catalog_declared_fields(spark, folder):
    size = F.col("p_size")
    fields = table(spark, folder, "part").select(
        F.lower("p_brand").alias("entity"),
        F.when(size == 1, "ID").otherwise(F.upper(F.translate("p_name", " ", "_"))).alias("name"),
        F.when(size > 5, F.lower("p_type")).alias("type"),
        F.when(size % 3 == 0, "Y").when(size % 3 == 1, "N").alias("is_required"),
    )
    return catalogs.declared_fields(fields)


@query(
    "profile_table",
    """
SELECT 'c_custkey' AS column_name, 'bigint' AS data_type, count(*) AS n_rows, count(*) - count(c_custkey) AS n_null,
       CAST(min(c_custkey) AS DOUBLE) AS min_number, CAST(max(c_custkey) AS DOUBLE) AS max_number,
       CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text FROM customer
UNION ALL SELECT 'c_name', 'string', count(*), count(*) - count(c_name), NULL, NULL, min(c_name), max(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(*), count(*) - count(c_nationkey),
       CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE), NULL, NULL FROM customer
UNION ALL SELECT 'c_acctbal', 'double', count(*), count(*) - count(c_acctbal), min(c_acctbal), max(c_acctbal), NULL, NULL FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(*), count(*) - count(c_mktsegment), NULL, NULL, min(c_mktsegment), max(c_mktsegment) FROM customer
""",
)
def profile_table(spark, folder):
    return profile(table(spark, folder, "customer"))


@query("scan_equal_splits", "SELECT event_id, CAST(1 AS INTEGER) AS n_splits, true AS is_even FROM events")
def scan_equal_splits(spark, folder):
    """Events by user, where a third of all rows is one user's and a ninth has none: the splits that hold each row, and
    whether the one it is in has at most twice the mean."""
    key = F.col("event_id")
    events = table(spark, folder, "events").select(
        "event_id", F.when(key % 3 == 0, 7).when(key % 9 != 1, F.col("user_id")).cast("bigint").alias("user_id")
    )
    plan = equal_splits(events, "user_id", 16, "event_id")
    held = events.select("event_id", split_of(plan).alias("held"), F.element_at(split_of(plan), 1).alias("split"))
    sizes = held.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    mean = sum(s.rows for s in plan) / len(plan)
    even = sizes.select("split", (F.col("rows") <= 2 * mean).alias("is_even"))
    return held.join(even, "split", "left").select("event_id", F.size("held").alias("n_splits"), F.coalesce("is_even", F.lit(False)).alias("is_even"))


_EVENT_COLUMNS = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query(
    "profile_by_day",
    " UNION ALL ".join(
        f"""
SELECT '{c}' AS column_name, '{kind}' AS data_type, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null,
       {f"CAST(min({c}) AS DOUBLE)" if kind != "string" else "CAST(NULL AS DOUBLE)"} AS min_number,
       {f"CAST(max({c}) AS DOUBLE)" if kind != "string" else "CAST(NULL AS DOUBLE)"} AS max_number,
       {f"min({c})" if kind == "string" else "CAST(NULL AS VARCHAR)"} AS min_text,
       {f"max({c})" if kind == "string" else "CAST(NULL AS VARCHAR)"} AS max_text,
       count(DISTINCT {c}) AS n_distinct, true AS distinct_holds, true AS quantiles_hold, true AS frequent_hold
FROM events"""
        for c, kind in _EVENT_COLUMNS.items()
    ),
)
def profile_by_day(spark, folder):
    """Events profiled day by day, the last day added later, merged from the sketches; and the truth, to which the sketches' bounds are held."""
    events = table(spark, folder, "events").select(*_EVENT_COLUMNS, F.to_date("ts").alias("day"))
    last = events.agg(F.max("day")).first()[0]
    profiles = DailyProfiles(spark, staging_path(spark, "profiles"))
    profiles.add(events.where(F.col("day") < F.lit(last)), "day")
    profiles.add(events.where(F.col("day") == F.lit(last)), "day")
    shares = (0.01, 0.25, 0.5, 0.75, 0.99)
    merged = profiles.merged(shares=shares)

    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("item"), (F.col(c) if kind != "string" else F.lit(None)).cast("double").alias("number"))
        for c, kind in _EVENT_COLUMNS.items()
    ]
    # One row per value, so that what follows is small; frequent values are combined before they are dealt.
    values = events.select(F.inline(F.array(*cells))).where("item IS NOT NULL").groupBy("column_name", "item", "number").agg(F.count(F.lit(1)).alias("n"))
    told = values.join(merged.select("column_name", "quantiles", "frequent"), "column_name")
    q = [F.col("quantiles")[i] for i in range(len(shares))]
    listed = F.filter("frequent", lambda x: x["item"] == F.col("item"))
    truth = told.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n_values"),
        *[F.sum(F.when(F.col("number") < x, F.col("n")).otherwise(0)).alias(f"below{i}") for i, x in enumerate(q)],
        *[F.sum(F.when(F.col("number") <= x, F.col("n")).otherwise(0)).alias(f"upto{i}") for i, x in enumerate(q)],
        F.max(F.when(F.size(listed) > 0, F.abs(listed[0]["count"] - F.col("n")))).alias("miscount"),
        F.max(F.when(F.size(listed) == 0, F.col("n"))).alias("unlisted"),
        F.min(F.when(F.size(listed) > 0, F.col("n"))).alias("least"),
    )
    rank = lambda name, i: F.col(f"{name}{i}") / F.col("n_values")
    ranks = [(rank("below", i) <= s + RANK_BOUND) & (rank("upto", i) >= s - RANK_BOUND) for i, s in enumerate(shares)]
    slack = FREQUENT_BOUND * F.col("n_values")
    # A value that is not listed is no more frequent than those that are, or than what a sketch can miss.
    rest = F.col("unlisted").isNull() | (F.col("unlisted") <= F.greatest(F.coalesce("least", F.lit(0)) + slack, 2 * slack))
    within = F.col("approx_distinct").between(F.col("n_distinct") * (1 - DISTINCT_BOUND), F.col("n_distinct") * (1 + DISTINCT_BOUND))
    return merged.join(truth, "column_name").select(
        "column_name", "data_type", "n_rows", "n_null", "min_number", "max_number", "min_text", "max_text", "n_distinct",
        within.alias("distinct_holds"), (F.col("quantiles").isNull() | F.forall(F.array(*ranks), lambda x: x)).alias("quantiles_hold"),
        ((F.coalesce("miscount", F.lit(0)) <= slack) & rest).alias("frequent_hold"),
    )
