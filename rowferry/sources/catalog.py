"""Tables and columns of a source, and fields of a destination entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas that hold the database's own tables.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")

# Standard fields of an AmoCRM entity as (name, type, nullable, key).
AMOCRM_FIELDS = {
    "leads": [
        ("id", "integer", False, True),
        ("name", "string", False, False),
        ("price", "integer", True, False),
        ("status_id", "integer", True, False),
        ("pipeline_id", "integer", True, False),
        ("responsible_user_id", "integer", True, False),
    ],
    "contacts": [
        ("id", "integer", False, True),
        ("name", "string", False, False),
        ("first_name", "string", True, False),
        ("last_name", "string", True, False),
        ("responsible_user_id", "integer", True, False),
    ],
    "companies": [
        ("id", "integer", False, True),
        ("name", "string", False, False),
        ("responsible_user_id", "integer", True, False),
    ],
    "tasks": [
        ("id", "integer", False, True),
        ("text", "string", False, False),
        ("complete_till", "integer", True, False),
        ("task_type_id", "integer", True, False),
        ("responsible_user_id", "integer", True, False),
    ],
}
# Fixed value: entities that cannot have custom fields.
WITHOUT_CUSTOM_FIELDS = ("tasks",)


class TableNotFound(Exception):
    """The relation has no columns in the catalog."""


def list_tables(tables: DataFrame) -> DataFrame:
    """Tables and views from ``information_schema.tables``, without system schemas."""
    return (
        tables.where(~F.col("table_schema").isin(*SYSTEM_SCHEMAS))
        .select(
            F.col("table_name").alias("name"),
            F.col("table_schema").alias("schema"),
            F.when(F.col("table_type") == "VIEW", "view").otherwise("table").alias("kind"),
        )
        .orderBy("schema", "name")
    )


def list_engine_tables(tables: DataFrame, database: str) -> DataFrame:
    """Tables and views of one database from ``system.tables``, told apart by engine name."""
    return (
        tables.where(F.col("database") == database)
        .select(
            "name",
            F.col("database").alias("schema"),
            F.when(F.col("engine").contains("View"), "view").otherwise("table").alias("kind"),
        )
        .orderBy("name")
    )


def list_session_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of the session's own catalog."""
    rows = [
        (t.name, t.database or "", "view" if "VIEW" in (t.tableType or "") or t.isTemporary else "table")
        for t in spark.catalog.listTables(database)
    ]
    return spark.createDataFrame(rows, "name string, schema string, kind string").orderBy("schema", "name")


def describe_columns(columns: DataFrame, constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Columns of every table with nullability and primary-key flag.

    The inputs have the layout of the ``information_schema`` relations
    ``columns``, ``table_constraints`` and ``key_column_usage``.
    """
    table = ["table_schema", "table_name"]
    primary = constraints.where(F.col("constraint_type") == "PRIMARY KEY").select(*table, "constraint_name")
    key_columns = (
        key_usage.select(*table, "constraint_name", "column_name")
        .join(primary, [*table, "constraint_name"], "left_semi")
        .select(*table, "column_name", F.lit(True).alias("is_primary_key"))
        .distinct()
    )
    return columns.join(key_columns, [*table, "column_name"], "left").select(
        *table,
        "ordinal_position",
        F.col("column_name").alias("name"),
        "data_type",
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.coalesce("is_primary_key", F.lit(False)).alias("is_primary_key"),
    )


def describe_engine_columns(columns: DataFrame) -> DataFrame:
    """Columns from ``system.columns``; nullability is written in the type."""
    return columns.select(
        F.col("database").alias("table_schema"),
        F.col("table").alias("table_name"),
        F.col("position").alias("ordinal_position"),
        "name",
        F.col("type").alias("data_type"),
        F.col("type").startswith("Nullable(").alias("nullable"),
        (F.col("is_in_primary_key") != 0).alias("is_primary_key"),
    )


def describe_frame(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a DataFrame in order, with the declared keys."""
    rows = [
        (i + 1, f.name, f.dataType.simpleString(), f.nullable, f.name in keys)
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "ordinal_position int, name string, data_type string, nullable boolean, is_primary_key boolean",
    )


def columns_of(described: DataFrame, table: str, schema: str) -> DataFrame:
    """The columns of one table in order; TableNotFound if there are none."""
    found = described.where((F.col("table_schema") == schema) & (F.col("table_name") == table))
    if found.isEmpty():
        raise TableNotFound(f"Table '{schema}.{table}' does not exist.")
    return found.orderBy("ordinal_position")


def standard_fields(spark: SparkSession) -> DataFrame:
    names = ("entity", "name", "data_type", "nullable", "is_primary_key")
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (entity, *f))])
        for entity, fields in AMOCRM_FIELDS.items()
        for f in fields
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def entity_fields(standard: DataFrame, custom: DataFrame) -> DataFrame:
    """Standard fields and an account's custom ones.

    ``custom`` has (entity, field_id, type, is_required); a missing type is
    "text", a missing requirement means optional.
    """
    extra = custom.where(~F.col("entity").isin(*WITHOUT_CUSTOM_FIELDS)).select(
        "entity",
        F.concat(F.lit("custom_fields_values."), F.col("field_id").cast("string")).alias("name"),
        F.coalesce("type", F.lit("text")).alias("data_type"),
        (~F.coalesce("is_required", F.lit(False))).alias("nullable"),
        F.lit(False).alias("is_primary_key"),
    )
    return standard.unionByName(extra)


def declared_fields(fields: DataFrame) -> DataFrame:
    """Fields as a Bitrix24 portal declares them: (entity, name, type, is_required 'Y'/'N')."""
    return fields.select(
        "entity",
        "name",
        F.coalesce("type", F.lit("string")).alias("data_type"),
        (F.coalesce("is_required", F.lit("N")) != "Y").alias("nullable"),
        (F.col("name") == "ID").alias("is_primary_key"),
    )
