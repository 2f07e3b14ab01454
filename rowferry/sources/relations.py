"""Full, column-wise, filtered and preview reads of one relation."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# Fixed pattern: what counts as a plain table, schema or column name.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"

# Default schema of a PostgreSQL read; bounds and default of a preview.
DEFAULT_SCHEMA = "public"
PREVIEW_MAX, PREVIEW_DEFAULT = 200, 20

# JDBC driver class and URL prefix per source type. The jars come with the job
# (spark.jars / spark.jars.packages).
JDBC_DIALECTS = {
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql"),
    "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "jdbc:clickhouse"),
}


def check_identifier(name: str) -> str:
    """The name itself, or ValueError if it is not a plain identifier."""
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def scan(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    where: str | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, cut to columns and limit; Catalyst pushes all three to the source.

    A text predicate is parsed as one boolean expression over the relation, so
    it may use columns that are not selected, and cannot end the statement.
    """
    if where is not None:
        df = df.where(F.expr(where) if isinstance(where, str) else where)
    if columns:
        df = df.select(*[F.col(f"`{check_identifier(c)}`") for c in columns])
    return df if limit is None else df.limit(int(limit))


def split_columns(columns: str | None) -> list[str] | None:
    """``"a, b"`` to ``["a", "b"]``; blank means all columns."""
    return [c.strip() for c in columns.split(",")] if columns else None


def preview(
    df: DataFrame, columns: str | None = None, limit: int = PREVIEW_DEFAULT, order_by: str | None = None
) -> DataFrame:
    """The first rows of a relation; with ``order_by`` they are the same each time."""
    if not 1 <= limit <= PREVIEW_MAX:
        raise ValueError(f"limit must be between 1 and {PREVIEW_MAX}")
    if order_by is not None:
        df = df.orderBy(order_by)
    return scan(df, split_columns(columns), limit=limit)


def jdbc_options(
    source_type: str,
    host: str,
    port: int,
    database: str,
    table: str,
    schema: str | None = None,
    *,
    user: str | None = None,
    password: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of Spark's JDBC reader for one table.

    With a partition column and its bounds the read is split into that many
    range queries, one per task; without them the whole table would go through
    one task, so large tables need them.
    """
    if source_type not in JDBC_DIALECTS:
        raise ValueError(f"No source registered for type '{source_type}'. Available: {', '.join(sorted(JDBC_DIALECTS))}.")
    driver, prefix = JDBC_DIALECTS[source_type]
    schema = schema or (DEFAULT_SCHEMA if source_type == "postgres" else database)
    quote = "`" if source_type == "clickhouse" else '"'
    options = {
        "driver": driver,
        "url": f"{prefix}://{host}:{port}/{database}",
        "dbtable": ".".join(f"{quote}{check_identifier(n)}{quote}" for n in (schema, table)),
        "fetchsize": str(fetch_size),
        "pushDownPredicate": "true",
        "pushDownLimit": "true",
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if partition_column is not None:
        if bounds is None or partitions is None:
            raise ValueError("a partition column needs bounds and a number of partitions")
        options |= {
            "partitionColumn": check_identifier(partition_column),
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_reader(spark: SparkSession, options: dict[str, str]) -> DataFrameReader:
    return spark.read.format("jdbc").options(**options)


def jdbc_bounds(options: dict[str, str], column: str) -> dict[str, str]:
    """Options that read (low, high) of a column: the bounds a partitioned read of the same table needs.

    One small row, worked out by the database. Give it to ``jdbc_reader`` and the row's values
    to ``jdbc_options(bounds=...)``; without bounds a table is read by one task.
    """
    quote = '"' if options["url"].startswith("jdbc:postgresql") else "`"
    name = f"{quote}{check_identifier(column)}{quote}"
    plain = {k: v for k, v in options.items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    return plain | {"dbtable": f"(SELECT min({name}) AS low, max({name}) AS high FROM {options['dbtable']}) AS bounds"}


def fetch(
    spark: SparkSession,
    options: dict[str, str],
    columns: Iterable[str] | None = None,
    where: str | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows of one remote table; columns, filter and limit travel to the database.

    The database's own catalog is read the same way, e.g. table "columns" of
    schema "information_schema", or "tables" of "system".
    """
    return scan(jdbc_reader(spark, options).load(), columns, where, limit)
