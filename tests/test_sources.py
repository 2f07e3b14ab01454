from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rowferry.sources import catalog
from rowferry.sources.incremental import WatermarkLog, newer_than, next_watermark
from rowferry.sources.profile import profile
from rowferry.sources.relations import check_identifier, jdbc_bounds, jdbc_options, preview, scan, split_columns


@pytest.mark.parametrize("name", ["users", "_private", "col_1", "A"])
def test_identifier_accepted(name):
    assert check_identifier(name) == name


@pytest.mark.parametrize("name", ["users; DROP TABLE x", 'users"--', "users users", "1users", "", "a\n"])
def test_identifier_refused(name):
    with pytest.raises(ValueError):
        check_identifier(name)


@pytest.fixture(scope="module")
def contacts(spark):
    rows = [(1, "a@example.com", "Alice", True), (2, "b@example.com", "Bob", False)]
    return spark.createDataFrame(rows, "id int, email string, full_name string, is_active boolean")


def test_scan(contacts):
    assert [r.email for r in scan(contacts, ["email"], "is_active").collect()] == ["a@example.com"]
    assert scan(contacts, limit=1).count() == 1
    assert scan(contacts).columns == contacts.columns


def test_scan_refuses_a_second_statement(contacts):
    with pytest.raises(Exception, match="PARSE"):
        scan(contacts, where="is_active; DROP TABLE x")


def test_preview(contacts):
    assert split_columns(" id , email") == ["id", "email"] and split_columns("") is None
    assert [tuple(r) for r in preview(contacts, "id, email", 1, "id").collect()] == [(1, "a@example.com")]
    for limit in (0, 201):
        with pytest.raises(ValueError):
            preview(contacts, limit=limit)


def test_scan_reaches_the_files(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    df = scan(orders, ["o_orderkey"], "o_totalprice > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    delta = newer_than(orders, "o_orderdate", datetime(2000, 1, 1)).select("o_orderkey")
    assert "GreaterThan(o_orderdate,2000-01-01T00:00)" in delta._jdf.queryExecution().executedPlan().toString()


def test_jdbc_options():
    o = jdbc_options("postgres", "h", 5432, "db", "t", partition_column="id", bounds=(0, 100), partitions=4, user="u", password="p")
    assert o["dbtable"] == '"public"."t"' and o["url"] == "jdbc:postgresql://h:5432/db"
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "0", "100", "4")
    assert jdbc_options("clickhouse", "h", 8123, "db", "t")["dbtable"] == "`db`.`t`"
    with pytest.raises(ValueError):
        jdbc_options("postgres", "h", 5432, "db", 't"; drop')
    with pytest.raises(ValueError):
        jdbc_options("postgres", "h", 5432, "db", "t", partition_column="id")


def test_catalog(spark):
    columns = spark.createDataFrame(
        [("public", "contacts", "id", 1, "integer", "NO"), ("public", "contacts", "email", 2, "text", "YES")],
        "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string",
    )
    constraints = spark.createDataFrame(
        [("public", "contacts", "pk", "PRIMARY KEY"), ("public", "contacts", "uq", "UNIQUE")],
        "table_schema string, table_name string, constraint_name string, constraint_type string",
    )
    usage = spark.createDataFrame(
        [("public", "contacts", "pk", "id"), ("public", "contacts", "uq", "id"), ("public", "contacts", "uq", "email")],
        "table_schema string, table_name string, constraint_name string, column_name string",
    )
    described = catalog.describe_columns(columns, constraints, usage)
    found = catalog.columns_of(described, "contacts", "public").collect()
    assert [(r["name"], r.nullable, r.is_primary_key) for r in found] == [("id", False, True), ("email", True, False)]
    with pytest.raises(catalog.TableNotFound):
        catalog.columns_of(described, "nope", "public")


def test_describe_frame_and_session_tables(spark, contacts):
    rows = catalog.describe_frame(contacts, ("id",)).orderBy("ordinal_position").collect()
    assert [(r["name"], r.data_type, r.is_primary_key) for r in rows][:2] == [("id", "int", True), ("email", "string", False)]
    contacts.createOrReplaceTempView("active_contacts")
    listed = {r["name"]: r.kind for r in catalog.list_session_tables(spark).collect()}
    assert listed["active_contacts"] == "view"


def test_newer_than(spark):
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (3, None)], "id int, at timestamp_ntz"
    )
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(newer_than(df, "at", None)) == [1, 2, 3]
    assert ids(newer_than(df, None, datetime(2024, 1, 1))) == [1, 2, 3]
    assert ids(newer_than(df, "at", datetime(2024, 1, 1))) == [2]
    assert ids(newer_than(df, "at", datetime(2024, 1, 1), inclusive=True)) == [1, 2]
    assert ids(newer_than(df, "at", datetime(2024, 1, 1, tzinfo=timezone.utc))) == [2]
    assert ids(newer_than(df, "at", "2024-01-01 00:00:00")) == [2]
    assert tuple(next_watermark(df, "at").first()) == (3, datetime(2024, 1, 2))


def test_newer_than_of_a_text_field(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T00:00:01",)], "at string")
    assert newer_than(df, "at", datetime(2024, 1, 1)).count() == 1


def test_watermark_log(spark, tmp_path):
    log = WatermarkLog(spark, str(tmp_path / "w"))
    assert log.latest("a") is None
    log.commit("a", 5, datetime(2024, 1, 1))
    log.commit("a", 3, datetime(2024, 1, 2))
    log.commit("b", datetime(2024, 5, 5), datetime(2024, 1, 3))
    assert log.latest("a") == "3" and log.latest("b") == "2024-05-05 00:00:00"


def test_profile(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, "y")], "a int, b string")
    rows = {r.column_name: r for r in profile(df, distinct=True).collect()}
    assert (rows["a"].n_rows, rows["a"].n_null, rows["a"].max_number, rows["a"].approx_distinct) == (3, 0, 2.0, 2)
    assert (rows["b"].n_null, rows["b"].min_text, rows["b"].max_text) == (1, "x", "y")


def test_entity_fields(spark):
    custom = spark.createDataFrame(
        [("leads", 7, None, None), ("leads", 8, "date", True), ("tasks", 9, "text", False)],
        "entity string, field_id long, type string, is_required boolean",
    )
    fields = catalog.entity_fields(catalog.standard_fields(spark), custom)
    names = {(r.entity, r["name"], r.data_type, r.nullable) for r in fields.where(F.col("name").startswith("custom")).collect()}
    assert names == {("leads", "custom_fields_values.7", "text", True), ("leads", "custom_fields_values.8", "date", False)}
    assert fields.where("entity = 'tasks'").count() == 5


def test_bounds_of_a_partitioned_read():
    options = jdbc_options("postgres", "h", 5432, "db", "orders", user="u", password="p")
    found = jdbc_bounds(options, "id")
    assert found["dbtable"] == '(SELECT min("id") AS low, max("id") AS high FROM "public"."orders") AS bounds'
    assert found["user"] == "u" and "numPartitions" not in found
    split = jdbc_options("clickhouse", "h", 8123, "db", "orders", partition_column="id", bounds=(1, 9), partitions=4)
    assert jdbc_bounds(split, "id")["dbtable"].startswith("(SELECT min(`id`)") and "lowerBound" not in jdbc_bounds(split, "id")
    with pytest.raises(ValueError):
        jdbc_bounds(options, "id; DROP")
