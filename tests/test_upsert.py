from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowferry.operators import upsert as U
from rowferry.operators.mapping import record_of, resolve
from rowferry.spec import FieldMap


def calls(df, entity="lead"):
    record = record_of(df)
    return [(r.op, r.method, json.loads(r.payload)) for r in U.record_calls(df, record, entity).collect()]


def test_create_and_update(spark):
    assert calls(spark.createDataFrame([("a",)], "TITLE string")) == [("create", "crm.lead.add", {"fields": {"TITLE": "a"}})]
    updated = calls(spark.createDataFrame([(7, "a")], "ID int, TITLE string"))
    assert updated == [("update", "crm.lead.update", {"id": 7, "fields": {"TITLE": "a"}})]


@pytest.mark.parametrize(
    "upper, lower, expected",
    [
        ("0", "5", ("update", 5)),
        ("0", "cast(null as int)", ("create", None)),
        ("cast(null as int)", "0", ("update", 0)),
        ("3", "4", ("update", 3)),
        ("cast(null as int)", "cast(null as int)", ("create", None)),
    ],
)
def test_id_rule(spark, upper, lower, expected):
    df = spark.sql(f"select {upper} a, {lower} b, 'x' t")
    record = resolve(df, [FieldMap("a", "ID"), FieldMap("b", "id"), FieldMap("t", "TITLE")])
    row = U.record_calls(df, record, "deal").first()
    payload = json.loads(row.payload)
    assert (row.op, payload.get("id")) == expected and payload["fields"] == {"TITLE": "x"}


def test_id_of_mixed_types_and_empty_text(spark):
    df = spark.createDataFrame([("", 5), ("A1", 5)], "a string, b int")
    record = resolve(df, [FieldMap("a", "ID"), FieldMap("b", "id")])
    ids = [json.loads(r.payload).get("id") for r in U.record_calls(df, record, "deal").collect()]
    assert ids == [5, "A1"]


def test_id_as_converted_number(spark):
    df = spark.createDataFrame([("0",), ("12",), ("abc",), ("",)], "a string")
    record = resolve(df, [FieldMap("a", "ID", "to_number")])
    rows = [(r.op, json.loads(r.payload).get("id")) for r in U.record_calls(df, record, "deal").collect()]
    assert rows == [("create", None), ("update", 12), ("update", "abc"), ("create", None)]


def test_mixed_spelling_is_no_id_but_is_left_out(spark):
    assert calls(spark.createDataFrame([(3, "a")], "Id int, TITLE string")) == [("create", "crm.lead.add", {"fields": {"TITLE": "a"}})]


def test_multifields(spark):
    df = spark.createDataFrame([("+1", None, ["x"], "p")], "PHONE string, EMAIL string, WEB array<string>, phone2 string")
    fields = calls(df)[0][2]["fields"]
    assert fields == {"PHONE": [{"VALUE": "+1", "VALUE_TYPE": "WORK"}], "EMAIL": None, "WEB": ["x"], "phone2": "p"}


def test_batch_rule_is_presence(spark):
    with_null = spark.createDataFrame([(None, "a")], "id int, name string")
    assert U.batch_op(record_of(with_null)) == "update"
    assert U.batch_op(record_of(spark.createDataFrame([("a", 1)], "name string, ID int"))) == "create"


def test_batches(spark):
    df = spark.range(1003).repartition(3).withColumn("name", F.lit("x"))
    batches = U.batch_payloads(U.batch_items(df, record_of(df)), 250).collect()
    ids = [item["id"] for b in batches for item in json.loads(b.payload)]
    assert sorted(ids) == list(range(1003)) and max(b.n for b in batches) <= 250
    assert all(len(json.loads(b.payload)) == b.n for b in batches)


def test_not_json(spark):
    df = spark.createDataFrame([("nan", 1.0), ("1", float("inf")), ("2", 2.0), (None, None)], "a string, b double")
    record = resolve(df, [FieldMap("a", "A", "to_number"), FieldMap("b", "B")])
    assert [r[0] for r in df.select(U.not_json(record)).collect()] == [True, True, False, False]


def test_collapse_with_a_hot_id(spark):
    # One id holds a third of the rows, and rows without an id are many copies of one row.
    hot = spark.range(30_000).select(F.lit(1).alias("id"), F.col("id").alias("v"))
    cold = spark.range(30_000).select((F.col("id") % 997 + 2).cast("int").alias("id"), F.col("id").alias("v"))
    none = spark.range(30_000).select(F.lit(None).cast("int").alias("id"), F.lit(5).cast("long").alias("v"))
    out = U.collapse(hot.unionAll(cold).unionAll(none), "id", "v")
    assert out.where("id is null").count() == 30_000
    assert {r.id: r.v for r in out.where("id = 1").collect()} == {1: 29_999}
    expected = {}
    for i in range(30_000):
        expected[i % 997 + 2] = i
    assert {r.id: r.v for r in out.where("id > 1").collect()} == expected


def test_collapse_combines_before_the_shuffle(spark):
    plan = U.collapse(spark.range(10).withColumn("v", F.col("id")), "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_idempotency_key(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "a")], "a int, b string")
    keys = [r[0] for r in df.select(U.idempotency_key("o", [F.col("a"), F.col("b")])).collect()]
    assert len(set(keys)) == 3
