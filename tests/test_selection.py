from __future__ import annotations

import json
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from rowferry.operators import selection as sel
from rowferry.operators.position import row_index
from rowferry.operators.prompts import described_columns, pair_prompts, plan_prompt, prompt_batches


def test_batches_of_fifteen(spark):
    def scorer(batch):
        return [(i, len(batch) / 100, str(len(batch))) for i in range(len(batch))]

    rows = sel.score_batches(spark.range(25).coalesce(1), scorer).collect()
    assert [r.reason for r in rows] == ["15"] * 15 + ["10"] * 10


def test_batches_span_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = lambda batch: [(i, 0.0, str(len(batch))) for i in range(len(batch))]
        rows = sel.score_batches(spark.range(40).coalesce(1), sizes).collect()
        assert sorted(r.id for r in rows) == list(range(40))
        assert [r.reason for r in rows] == ["15"] * 30 + ["10"] * 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scorer_rules(spark):
    odd = lambda batch: [(0, 5.0, " a "), (1, -1.0, None), (1, 0.5, "last"), (99, 1.0, "x"), (-1, 1.0, "x")]
    rows = sel.score_batches(spark.range(3).coalesce(1), odd).orderBy("id").collect()
    assert [(r.score, r.reason) for r in rows] == [(1.0, "a"), (0.5, "last"), (0.0, sel.NOT_SCORED)]


def test_rows_pass_through_untouched(spark):
    rows = [(2**60 + 1, "a", D(2024, 1, 1), [1, None]), (None, None, None, None), (3, "", D(1900, 1, 1), [])]
    df = spark.createDataFrame(rows, "k long, s string, t timestamp_ntz, l array<int>").coalesce(1)
    seen = sel.score_batches(df, lambda batch: [(i, 1.0, str(r["k"])) for i, r in enumerate(batch)])
    assert [tuple(r)[:4] for r in seen.collect()] == rows
    assert [r.reason for r in seen.collect()] == [str(2**60 + 1), "None", "3"]


def test_failing_scorer_fails_and_no_rows_is_fine(spark):
    def broken(batch):
        raise RuntimeError("model is down")

    with pytest.raises(Exception, match="model is down"):
        sel.score_batches(spark.range(3), broken).collect()
    assert sel.score_batches(spark.range(0), broken).count() == 0


def scored(spark, *scores):
    return spark.createDataFrame([(i, s, f"r{i}") for i, s in enumerate(scores)], "id long, score double, reason string")


def test_threshold_is_inclusive(spark):
    assert [r.id for r in sel.select_rows(scored(spark, 0.9, 0.2, 0.6), 0.5).orderBy("id").collect()] == [0, 2]
    assert [r.id for r in sel.select_rows(scored(spark, 0.6, 0.59)).collect()] == [0]


def test_summary(spark):
    df = scored(spark, 0.9, 0.2, 0.6).withColumn("reason", F.when(F.col("id") == 2, "").otherwise(F.col("reason")))
    row = sel.selection_summary(df, 0.5, "id").first()
    assert row.summary == "Selected 2 of 3 rows considered (threshold 0.50).\n- row 0 (score 0.90): r0"
    assert (row.rows_considered, row.rows_selected) == (3, 2)


def test_summary_cuts_before_it_looks_at_reasons(spark):
    rows = [(i, 1.0, "") for i in range(5)] + [(5, 0.9, "late")]
    df = spark.createDataFrame(rows, "id long, score double, reason string")
    assert sel.selection_summary(df, 0.5, "id").first().summary.count("\n") == 0


def test_summary_of_nothing(spark):
    nothing = spark.createDataFrame([], "id long, score double, reason string")
    row = sel.selection_summary(nothing, 0.5, "id").first()
    assert row.summary == "Selected 0 of 0 rows considered (threshold 0.50)."


def test_weighted_and_rule(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 9.0), (3, None)], "id int, v double")
    assert [r.score for r in sel.score_weighted(df, [(F.col("v"), 0.5)]).orderBy("id").collect()] == [0.25, 1.0, 0.0]
    assert [r.score for r in sel.score_rule(df, "v > 1").orderBy("id").collect()] == [0.0, 1.0, 0.0]


def test_cluster_finds_the_segment(spark):
    rows = [(i, [float(i % 2 * 100), float(i % 2 * 100 + i % 5)], i % 2 == 1 and i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<float>, known boolean")
    picked = {r.id for r in sel.select_rows(sel.score_cluster(df, "x", F.col("known"), clusters=2)).collect()}
    assert picked == set(range(1, 200, 2))


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = row_index(df, "k").collect()
    assert {r.k: r.row_index for r in rows} == {i: i for i in range(1000)}


def test_row_index_with_a_hot_value(spark):
    # A third of the rows agree in the first order column.
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("g"), "id")
    rows = row_index(df, "g", "id").collect()
    expected = sorted(((5 if i % 3 == 0 else i), i) for i in range(3000))
    assert {(r.g, r.id): r.row_index for r in rows} == {pair: n for n, pair in enumerate(expected)}


def test_row_index_with_copies(spark):
    # A third of the rows are copies of one row.
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1000).otherwise(F.col("id")).alias("k"))
    expected = sorted(1000 if i % 3 == 0 else i for i in range(3000))
    for unique in (True, False):
        rows = sorted((r.row_index, r.k) for r in row_index(df, "k", unique=unique).collect())
        assert rows == list(enumerate(expected))


def test_row_index_splits_copies(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("k"))
    indexed = row_index(df, "k", partitions=8, unique=False)
    sizes = [r["count"] for r in indexed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 6_000


def test_prompts_name_the_rows(spark):
    df = spark.createDataFrame([(i, f'n "{i}"', i * 1.5) for i in range(32)], "id int, name string, v double")
    prompts = prompt_batches(df, ["id"], goal="g", actions="a", selection_rule="r").orderBy("batch").collect()
    assert [p.n_rows for p in prompts] == [15, 15, 2]
    listed = json.loads(prompts[1].prompt.split("Rows:\n")[1])
    assert [x["index"] for x in listed] == list(range(15))
    assert [x["row"]["id"] for x in listed] == [k["id"] for k in prompts[1]["keys"]] == list(range(15, 30))
    assert "(none provided)" in prompts[0].prompt


def test_plan_prompt(spark):
    df = spark.createDataFrame([(i, "x") for i in range(30)], "id int, name string")
    text = plan_prompt(df, ["id"], table_name="t", goal="g", actions="a", notes={"name": "matters"}).first().prompt
    assert [r["id"] for r in json.loads(text.split("Sample rows:\n")[1])] == list(range(20))
    assert "- name (string): matters" in text
    assert plan_prompt(df.limit(0), ["id"], table_name="t", goal="g", actions="a").first().prompt.endswith("(no sample rows available)")


def test_described_columns(spark):
    columns = spark.createDataFrame([("t", 2, "b", "text"), ("t", 1, "a", "int")], "t string, ordinal_position int, name string, data_type string")
    notes = spark.createDataFrame([("t", "b", "matters")], "t string, name string, description string")
    assert described_columns(columns, notes, "t").first().column_lines == "- a (int)\n- b (text): matters"


def test_runnable_agents(spark):
    df = spark.sql(
        "select * from values (1,'ready','g',named_struct('selection_rule','r')), (2,'draft','g',named_struct('selection_rule','r')),"
        "(3,'ready','g',null), (4,'archived','g',named_struct('selection_rule',null)) as t(id,status,goal,plan)"
    )
    assert {(r.id, r.rule_in_force) for r in sel.runnable_agents(df).collect()} == {(1, "r"), (4, "g")}


def test_fill_missing(spark):
    judged = spark.createDataFrame([(1, 0.7, "x"), (2, None, None)], "id long, score double, reason string")
    rows = sel.fill_missing(spark.range(1, 4), judged, "id").orderBy("id").collect()
    assert [(r.score, r.reason) for r in rows] == [(0.7, "x"), (0.0, ""), (0.0, sel.NOT_SCORED)]


def test_an_owner_with_names_on_one_side_gets_a_prompt(spark):
    schema = "mapping_id int, ordinal_position int, name string, data_type string"
    source = spark.createDataFrame([(1, 1, "a", "int"), (2, 1, "b", "int")], schema)
    fields = spark.createDataFrame([(1, 1, "A", "int"), (3, 1, "C", "int")], schema)
    found = {r["mapping_id"]: r["prompt"] for r in pair_prompts(source, fields, "mapping_id").collect()}
    assert sorted(found) == [1, 2, 3] and "Destination fields:\n(none)" in found[2] and "Source columns:\n(none)" in found[3]


def test_hot_order_keys_are_batched(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    batches = prompt_batches(df, ["k"], goal="g", actions="a", selection_rule="r", unique=False, partitions=4).collect()
    assert sorted(r["n_rows"] for r in batches) == [10, 15, 15, 15, 15, 15, 15]


def test_clusters_without_all_features(spark):
    near, far = [(i, 0.1 * (i % 3), 0.0) for i in range(20)], [(100 + i, 50.0, 50.0 + 0.1 * (i % 3)) for i in range(20)]
    rows = near + far + [(200, None, 1.0), (201, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    found = {r["id"]: (r["score"], r["reason"]) for r in sel.score_cluster(df, ["x", "y"], F.col("id") < 5, clusters=2).collect()}
    assert [i for i, (score, _) in found.items() if score == 1.0] == list(range(20)) and len(found) == 42
    assert found[200] == found[201] == (0.0, sel.NO_FEATURES)
    assert {s for s, _ in [(r["score"], 0) for r in sel.score_cluster(df.where("id = 200"), ["x", "y"], F.lit(True)).collect()]} == {0.0}


def test_summary_orders_examples_by_the_key_itself(spark):
    text = spark.createDataFrame([("b", 0.9, "r"), ("ab", 0.9, "r"), ("c", 0.9, "r")], "k string, score double, reason string")
    lines = sel.selection_summary(text, 0.5, "k").first()["summary"].split("\n")[1:]
    assert [line.split()[2] for line in lines] == ["ab", "b", "c"]
    number = spark.createDataFrame([(-3, 0.9, "r"), (-5, 0.9, "r")], "k int, score double, reason string")
    lines = sel.selection_summary(number, 0.5, "k").first()["summary"].split("\n")[1:]
    assert [line.split()[2] for line in lines] == ["-5", "-3"]
