"""Scoring, thresholds, summaries and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as sel
from ..operators.position import row_index
from ..operators.prompts import described_columns, pair_prompts, plan_prompt, prompt_batches
from . import standins as S
from .registry import query, table


@query(
    "score_clamp",
    "SELECT c_custkey, least(1.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal / 5000)) AS score FROM customer",
)
def score_clamp(spark, folder):
    raw = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("score"))
    return sel.clamp(raw)


_SHARE_SQL = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.0::DOUBLE + o_totalprice / 500000 * 0.5::DOUBLE + (CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.25::DOUBLE))"


def _weighted(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    open_order = F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)
    reason = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("priority "), F.col("o_orderpriority")))
    return sel.score_weighted(orders, [(F.col("o_totalprice") / 500000, 0.5), (open_order, 0.25)], reason)


_WEIGHTED_SQL = f"""
scored AS (
  SELECT o_orderkey, {_SHARE_SQL} AS score,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'priority ' || o_orderpriority END AS reason
  FROM orders
)"""


@query("select_scoring", S.with_ctes(_WEIGHTED_SQL, body="SELECT o_orderkey, score FROM scored WHERE score >= 0.4::DOUBLE"))
def select_scoring(spark, folder):
    return sel.select_rows(_weighted(spark, folder), 0.4).select("o_orderkey", "score")


@query(
    "select_rule",
    """
SELECT c_custkey, CASE WHEN c_acctbal > 1000 AND c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
       CASE WHEN c_acctbal > 1000 AND c_mktsegment = 'BUILDING' THEN 'matches c_acctbal > 1000 AND c_mktsegment = ''BUILDING''' ELSE '' END AS reason
FROM customer
""",
)
def select_rule(spark, folder):
    scored = sel.score_rule(table(spark, folder, "customer"), "c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
    return scored.select("c_custkey", "score", "reason")


@query("select_threshold", "SELECT c_custkey FROM customer WHERE (c_custkey % 10) / 10.0::DOUBLE >= 0.6::DOUBLE")
def select_threshold(spark, folder):
    scored = table(spark, folder, "customer").withColumn("score", (F.col("c_custkey") % 10) / F.lit(10.0))
    return sel.select_rows(scored).select("c_custkey")


@query("select_cluster")
def select_cluster(spark, folder):
    """Iterative: no SQL oracle. Checked on separable data in the tests."""
    rows = table(spark, folder, "embeddings")
    scored = sel.score_cluster(rows, "embedding", F.col("label") == 1, clusters=5)
    return sel.select_rows(scored).select("vec_id", "label", "score", "reason")


@query(
    "select_cluster_blobs",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM orders
""",
)
def select_cluster_blobs(spark, folder):
    """Two blobs far apart, even and odd keys; every eleventh row lacks a feature. Any clustering agrees on these."""
    key = F.col("o_orderkey")
    blob = F.when(key % 2 == 0, 0.0).otherwise(100.0)
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(key % 11 != 0, blob + key % 10 / 100).alias("x"), (blob + F.col("o_custkey") % 7 / 100).alias("y")
    )
    scored = sel.score_cluster(rows, ["x", "y"], (key % 2 == 0) & (key % 5 == 0), clusters=2)
    return scored.select("o_orderkey", "score")


@query(
    "score_fill_missing",
    """
SELECT c.c_custkey, coalesce(o.score, 0.0::DOUBLE) AS score,
       CASE WHEN o.o_custkey IS NULL THEN '(not scored by the model)' ELSE 'ordered' END AS reason
FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) / 1000000 AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o
  ON c.c_custkey = o.o_custkey
""",
)
def score_fill_missing(spark, folder):
    judged = (
        table(spark, folder, "orders")
        .where(F.col("o_orderstatus") == "F")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg((F.max("o_totalprice") / 1000000).alias("score"))
        .withColumn("reason", F.lit("ordered"))
    )
    return sel.fill_missing(table(spark, folder, "customer").select("c_custkey"), judged, "c_custkey")


@query(
    "score_batches",
    """
SELECT c_custkey,
       CASE WHEN c_custkey % 13 = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal / 8000)) END AS score,
       CASE WHEN c_custkey % 13 = 0 THEN '(not scored by the model)' ELSE c_mktsegment END AS reason
FROM customer
""",
)
def score_batches(spark, folder):
    most = sel.BATCH_SIZE

    def scorer(batch):
        # Stands for a model: judges each row on its own and leaves some out.
        assert len(batch) <= most
        return [
            (i, row["c_acctbal"] / 8000, row["c_mktsegment"] + " ")
            for i, row in enumerate(batch)
            if row["c_custkey"] % 13 != 0
        ]

    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return sel.score_batches(customers, scorer).select("c_custkey", "score", "reason")


@query(
    "selection_summary",
    S.with_ctes(
        _WEIGHTED_SQL,
        body="""
, counted AS (SELECT count(*) AS rows_considered, count(*) FILTER (score >= 0.4::DOUBLE) AS rows_selected FROM scored)
, best AS (SELECT * FROM scored WHERE score >= 0.4::DOUBLE ORDER BY score DESC, o_orderkey LIMIT 5)
SELECT rows_considered, rows_selected,
       'Selected ' || rows_selected || ' of ' || rows_considered || ' rows considered (threshold 0.40).' ||
       coalesce((SELECT string_agg(chr(10) || '- row ' || o_orderkey || ' (score ' || printf('%.2f', score) || '): ' || reason, ''
                                   ORDER BY score DESC, o_orderkey) FROM best WHERE reason <> ''), '') AS summary
FROM counted""",
    ),
)
def selection_summary(spark, folder):
    return sel.selection_summary(_weighted(spark, folder), 0.4, "o_orderkey")


@query(
    "selection_top5",
    S.with_ctes(
        _WEIGHTED_SQL,
        body="""
SELECT o_orderkey, score, reason
FROM (SELECT * FROM scored WHERE score >= 0.4::DOUBLE ORDER BY score DESC, o_orderkey LIMIT 5) WHERE reason <> ''""",
    ),
)
def selection_top5(spark, folder):
    return sel.top_examples(_weighted(spark, folder), 0.4, "o_orderkey").select("o_orderkey", "score", "reason")


@query(
    "row_index",
    "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events",
)
def row_index_query(spark, folder):
    return row_index(table(spark, folder, "events").select("event_id", "ts"), "ts", "event_id")


@query(
    "prompt_batches",
    """
WITH numbered AS (
  SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i,
         '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS j
  FROM customer)
SELECT CAST(i // 15 AS BIGINT) AS batch, CAST(count(*) AS INT) AS n_rows, min(c_custkey) AS first_key, max(c_custkey) AS last_key,
       'Goal: win back' || chr(10) || 'Actions: call' || chr(10) || 'Rule: quiet for a year' || chr(10) ||
       'Notes:' || chr(10) || '- c_mktsegment: branch' || chr(10) ||
       'Give each row the probability, 0.0 to 1.0, that it fits the goal.' || chr(10) || 'Rows:' || chr(10) ||
       '[' || string_agg('{"index":' || i % 15 || ',"row":' || j || '}', ',' ORDER BY i) || ']' AS prompt
FROM numbered GROUP BY 1
""",
)
def prompt_batches_query(spark, folder):
    prompts = prompt_batches(
        table(spark, folder, "customer"),
        ["c_custkey"],
        goal="win back",
        actions="call",
        selection_rule="quiet for a year",
        notes={"c_mktsegment": "branch"},
        columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    )
    return prompts.select(
        "batch",
        "n_rows",
        F.element_at("keys", 1)["c_custkey"].alias("first_key"),
        F.element_at("keys", -1)["c_custkey"].alias("last_key"),
        "prompt",
    )


@query(
    "prompt_columns",
    S.with_ctes(
        S.COLUMNS_SQL,
        body="""
SELECT table_schema, table_name,
       string_agg('- ' || column_name || ' (' || data_type || ')' ||
                  CASE WHEN ordinal_position % 4 = 0 THEN ': about ' || ordinal_position ELSE '' END, chr(10) ORDER BY ordinal_position) AS column_lines
FROM catalog GROUP BY 1, 2""",
    ),
)
def prompt_columns(spark, folder):
    columns = S.catalog(spark, folder).withColumnRenamed("column_name", "name")
    notes = columns.where(F.col("ordinal_position") % 4 == 0).select(
        "table_schema", "table_name", "name", F.concat(F.lit("about "), F.col("ordinal_position").cast("string")).alias("description")
    )
    return described_columns(columns, notes, "table_schema", "table_name")


@query(
    "prompt_plan",
    """
SELECT 'Goal: win back' || chr(10) || 'Actions: call' || chr(10) || 'Table: customer' || chr(10) || 'Columns:' || chr(10) ||
       '- c_custkey (bigint)' || chr(10) || '- c_name (string)' || chr(10) || '- c_mktsegment (string): branch' || chr(10) ||
       'Strategies: scoring, clustering, rule_based' || chr(10) || 'Sample rows:' || chr(10) ||
       '[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}', ',' ORDER BY c_custkey) || ']' AS prompt
FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 20)
""",
)
def prompt_plan(spark, folder):
    return plan_prompt(
        table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        ["c_custkey"],
        table_name="customer",
        goal="win back",
        actions="call",
        notes={"c_mktsegment": "branch"},
    )


@query(
    "prompt_pairs",
    S.with_ctes(
        S.COLUMNS_SQL,
        body="""
, s AS (SELECT table_schema, table_name, string_agg('- ' || column_name || ' (' || data_type || ')', chr(10) ORDER BY ordinal_position) AS t
        FROM catalog WHERE ordinal_position % 2 = 0 GROUP BY 1, 2)
, d AS (SELECT table_schema, table_name, string_agg('- ' || upper(column_name) || ' (' || data_type || ')', chr(10) ORDER BY ordinal_position) AS t
        FROM catalog WHERE ordinal_position % 2 <> 0 GROUP BY 1, 2)
SELECT table_schema, table_name, 'Source columns:' || chr(10) || s.t || chr(10) || 'Destination fields:' || chr(10) || d.t || chr(10) ||
       'Pair the columns with the fields they mean; use each field once at most; leave out what has no match.' AS prompt
FROM s JOIN d USING (table_schema, table_name)""",
    ),
)
def prompt_pairs(spark, folder):
    columns = S.catalog(spark, folder).withColumnRenamed("column_name", "name")
    source = columns.where(F.col("ordinal_position") % 2 == 0)
    destination = columns.where(F.col("ordinal_position") % 2 != 0).withColumn("name", F.upper("name"))
    return pair_prompts(source, destination, "table_schema", "table_name")


@query(
    "agents_runnable",
    """
SELECT c_custkey AS agent_id,
       CASE WHEN c_custkey % 7 = 0 THEN 'goal ' || c_name ELSE 'rule ' || c_custkey END AS rule_in_force
FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0
""",
)
def agents_runnable(spark, folder):
    key = F.col("c_custkey")
    rule = F.when(key % 7 != 0, F.concat(F.lit("rule "), key.cast("string"))).otherwise(F.lit(""))
    agents = table(spark, folder, "customer").select(
        key.alias("agent_id"),
        F.concat(F.lit("goal "), F.col("c_name")).alias("goal"),
        F.when(key % 3 == 0, "draft").when(key % 3 == 1, "ready").otherwise("archived").alias("status"),
        F.when(key % 5 != 0, F.struct(rule.alias("selection_rule"))).alias("plan"),
    )
    return sel.runnable_agents(agents).select("agent_id", "rule_in_force")
