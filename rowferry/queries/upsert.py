"""Creates, updates, payloads and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert as U
from ..operators.mapping import record_of, resolve
from ..operators.replies import classify_responses
from ..spec import FieldMap
from .registry import query, table
from .replies import _RESPONSES_SQL, _responses


@query(
    "upsert_split_record",
    """
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE user_id END AS big,
                  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE event_id END AS small FROM events)
SELECT event_id, CASE WHEN coalesce(nullif(big, 0), small) IS NULL THEN 'create' ELSE 'update' END AS op,
       coalesce(nullif(big, 0), small) AS record_id
FROM r
""",
)
def upsert_split_record(spark, folder):
    key = F.col("event_id")
    rows = table(spark, folder, "events").select(
        "event_id",
        F.when(key % 4 == 1, 0).when(key % 4 > 1, F.col("user_id")).cast("bigint").alias("big"),
        F.when(key % 3 == 1, 0).when(key % 3 > 1, key).cast("bigint").alias("small"),
    )
    record = resolve(rows, [FieldMap("big", "ID"), FieldMap("small", "id"), FieldMap("event_id", "TITLE")])
    return rows.select("event_id", U.record_op(record).alias("op"), U.record_id(record).alias("record_id"))


@query(
    "upsert_split_text_id",
    """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'create' ELSE 'update' END AS op,
       CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS record_id
FROM customer
""",
)
def upsert_split_text_id(spark, folder):
    # An empty text is no id.
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select("c_custkey", F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("code"))
    record = resolve(rows, [FieldMap("code", "ID"), FieldMap("c_custkey", "Id")])
    return rows.select("c_custkey", U.record_op(record).alias("op"), U.record_id(record).alias("record_id"))


@query(
    "upsert_split_batch",
    """
SELECT 'update' AS op, c_custkey AS key FROM customer UNION ALL SELECT 'create', o_orderkey FROM orders
""",
)
def upsert_split_batch(spark, folder):
    customers = table(spark, folder, "customer")
    with_id = resolve(customers, [FieldMap("c_custkey", "id"), FieldMap("c_name", "name")])
    orders = table(spark, folder, "orders")
    without = resolve(orders, [FieldMap("o_orderpriority", "name"), FieldMap("o_orderkey", "ID")])
    updates = U.batch_items(customers, with_id, keep=("c_custkey",)).select("op", F.col("c_custkey").alias("key"))
    return updates.unionAll(U.batch_items(orders, without, keep=("o_orderkey",)).select("op", "o_orderkey"))


@query(
    "upsert_collapse",
    """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
  FROM (SELECT event_id, ts, event_type, value, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id FROM events))
WHERE n = 1 OR user_id IS NULL
""",
)
def upsert_collapse(spark, folder):
    # Events without a user stand for creates: all of them stay.
    user = F.when(F.col("event_id") % 10 != 0, F.col("user_id"))
    rows = table(spark, folder, "events").select("event_id", "ts", "event_type", "value", user.alias("user_id"))
    return U.collapse(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    "upsert_counts",
    "WITH"
    + _RESPONSES_SQL
    + """
SELECT u.user_id,
       count(*) FILTER (r.event_id % 12 IN (6, 11)) AS written,
       count(*) FILTER (r.event_id % 12 IN (3, 7, 8)) AS not_found,
       count(*) FILTER (r.event_id % 12 IN (0, 1, 2, 4, 5, 9, 10)) AS failed
FROM responses r JOIN events u ON r.event_id = u.event_id GROUP BY 1""",
)
def upsert_counts(spark, folder):
    results = classify_responses(_responses(spark, folder, "user_id")).withColumn("items", F.lit(1))
    return U.written_counts(results, ("user_id",))


_CONTACT = [
    FieldMap("c_custkey", "ID"),
    FieldMap("c_name", "TITLE"),
    FieldMap("c_mktsegment", "EMAIL", "lowercase"),
    FieldMap("phone", "PHONE"),
    FieldMap("c_nationkey", "NATION"),
]


def _contacts(spark, folder):
    # Every fourth contact has no key yet and every third no phone.
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        key.alias("row_key"),
        F.when(key % 4 != 0, key).alias("c_custkey"),
        "c_name",
        "c_mktsegment",
        F.when(key % 3 != 0, F.concat(F.lit("+1"), key.cast("string"))).alias("phone"),
        "c_nationkey",
    )


@query(
    "payload_multifield",
    """
SELECT c_custkey AS row_key, CASE WHEN c_custkey % 3 <> 0 THEN '+1' || c_custkey END AS phone,
       CASE WHEN c_custkey % 3 <> 0 THEN 'WORK' END AS phone_type, lower(c_mktsegment) AS email, c_name AS title
FROM customer
""",
)
def payload_multifield(spark, folder):
    rows = _contacts(spark, folder)
    record = resolve(rows, _CONTACT)
    wrapped = {n: U.multifield(n, *record.fields[n]) for n in ("PHONE", "EMAIL", "TITLE")}
    return rows.select(
        "row_key",
        wrapped["PHONE"][0]["VALUE"].alias("phone"),
        wrapped["PHONE"][0]["VALUE_TYPE"].alias("phone_type"),
        wrapped["EMAIL"][0]["VALUE"].alias("email"),
        wrapped["TITLE"].alias("title"),
    )


@query(
    "payload_record",
    """
SELECT c_custkey AS row_key, CASE WHEN c_custkey % 4 <> 0 THEN 'update' ELSE 'create' END AS op,
       'crm.contact.' || CASE WHEN c_custkey % 4 <> 0 THEN 'update' ELSE 'add' END AS method,
       '{' || CASE WHEN c_custkey % 4 <> 0 THEN '"id":' || c_custkey || ',' ELSE '' END || '"fields":{"TITLE":"' || c_name ||
       '","EMAIL":[{"VALUE":"' || lower(c_mktsegment) || '","VALUE_TYPE":"WORK"}],"PHONE":' ||
       CASE WHEN c_custkey % 3 <> 0 THEN '[{"VALUE":"+1' || c_custkey || '","VALUE_TYPE":"WORK"}]' ELSE 'null' END ||
       ',"NATION":' || c_nationkey || '}}' AS payload, false AS unsendable
FROM customer
""",
)
def payload_record(spark, folder):
    rows = _contacts(spark, folder)
    return U.record_calls(rows, resolve(rows, _CONTACT), "contact", keep=("row_key",))


@query(
    "payload_mixed_types",
    r"""
SELECT event_id, '{"fields":{"AMOUNT":' || CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN k || '.5' ELSE '"' || k || ' pcs"' END || '}}' AS payload
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
""",
)
def payload_mixed_types(spark, folder):
    k, case = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    text = F.when(case == 0, k).when(case == 1, F.concat(k, F.lit(".5"))).otherwise(F.concat(k, F.lit(" pcs")))
    rows = table(spark, folder, "events").select("event_id", text.alias("amount"))
    record = resolve(rows, [FieldMap("amount", "AMOUNT", "to_number")])
    return rows.select("event_id", U.record_payload(record).alias("payload"))


@query(
    "payload_batches",
    """
SELECT 'update' AS op, c_custkey AS id, c_name AS name, c_nationkey AS nation, true AS in_bound FROM customer
""",
)
def payload_batches(spark, folder):
    # Which rows share a batch is free; what is in the batches and their size is not.
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")
    )
    batches = U.batch_payloads(U.batch_items(rows, record_of(rows)), 50)
    item = F.from_json("payload", "array<struct<id:bigint,name:string,nation:int>>")
    sized = batches.select("op", (F.col("n") <= 50).alias("small"), (F.size(item) == F.col("n")).alias("counted"), item.alias("i"))
    return sized.select("op", (F.col("small") & F.col("counted")).alias("in_bound"), F.inline("i"))


@query(
    "payload_unsendable",
    "SELECT event_id, value < 0.1 AS unsendable FROM events",
)
def payload_unsendable(spark, folder):
    odd = F.when(F.col("value") < 0.1, F.lit("nan")).otherwise(F.col("value").cast("string"))
    rows = table(spark, folder, "events").select("event_id", odd.alias("amount"))
    record = resolve(rows, [FieldMap("amount", "AMOUNT", "to_number")])
    return rows.select("event_id", U.not_json(record).alias("unsendable"))


@query(
    "upsert_idempotency_key",
    """
SELECT o_orderkey, sha256('{"o":"orders","k0":' || o_orderkey || ',"k1":"' || o_orderpriority || '"}') AS call_key FROM orders
""",
)
def upsert_idempotency_key(spark, folder):
    key = U.idempotency_key("orders", [F.col("o_orderkey"), F.col("o_orderpriority")])
    return table(spark, folder, "orders").select("o_orderkey", key.alias("call_key"))
