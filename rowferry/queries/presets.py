"""Mappings and value presets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number_parts
from ..functions.presets import apply_preset
from ..operators.mapping import apply_mapping
from ..spec import FieldMap
from .registry import query, table

TEXT = T.StringType()

# The oracle's spelling of the white-space characters.
_WS_SQL = "||".join(
    f"chr({n})"
    for n in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


@query(
    "map_contacts",
    """
SELECT lower(c_name) AS "NAME", upper(c_mktsegment) AS "SEGMENT", CAST(c_custkey AS VARCHAR) AS "ORIGIN_ID",
       c_acctbal AS "BALANCE", c_name AS "TITLE"
FROM customer
""",
)
def map_contacts(spark, folder):
    return apply_mapping(
        table(spark, folder, "customer"),
        [
            FieldMap("c_name", "NAME", "lowercase"),
            FieldMap("c_mktsegment", "SEGMENT", "uppercase"),
            FieldMap("c_custkey", "ORIGIN_ID", "to_string"),
            FieldMap("c_acctbal", "BALANCE", "to_number"),
            FieldMap("c_name", "TITLE"),
        ],
    )


@query("map_last_wins", 'SELECT lower(c_mktsegment) AS "A", c_custkey AS "B" FROM customer')
def map_last_wins(spark, folder):
    return apply_mapping(
        table(spark, folder, "customer"),
        [FieldMap("c_name", "A", "uppercase"), FieldMap("c_custkey", "B"), FieldMap("c_mktsegment", "A", "lowercase")],
    )


@query("map_missing_column", 'SELECT lower(c_name) AS "EMAIL" FROM customer')
def map_missing_column(spark, folder):
    return apply_mapping(
        table(spark, folder, "customer"),
        [FieldMap("c_name", "EMAIL", "lowercase"), FieldMap("c_phone", "PHONE"), FieldMap("C_NAME", "NAME")],
    )


@query("preset_lowercase", "SELECT doc_id, lower(text) AS out FROM documents")
def preset_lowercase(spark, folder):
    return table(spark, folder, "documents").select("doc_id", apply_preset(F.col("text"), TEXT, "lowercase").alias("out"))


# Upper-casing is the full mapping: a sharp s becomes two letters.
@query("preset_uppercase", "SELECT conv_id, turn, upper(replace(text, 'ß', 'SS')) AS out FROM conversations")
def preset_uppercase(spark, folder):
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", apply_preset(F.col("text"), TEXT, "uppercase").alias("out"))


@query(
    "preset_trim",
    f"""
SELECT doc_id, trim(chr(9) || chr(160) || chr(8195) || ' ' || text || chr(12288) || chr(10) || ' ' || chr(31), {_WS_SQL}) AS out
FROM documents
""",
)
def preset_trim(spark, folder):
    padded = F.concat(F.lit("\t\xa0\N{EM SPACE} "), F.col("text"), F.lit("\N{IDEOGRAPHIC SPACE}\n \x1f"))
    return table(spark, folder, "documents").select("doc_id", apply_preset(padded, TEXT, "trim").alias("out"))


@query(
    "preset_to_string",
    """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS whole,
       CASE WHEN o_totalprice > 200000 THEN 'True' ELSE 'False' END AS flag,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS moment, strftime(o_orderdate, '%Y-%m-%d') AS day,
       CAST(CAST(o_custkey AS DOUBLE) / 4 AS VARCHAR) AS quarter
FROM orders
""",
)
def preset_to_string(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("whole"),
        (F.col("o_totalprice") > 200000).alias("flag"),
        F.col("o_orderdate").alias("moment"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_custkey").cast("double") / 4).alias("quarter"),
    )
    text = [FieldMap(c, c, "to_string") for c in orders.columns[1:]]
    return apply_mapping(orders, [FieldMap("o_orderkey", "o_orderkey"), *text])


@query(
    "preset_passthrough",
    "SELECT p_partkey, p_name AS blank, CAST(NULL AS VARCHAR) AS nothing, p_brand AS plain FROM part",
)
def preset_passthrough(spark, folder):
    parts = table(spark, folder, "part").withColumn("empty", F.lit(None).cast("string"))
    return apply_mapping(
        parts,
        [
            FieldMap("p_partkey", "p_partkey"),
            FieldMap("p_name", "blank", ""),
            FieldMap("empty", "nothing", "uppercase"),
            FieldMap("p_brand", "plain", None),
        ],
    )


@query("preset_unknown_noop", "SELECT p_partkey, p_name AS custom, p_type AS future FROM part")
def preset_unknown_noop(spark, folder):
    return apply_mapping(
        table(spark, folder, "part"),
        [
            FieldMap("p_partkey", "p_partkey"),
            FieldMap("p_name", "custom", "split_name(1)"),
            FieldMap("p_type", "future", "reverse"),
        ],
    )


# Every event spells its number in one of eight ways, five of which are numbers.
def _number_text():
    k, v = F.get_json_object("props", "$.k"), F.col("value").cast("string")
    case = F.col("event_id") % 8
    return (
        F.when(case == 0, F.concat(F.lit(" "), k, F.lit("\t")))
        .when(case == 1, F.concat(F.lit("1_0"), k))
        .when(case == 2, F.concat(F.lit("-"), k, F.lit(".5")))
        .when(case == 3, F.concat(k, F.lit("e2")))
        .when(case == 4, F.concat(k, F.lit("d")))
        .when(case == 5, F.concat(F.lit(" "), k, F.lit(",000 ")))
        .when(case == 6, v)
        .otherwise(F.concat(F.lit("1__"), k))
    )


_NUMBER_TEXT_SQL = """
numbers AS (
  SELECT event_id, CASE event_id % 8
    WHEN 0 THEN ' ' || k || chr(9) WHEN 1 THEN '1_0' || k WHEN 2 THEN '-' || k || '.5' WHEN 3 THEN k || 'e2'
    WHEN 4 THEN k || 'd' WHEN 5 THEN ' ' || k || ',000 ' WHEN 6 THEN CAST(value AS VARCHAR) ELSE '1__' || k END AS raw
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
)"""


@query(
    "preset_to_number",
    "WITH" + _NUMBER_TEXT_SQL + r"""
, parsed AS (
  SELECT event_id, raw, t,
    CASE WHEN regexp_full_match(t, '[+-]?[0-9]+(_[0-9]+)*') THEN CAST(replace(t, '_', '') AS BIGINT) END AS int_v,
    CASE WHEN regexp_full_match(t, '[+-]?[0-9]+(_[0-9]+)*') THEN NULL
         WHEN regexp_full_match(t, '[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?')
         THEN CAST(replace(t, '_', '') AS DOUBLE) END AS dbl_v
  FROM (SELECT *, trim(raw, chr(9) || ' ') AS t FROM numbers)
)
SELECT event_id, int_v, dbl_v, CASE WHEN int_v IS NULL AND dbl_v IS NULL THEN raw END AS str_v FROM parsed
""",
)
def preset_to_number(spark, folder):
    whole, real, leftover = number_parts(F.col("raw"))
    return (
        table(spark, folder, "events")
        .select("event_id", _number_text().alias("raw"))
        .select("event_id", whole.cast("bigint").alias("int_v"), real.alias("dbl_v"), leftover.alias("str_v"))
    )


@query(
    "preset_to_number_variant",
    "WITH" + _NUMBER_TEXT_SQL + r"""
SELECT CASE WHEN regexp_full_match(t, '[+-]?[0-9]+(_[0-9]+)*') THEN 'BIGINT'
            WHEN regexp_full_match(t, '[+-]?[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?') THEN 'DOUBLE' ELSE 'STRING' END AS kind,
       count(*) AS n
FROM (SELECT *, trim(raw, chr(9) || ' ') AS t FROM numbers) GROUP BY 1
""",
)
def preset_to_number_variant(spark, folder):
    number = apply_preset(F.col("raw"), TEXT, "to_number")
    rows = table(spark, folder, "events").select(_number_text().alias("raw"))
    return rows.groupBy(F.schema_of_variant(number).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "preset_parse_date",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'order ' || o_orderkey
                        ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS out
FROM orders
""",
)
def preset_parse_date(spark, folder):
    d, case = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(case == 0, F.date_format(d, "yyyy-M-d"))
        .when(case == 1, F.date_format(d, "yyyy-MM-dd't'HH:mm:ss"))
        .when(case == 2, F.date_format(d, " yyyy-MM-dd  H:m:s "))
        .when(case == 3, F.date_format(d, "d.M.yyyy"))
        .when(case == 4, F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    )
    return table(spark, folder, "orders").select("o_orderkey", apply_preset(text, TEXT, "parse_date").alias("out"))


@query(
    "preset_parse_date_ts",
    """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS out,
       strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS whole
FROM events
""",
)
def preset_parse_date_ts(spark, folder):
    events = table(spark, folder, "events").withColumn("second", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return apply_mapping(
        events,
        [FieldMap("event_id", "event_id"), FieldMap("ts", "out", "parse_date"), FieldMap("second", "whole", "parse_date")],
    )
