"""Integrity of spec tables with seeded faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.integrity import agent_integrity, spec_integrity
from . import standins as S
from .registry import query, table

# supplier: sources with unknown types and shared names; nation: destinations;
# part: mappings; customer: syncs. Each fault sits on its own remainder.
_FAULTY_SQL = """
src AS (
  SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 10 = 3 THEN 'shared ' || s_nationkey ELSE s_name END AS name,
         CASE s_suppkey % 9 WHEN 0 THEN 'mysql' WHEN 1 THEN 'clickhouse' WHEN 2 THEN NULL ELSE 'postgres' END AS type FROM supplier),
dst AS (
  SELECT CAST(n_nationkey AS BIGINT) AS destination_id, CASE WHEN n_regionkey = 2 THEN 'shared' ELSE n_name END AS name,
         CASE n_nationkey % 6 WHEN 0 THEN 'hubspot' WHEN 1 THEN 'bitrix24' WHEN 2 THEN NULL ELSE 'amocrm' END AS type FROM nation),
map AS (
  SELECT p_partkey AS mapping_id, p_partkey % 100 AS source_id,
         CASE WHEN p_partkey % 8 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END AS source_table,
         CASE WHEN p_partkey % 2 = 0 THEN 'bitrix24' ELSE 'amocrm' END AS destination_type,
         CASE p_partkey % 5 WHEN 0 THEN 'lead' WHEN 1 THEN 'leads' WHEN 2 THEN 'contact' WHEN 3 THEN 'tasks' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'invoice' END END AS destination_entity,
         p_partkey % 13 IN (0, 7) AS is_empty, lower(p_brand) AS brand, p_name, p_partkey % 11 AS m FROM part),
items AS (
  SELECT mapping_id, CASE WHEN m = 4 THEN '' ELSE replace(p_name, ' ', '_') END AS source_field, CASE WHEN m = 5 THEN NULL ELSE 'NAME' END AS destination_field,
         CASE m WHEN 1 THEN 'lowercase' WHEN 2 THEN '' WHEN 3 THEN 'concat(a, b)' END AS transformation FROM map WHERE NOT is_empty
  UNION ALL
  SELECT mapping_id, brand, 'BRAND', 'trim' FROM map WHERE NOT is_empty),
syn AS (
  SELECT c_custkey AS sync_id, c_custkey % 120 AS source_id, CAST(c_nationkey AS BIGINT) + CASE WHEN c_custkey % 19 = 0 THEN 100 ELSE 0 END AS destination_id,
         c_custkey % 220 AS mapping_id, CASE WHEN c_custkey % 23 <> 5 THEN CAST(c_custkey % 180 AS INT) END AS interval_value, CASE c_custkey % 3 WHEN 0 THEN 'hours' WHEN 1 THEN 'days' ELSE CASE WHEN c_custkey % 20 = 11 THEN 'weeks' WHEN c_custkey % 20 = 17 THEN NULL ELSE 'hours' END END AS interval_unit,
         CASE c_custkey % 6 WHEN 0 THEN '24:00' WHEN 1 THEN '9:00' WHEN 2 THEN '09:60' WHEN 3 THEN NULL ELSE '23:59' END AS run_at_time,
         CASE c_custkey % 7 WHEN 0 THEN 'archived' WHEN 1 THEN 'paused' WHEN 2 THEN NULL ELSE 'active' END AS status FROM customer)"""

_RULES_SQL = r"""
SELECT 'identifier' AS rule, 'mappings' AS table_name, mapping_id AS id, coalesce(n, '') AS detail
  FROM (SELECT mapping_id, source_table AS n FROM map UNION ALL SELECT mapping_id, source_field FROM items)
  WHERE NOT regexp_full_match(coalesce(n, ''), '[A-Za-z_][A-Za-z0-9_]*')
UNION ALL SELECT 'source_type', 'sources', source_id, coalesce(type, '') FROM src WHERE coalesce(type, '') NOT IN ('postgres', 'clickhouse')
UNION ALL SELECT 'destination_type', 'destinations', destination_id, coalesce(type, '') FROM dst WHERE coalesce(type, '') NOT IN ('bitrix24', 'amocrm')
UNION ALL SELECT 'empty_mapping', 'mappings', mapping_id, '' FROM map WHERE is_empty
UNION ALL SELECT 'incomplete_item', 'mappings', mapping_id, '' FROM items WHERE coalesce(source_field, '') = '' OR coalesce(destination_field, '') = ''
UNION ALL SELECT 'unknown_preset', 'mappings', mapping_id, transformation FROM items
  WHERE coalesce(transformation, '') <> '' AND transformation NOT IN ('lowercase', 'uppercase', 'trim', 'to_string', 'to_number', 'parse_date')
UNION ALL SELECT 'unknown_entity', 'mappings', mapping_id, coalesce(destination_entity, '') FROM map
  WHERE destination_entity IS NULL OR NOT ((destination_type = 'bitrix24' AND destination_entity IN ('lead', 'contact', 'company', 'deal'))
          OR (destination_type = 'amocrm' AND destination_entity IN ('leads', 'contacts', 'companies', 'tasks')))
UNION ALL SELECT 'missing_source', 'syncs', sync_id, 'source_id ' || source_id FROM syn WHERE source_id NOT IN (SELECT source_id FROM src)
UNION ALL SELECT 'missing_destination', 'syncs', sync_id, 'destination_id ' || destination_id FROM syn WHERE destination_id NOT IN (SELECT destination_id FROM dst)
UNION ALL SELECT 'missing_mapping', 'syncs', sync_id, 'mapping_id ' || mapping_id FROM syn WHERE mapping_id NOT IN (SELECT mapping_id FROM map)
UNION ALL SELECT 'foreign_mapping', 'syncs', sync_id, CAST(mapping_id AS VARCHAR) FROM syn JOIN map USING (mapping_id) WHERE syn.source_id <> map.source_id
UNION ALL SELECT 'duplicate_name', 'sources', source_id, name FROM src WHERE name IN (SELECT name FROM src GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_name', 'destinations', destination_id, name FROM dst WHERE name IN (SELECT name FROM dst GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'unknown_status', 'syncs', sync_id, coalesce(status, '') FROM syn WHERE coalesce(status, '') NOT IN ('active', 'paused', 'inactive')
UNION ALL SELECT 'interval_bounds', 'syncs', sync_id, concat_ws(' ', CAST(interval_value AS VARCHAR), interval_unit) FROM syn
  WHERE interval_value IS NULL OR interval_unit IS NULL OR NOT ((interval_unit = 'hours' AND interval_value BETWEEN 1 AND 168) OR (interval_unit = 'days' AND interval_value BETWEEN 1 AND 90))
UNION ALL SELECT 'run_at_time', 'syncs', sync_id, run_at_time FROM syn WHERE NOT regexp_full_match(run_at_time, '([01][0-9]|2[0-3]):[0-5][0-9]')"""


@query("spec_integrity", S.with_ctes(_FAULTY_SQL, body=_RULES_SQL))
def spec_integrity_query(spark, folder):
    s, c, p, n = F.col("s_suppkey"), F.col("c_custkey"), F.col("p_partkey"), F.col("n_nationkey")
    sources = table(spark, folder, "supplier").select(
        s.alias("source_id"),
        F.when(s % 10 == 3, F.concat(F.lit("shared "), F.col("s_nationkey").cast("string"))).otherwise(F.col("s_name")).alias("name"),
        F.when(s % 9 == 0, "mysql").when(s % 9 == 1, "clickhouse").when(s % 9 != 2, "postgres").alias("type"),
    )
    destinations = table(spark, folder, "nation").select(
        n.cast("bigint").alias("destination_id"),
        F.when(F.col("n_regionkey") == 2, "shared").otherwise(F.col("n_name")).alias("name"),
        F.when(n % 6 == 0, "hubspot").when(n % 6 == 1, "bitrix24").when(n % 6 != 2, "amocrm").alias("type"),
    )
    plain, m = F.translate("p_name", " ", "_"), p % 11
    none = F.lit(None).cast("string")

    def item(source, destination, transformation):
        return F.struct(
            source.alias("source_field"), destination.alias("destination_field"), transformation.alias("transformation")
        )

    items = F.array(
        item(
            F.when(m == 4, "").otherwise(plain),
            F.when(m == 5, none).otherwise("NAME"),
            F.when(m == 1, "lowercase").when(m == 2, "").when(m == 3, "concat(a, b)"),
        ),
        item(F.lower("p_brand"), F.lit("BRAND"), F.lit("trim")),
    )
    e = p % 5
    mappings = table(spark, folder, "part").select(
        p.alias("mapping_id"),
        (p % 100).alias("source_id"),
        F.when(p % 8 == 0, F.col("p_name")).otherwise(plain).alias("source_table"),
        F.when(p % 2 == 0, "bitrix24").otherwise("amocrm").alias("destination_type"),
        F.when(e == 0, "lead").when(e == 1, "leads").when(e == 2, "contact").when(e == 3, "tasks").when(p % 3 == 0, "invoice").alias("destination_entity"),
        F.when(p % 13 == 0, F.filter(items, lambda x: F.lit(False))).when(p % 13 != 7, items).alias("field_mappings"),
    )
    t = c % 6
    syncs = table(spark, folder, "customer").select(
        c.alias("sync_id"),
        F.col("c_name").alias("name"),
        (c % 120).alias("source_id"),
        (F.col("c_nationkey") + F.when(c % 19 == 0, 100).otherwise(0)).cast("bigint").alias("destination_id"),
        (c % 220).alias("mapping_id"),
        F.when(c % 23 != 5, c % 180).cast("int").alias("interval_value"),
        F.when(c % 3 == 1, "days").when((c % 3 == 2) & (c % 20 == 11), "weeks").when((c % 3 != 2) | (c % 20 != 17), "hours").alias("interval_unit"),
        F.when(t == 0, "24:00").when(t == 1, "9:00").when(t == 2, "09:60").when(t == 3, none).otherwise("23:59").alias("run_at_time"),
        F.when(c % 7 == 0, "archived").when(c % 7 == 1, "paused").when(c % 7 != 2, "active").alias("status"),
    )
    return spec_integrity(sources, destinations, mappings, syncs)


# Each order is an agent; its numbers point past the ends of nation and part.
@query(
    "agent_integrity",
    """
WITH agents AS (
  SELECT o_orderkey AS agent_id, o_custkey % 30 AS destination_id, o_orderkey % (SELECT max(p_partkey) + 50 FROM part) AS mapping_id,
         CASE o_orderkey % 9 WHEN 0 THEN 'paused' WHEN 1 THEN 'draft' ELSE 'ready' END AS status,
         CASE o_orderkey % 8 WHEN 0 THEN 'guessing' WHEN 1 THEN 'clustering' ELSE 'scoring' END AS strategy,
         (o_orderkey % 10) / 8.0::DOUBLE AS threshold
  FROM orders)
SELECT 'unknown_status' AS rule, 'agents' AS table_name, agent_id AS id, status AS detail FROM agents WHERE status NOT IN ('draft', 'ready', 'archived')
UNION ALL SELECT 'unknown_strategy', 'agents', agent_id, strategy FROM agents WHERE strategy NOT IN ('scoring', 'clustering', 'rule_based')
UNION ALL SELECT 'threshold_bounds', 'agents', agent_id, CAST(threshold AS VARCHAR) FROM agents WHERE threshold NOT BETWEEN 0 AND 1
UNION ALL SELECT 'missing_destination', 'agents', agent_id, 'destination_id ' || destination_id FROM agents WHERE destination_id NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'missing_mapping', 'agents', agent_id, 'mapping_id ' || mapping_id FROM agents WHERE mapping_id NOT IN (SELECT p_partkey FROM part)
""",
)
def agent_integrity_query(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("mapping_id"))
    beyond = parts.agg(F.max("mapping_id")).first()[0] + 50
    key = F.col("o_orderkey")
    agents = table(spark, folder, "orders").select(
        key.alias("agent_id"),
        (F.col("o_custkey") % 30).alias("destination_id"),
        (key % beyond).alias("mapping_id"),
        F.when(key % 9 == 0, "paused").when(key % 9 == 1, "draft").otherwise("ready").alias("status"),
        F.when(key % 8 == 0, "guessing").when(key % 8 == 1, "clustering").otherwise("scoring").alias("strategy"),
        ((key % 10) / F.lit(8.0)).alias("threshold"),
    )
    return agent_integrity(S.destinations(spark, folder), parts, agents)
