"""Field-pair suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.assignment import STEPS, assigned_pairs
from ..operators.replies import parse_pairs
from ..operators.spelling import near_names, suggest_by_edit
from ..operators.suggest import pairs_to_apply, suggest_by_name, validate_pairs
from .registry import query, table

# Each size of part is one mapping: its parts are source columns (even keys) and
# destination fields (odd keys); each part also stands for one proposed pair.
_NAMES_SQL = """
named AS (
  SELECT CAST(p_size AS BIGINT) AS mapping_id, p_partkey AS pos, p_partkey % 2 = 0 AS is_source,
         replace(p_name, ' ', '_') AS source_field, upper(replace(p_name, ' ', '_')) AS destination_field
  FROM part),
source_columns AS (SELECT DISTINCT mapping_id, source_field FROM named WHERE is_source),
destination_fields AS (SELECT DISTINCT mapping_id, destination_field FROM named WHERE NOT is_source),
proposed AS (
  SELECT CAST(p_size AS BIGINT) AS mapping_id, CAST(p_partkey AS INT) AS pos, replace(p_name, ' ', '_') AS source_field,
         upper(replace(CASE WHEN p_partkey % 5 = 0 THEN 'no such field' ELSE p_name END, ' ', '_')) AS destination_field,
         CASE p_partkey % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS confidence
  FROM part),
valid AS (
  SELECT mapping_id, pos, source_field, destination_field, confidence FROM (
    SELECT p.*, row_number() OVER (PARTITION BY p.mapping_id, p.destination_field ORDER BY p.pos) AS n
    FROM proposed p JOIN source_columns USING (mapping_id, source_field) JOIN destination_fields USING (mapping_id, destination_field))
  WHERE n = 1)"""


def _sides(spark, folder):
    named = table(spark, folder, "part").select(
        F.col("p_size").cast("bigint").alias("mapping_id"),
        F.col("p_partkey").alias("pos"),
        F.translate("p_name", " ", "_").alias("name"),
    )
    source = named.where(F.col("pos") % 2 == 0).withColumnRenamed("name", "source_field")
    destination = named.where(F.col("pos") % 2 != 0).select(
        "mapping_id", "pos", F.upper("name").alias("destination_field")
    )
    return source, destination


def _replies(spark, folder):
    """One reply of a model per part, with one proposed pair and some noise in it."""
    key = F.col("p_partkey")
    name = F.translate("p_name", " ", "_")
    target = F.upper(F.translate(F.when(key % 5 == 0, "no such field").otherwise(F.col("p_name")), " ", "_"))
    confidence = (
        F.when(key % 4 == 0, F.lit(""))
        .when(key % 4 == 1, F.lit(',"confidence":5.0'))
        .when(key % 4 == 2, F.lit(',"confidence":"0.25"'))
        .otherwise(F.lit(',"confidence":"high"'))
    )
    return table(spark, folder, "part").select(
        F.col("p_size").cast("bigint").alias("mapping_id"),
        key.alias("reply_id"),
        F.concat(
            F.lit('{"pairs":[7,{"source_field":"'), name, F.lit('","destination_field":"'), target, F.lit('"'), confidence, F.lit("}]}")
        ).alias("reply"),
    )


def _validated(spark, folder):
    source, destination = _sides(spark, folder)
    pairs = parse_pairs(_replies(spark, folder)).withColumn("pos", F.col("reply_id").cast("int")).drop("reply_id")
    return validate_pairs(pairs, source, destination)


@query("suggest_validate", "WITH" + _NAMES_SQL + "\nSELECT * FROM valid")
def suggest_validate(spark, folder):
    return _validated(spark, folder)


_CURRENT_SQL = """
, mapped AS (SELECT mapping_id, source_field, upper(source_field) AS destination_field FROM named WHERE pos % 3 = 0)"""


@query(
    "suggest_apply",
    "WITH"
    + _NAMES_SQL
    + _CURRENT_SQL
    + """
SELECT v.* FROM valid v ANTI JOIN mapped USING (mapping_id, source_field, destination_field) WHERE confidence >= 0.5""",
)
def suggest_apply(spark, folder):
    parts = table(spark, folder, "part").where(F.col("p_partkey") % 3 == 0)
    name = F.translate("p_name", " ", "_")
    current = parts.select(
        F.col("p_size").cast("bigint").alias("mapping_id"), name.alias("source_field"), F.upper(name).alias("destination_field")
    )
    return pairs_to_apply(_validated(spark, folder), current)


# The oracle compares all pairs inside a mapping; the query never does.
@query(
    "suggest_by_name",
    "WITH"
    + """
s AS (SELECT CAST(p_size AS BIGINT) AS mapping_id, p_partkey AS pos, replace(p_name, ' ', '_') AS source_field, string_split(lower(p_name), ' ') AS w
      FROM part WHERE p_partkey % 2 = 0),
d AS (SELECT CAST(p_size AS BIGINT) AS mapping_id, p_partkey AS pos, name AS destination_field, string_split(lower(replace(name, '-', ' ')), ' ') AS w
      FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_')
                        WHEN 1 THEN upper(split_part(p_name, ' ', 2) || '-' || split_part(p_name, ' ', 1))
                        ELSE upper(split_part(p_name, ' ', 1)) || '-' || lower(p_type) END AS name FROM part WHERE p_partkey % 2 <> 0)),
d2 AS (SELECT DISTINCT mapping_id, destination_field, string_split(lower(replace(replace(destination_field, '-', ' '), '_', ' ')), ' ') AS w FROM d),
c AS (SELECT mapping_id, source_field, destination_field, s.pos,
             CASE WHEN lower(source_field) = lower(destination_field) THEN 1.0::DOUBLE
                  WHEN array_to_string(s.w, '') = array_to_string(d2.w, '') THEN 0.9::DOUBLE
                  WHEN list_sort(list_distinct(s.w)) = list_sort(list_distinct(d2.w)) THEN 0.8::DOUBLE
                  WHEN len(list_intersect(s.w, d2.w)) > 0
                  THEN 0.5::DOUBLE + 0.2::DOUBLE * (1.0::DOUBLE / (len(list_distinct(s.w)) + len(list_distinct(d2.w)) - 1)) END AS confidence
      FROM s JOIN d2 USING (mapping_id))
SELECT mapping_id, arg_max(source_field, (confidence, -pos)) AS source_field, destination_field, max(confidence) AS confidence
FROM c WHERE confidence IS NOT NULL GROUP BY mapping_id, destination_field
""",
)
def suggest_by_name_query(spark, folder):
    source, _ = _sides(spark, folder)
    key = F.col("p_partkey")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    field = (
        F.when(key % 3 == 0, F.translate("p_name", " ", "_"))
        .when(key % 3 == 1, F.upper(F.concat(second, F.lit("-"), first)))
        .otherwise(F.concat(F.upper(first), F.lit("-"), F.lower("p_type")))
    )
    destination = table(spark, folder, "part").where(key % 2 != 0).select(
        F.col("p_size").cast("bigint").alias("mapping_id"), key.alias("pos"), field.alias("destination_field")
    )
    return suggest_by_name(source, destination)


_SPELLED_SQL = """
s AS (SELECT CAST(p_size AS BIGINT) AS mapping_id, p_partkey AS pos, replace(p_name, ' ', '_') AS source_field FROM part WHERE p_partkey % 2 = 0),
d AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS mapping_id, upper(replace(p_name, ' ', '')) AS destination_field FROM part WHERE p_partkey % 2 <> 0)"""


def _spelled(spark, folder):
    """Destination names without the underline: every name is an edit away from its own kind."""
    source, _ = _sides(spark, folder)
    destination = table(spark, folder, "part").where(F.col("p_partkey") % 2 != 0).select(
        F.col("p_size").cast("bigint").alias("mapping_id"), F.upper(F.translate("p_name", " ", "")).alias("destination_field")
    )
    return source, destination


# The oracles compare all pairs inside a mapping; the queries never do.
@query(
    "names_near",
    "WITH" + _SPELLED_SQL + """
SELECT DISTINCT mapping_id, lower(source_field) AS left_name, lower(destination_field) AS right_name,
       CAST(levenshtein(lower(source_field), lower(destination_field)) AS INTEGER) AS distance
FROM s JOIN d USING (mapping_id) WHERE levenshtein(lower(source_field), lower(destination_field)) <= 2
""",
)
def names_near(spark, folder):
    source, destination = _spelled(spark, folder)
    left = source.select("mapping_id", F.lower("source_field").alias("left_name"))
    return near_names(left, destination.select("mapping_id", F.lower("destination_field").alias("right_name")))


@query(
    "suggest_by_edit",
    "WITH" + _SPELLED_SQL + """,
c AS (SELECT mapping_id, source_field, pos, destination_field, CAST(levenshtein(lower(source_field), lower(destination_field)) AS INTEGER) AS distance,
             1.0::DOUBLE - levenshtein(lower(source_field), lower(destination_field))::DOUBLE / greatest(length(source_field), length(destination_field)) AS confidence
      FROM s JOIN d USING (mapping_id))
SELECT mapping_id, source_field, destination_field, distance, confidence FROM c WHERE distance <= 2
QUALIFY row_number() OVER (PARTITION BY mapping_id, destination_field ORDER BY distance, pos) = 1
""",
)
def suggest_by_edit_query(spark, folder):
    return suggest_by_edit(*_spelled(spark, folder))


# The oracle tries all assignments of a mapping of eight columns and eight fields, keeping the best per set of fields
# in use; which pairs are chosen may differ among equally good ones, so their sums are compared.
@query(
    "suggest_assigned",
    """
WITH RECURSIVE named AS (
  SELECT p_partkey // 16 AS mapping_id, p_partkey % 2 = 0 AS is_source, list_append(string_split(p_name, ' '), p_type) AS words FROM part),
s AS (SELECT mapping_id, words, row_number() OVER (PARTITION BY mapping_id ORDER BY words) AS i
      FROM (SELECT DISTINCT mapping_id, words FROM named WHERE is_source)),
d AS (SELECT mapping_id, words, row_number() OVER (PARTITION BY mapping_id ORDER BY words) - 1 AS place
      FROM (SELECT DISTINCT mapping_id, words FROM named WHERE NOT is_source)),
common AS (SELECT mapping_id, i, place, len(list_intersect(s.words, d.words)) AS n FROM s JOIN d USING (mapping_id)),
choices AS (
  SELECT mapping_id, i, 1 << place AS field, CAST(round(n::DOUBLE / (6 - n) * 1000000) AS BIGINT) * 64 + 1 AS worth FROM common WHERE n > 0
  UNION ALL SELECT mapping_id, i, 0, 0 FROM s),
best AS (
  SELECT DISTINCT mapping_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS worth FROM s
  UNION ALL
  SELECT b.mapping_id, c.i, b.used | c.field, max(b.worth + c.worth)
  FROM best b JOIN choices c ON c.mapping_id = b.mapping_id AND c.i = b.i + 1 AND b.used & c.field = 0
  GROUP BY 1, 2, 3)
SELECT mapping_id, max(worth) % 64 AS pairs, max(worth) % 64 * 2 AS names_used, max(worth) // 64 AS total
FROM best GROUP BY mapping_id HAVING max(worth) > 0
""",
)
def suggest_assigned(spark, folder):
    words = F.array_append(F.split("p_name", " "), F.col("p_type"))
    named = table(spark, folder, "part").select(
        F.expr("p_partkey div 16").alias("mapping_id"), (F.col("p_partkey") % 2 == 0).alias("is_source"), words.alias("words")
    ).distinct()
    left = named.where("is_source").select("mapping_id", F.array_join("words", "_").alias("source_field"), F.explode("words").alias("word"))
    right = named.where("NOT is_source").select(
        "mapping_id", F.upper(F.array_join("words", "-")).alias("destination_field"), F.explode("words").alias("word")
    )
    n = F.count("*")
    pairs = left.join(right, ["mapping_id", "word"]).groupBy("mapping_id", "source_field", "destination_field").agg(
        (n.cast("double") / (6 - n)).alias("confidence")
    )
    return assigned_pairs(pairs).groupBy("mapping_id").agg(
        F.count("*").alias("pairs"),
        (F.count_distinct("source_field") + F.count_distinct("destination_field")).alias("names_used"),
        F.sum(F.round(F.col("confidence") * STEPS).cast("long")).alias("total"),
    )
