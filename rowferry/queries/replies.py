"""Replies of models and servers, one per row of a given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replies as R
from .registry import query, table


def _json_text(case, *texts):
    """The text of the row's case; the last one stands for all others."""
    out = F
    for n, text in enumerate(texts[:-1]):
        out = out.when(case == n, text)
    return out.otherwise(texts[-1])


def _score_replies(spark, folder):
    k = F.get_json_object("props", "$.k")
    lit, cat = F.lit, F.concat
    reply = _json_text(
        F.col("event_id") % 9,
        cat(lit('{"scores":[{"index":0,"score":0.5,"reason":" a "},{"index":2,"score":0.'), k, lit(',"reason":"k"}]}')),
        lit("not json"),
        lit(
            '{"scores":[{"index":"1","score":"0.75","reason":"x"},{"index":1.7,"score":true},5,'
            '{"index":9,"score":1},{"index":-1,"score":1}]}'
        ),
        cat(lit('{"scores":[{"index":0,"score":5.0,"reason":null},{"index":0,"score":-'), k, lit(',"reason":"last"}]}')),
        lit('{"scores":null}'),
        lit('{"scores":{}}'),
        cat(lit('"{\\"scores\\":[{\\"index\\":1,\\"score\\":'), k, lit(',\\"reason\\":\\"quoted\\"}]}"')),
        lit('{"scores":[{"index":1,"score":null,"reason":"r"},{"index":"1.0","score":1},{"score":1},{"index":" 2 "}]}'),
        lit('[{"index":1,"score":1}]'),
    )
    return table(spark, folder, "events").select("event_id", F.lit(3).alias("batch_len"), reply.alias("reply"))


_SCORE_REPLIES_SQL = r"""
replies AS (
  SELECT event_id, CASE event_id % 9
    WHEN 0 THEN '{"scores":[{"index":0,"score":0.5,"reason":" a "},{"index":2,"score":0.' || k || ',"reason":"k"}]}'
    WHEN 1 THEN 'not json'
    WHEN 2 THEN '{"scores":[{"index":"1","score":"0.75","reason":"x"},{"index":1.7,"score":true},5,{"index":9,"score":1},{"index":-1,"score":1}]}'
    WHEN 3 THEN '{"scores":[{"index":0,"score":5.0,"reason":null},{"index":0,"score":-' || k || ',"reason":"last"}]}'
    WHEN 4 THEN '{"scores":null}'
    WHEN 5 THEN '{"scores":{}}'
    WHEN 6 THEN '"{\"scores\":[{\"index\":1,\"score\":' || k || ',\"reason\":\"quoted\"}]}"'
    WHEN 7 THEN '{"scores":[{"index":1,"score":null,"reason":"r"},{"index":"1.0","score":1},{"score":1},{"index":" 2 "}]}'
    ELSE '[{"index":1,"score":1}]' END AS reply
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)),
docs AS (
  SELECT event_id, CASE WHEN NOT json_valid(reply) THEN NULL WHEN json_type(reply) = 'VARCHAR' THEN json_extract_string(reply, '$') ELSE reply END AS doc
  FROM replies),
lists AS (SELECT event_id, CASE WHEN doc IS NOT NULL AND json_type(doc, '$.scores') = 'ARRAY' THEN json_extract(doc, '$.scores[*]') ELSE [] END AS l FROM docs),
items AS (SELECT event_id, unnest(l) AS j, generate_subscripts(l, 1) AS pos FROM lists),
fields AS (
  SELECT event_id, pos, json_type(j, '$.index') AS it, json_extract_string(j, '$.index') AS i,
         json_type(j, '$.score') AS st, json_extract_string(j, '$.score') AS s, trim(coalesce(json_extract_string(j, '$.reason'), '')) AS r
  FROM items WHERE json_type(j) = 'OBJECT'),
judged AS (
  SELECT event_id, pos, r,
    CASE WHEN it = 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(i), '[+-]?[0-9]+') THEN CAST(trim(i) AS INT) END
         WHEN it IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(trunc(CAST(i AS DOUBLE)) AS INT) END AS i,
    CASE WHEN st IS NULL THEN 0.0::DOUBLE WHEN st = 'BOOLEAN' THEN CASE s WHEN 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         WHEN st = 'NULL' THEN NULL ELSE TRY_CAST(s AS DOUBLE) END AS s
  FROM fields),
last AS (
  SELECT event_id, i, arg_max(s, pos) AS s, arg_max(r, pos) AS r FROM judged
  WHERE i BETWEEN 0 AND 2 AND s IS NOT NULL GROUP BY 1, 2)"""


@query(
    "reply_parse_scores",
    "WITH"
    + _SCORE_REPLIES_SQL
    + """
SELECT e.event_id, CAST(p.i AS INT) AS row_index, coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, s)), 0.0::DOUBLE) AS score,
       CASE WHEN s IS NULL THEN '(not scored by the model)' ELSE r END AS reason
FROM events e CROSS JOIN (VALUES (0), (1), (2)) p(i) LEFT JOIN last l ON l.event_id = e.event_id AND l.i = p.i""",
)
def reply_parse_scores(spark, folder):
    parsed = R.parse_scores(_score_replies(spark, folder), batch_len="batch_len")
    return parsed.select("event_id", "row_index", "score", "reason")


@query(
    "reply_parse_plan",
    """
WITH c AS (SELECT c_custkey, c_custkey % 8 AS m, c_custkey % 100 AS k FROM customer)
SELECT c_custkey,
       CASE m WHEN 0 THEN 'clustering' WHEN 1 THEN 'scoring' WHEN 5 THEN 'scoring' WHEN 6 THEN 'rule_based' WHEN 7 THEN 'scoring' END AS strategy,
       CASE m WHEN 0 THEN 'since ' || k WHEN 1 THEN 'because' WHEN 5 THEN '12' WHEN 6 THEN 'True' WHEN 7 THEN 'quoted' END AS reasoning,
       CASE m WHEN 0 THEN 'spent' WHEN 1 THEN 'rule ' || k WHEN 5 THEN 'r' WHEN 6 THEN 'r' WHEN 7 THEN 'q' END AS selection_rule,
       CASE m WHEN 0 THEN CAST('0.' || k AS DOUBLE) WHEN 5 THEN 1.0::DOUBLE WHEN 7 THEN 0.25::DOUBLE END AS recommended_threshold,
       CASE m WHEN 0 THEN 'call|5|None' WHEN 1 THEN '' WHEN 5 THEN '' WHEN 6 THEN ' mail ' WHEN 7 THEN '' END AS next_actions,
       CASE m WHEN 2 THEN 'not valid JSON' WHEN 3 THEN 'not a JSON object' WHEN 4 THEN 'missing reasoning or selection rule' END AS error
FROM c
""",
)
def reply_parse_plan(spark, folder):
    k = (F.col("c_custkey") % 100).cast("string")
    lit, cat = F.lit, F.concat
    reply = _json_text(
        F.col("c_custkey") % 8,
        cat(
            lit('{"strategy":"clustering","reasoning":" since '), k, lit(' ","selection_rule":"spent","recommended_threshold":"0.'), k,
            lit('","next_actions":["call"," ",5,null]}'),
        ),
        cat(
            lit('{"strategy":"magic","reasoning":"because","selection_rule":"rule '), k,
            lit('","recommended_threshold":"high","next_actions":"none"}'),
        ),
        lit("{broken"),
        lit("[1,2]"),
        lit('{"strategy":"scoring","reasoning":"x","selection_rule":"  "}'),
        lit('{"reasoning":12,"selection_rule":"r","recommended_threshold":7}'),
        lit('{"strategy":"rule_based","reasoning":true,"selection_rule":"r","recommended_threshold":null,"next_actions":[" mail "]}'),
        lit('"{\\"strategy\\":5,\\"reasoning\\":\\"quoted\\",\\"selection_rule\\":\\"q\\",\\"recommended_threshold\\":0.25}"'),
    )
    plans = R.parse_plan(table(spark, folder, "customer").select("c_custkey", reply.alias("reply")))
    return plans.withColumn("next_actions", F.array_join("next_actions", "|"))


_RESPONSES_SQL = """
responses AS (
  SELECT event_id, CASE event_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 500 WHEN 5 THEN 204 ELSE 200 END AS status,
         CASE event_id % 12 WHEN 6 THEN '{"result":' || k || '}' WHEN 7 THEN '{"error":"NOT_FOUND","error_description":"no ' || k || '"}'
              WHEN 8 THEN '{"error":"ERROR_METHOD_NOT_FOUND"}' WHEN 9 THEN '{"error":"QUERY_LIMIT_EXCEEDED","error_description":"slow down"}'
              WHEN 10 THEN '<html>' WHEN 11 THEN '[]' WHEN 4 THEN 'oops ' || k ELSE '' END AS body
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))"""


def _responses(spark, folder, *keep):
    k, case = F.get_json_object("props", "$.k"), F.col("event_id") % 12
    status = F.when(case == 1, 401).when(case == 2, 403).when(case == 3, 404).when(case == 4, 500).when(case == 5, 204)
    body = (
        F.when(case == 6, F.concat(F.lit('{"result":'), k, F.lit("}")))
        .when(case == 7, F.concat(F.lit('{"error":"NOT_FOUND","error_description":"no '), k, F.lit('"}')))
        .when(case == 8, '{"error":"ERROR_METHOD_NOT_FOUND"}')
        .when(case == 9, '{"error":"QUERY_LIMIT_EXCEEDED","error_description":"slow down"}')
        .when(case == 10, "<html>")
        .when(case == 11, "[]")
        .when(case == 4, F.concat(F.lit("oops "), k))
        .otherwise("")
    )
    return table(spark, folder, "events").select(
        "event_id", *keep, status.when(case != 0, 200).alias("status"), body.alias("body")
    )


@query(
    "reply_classify",
    "WITH"
    + _RESPONSES_SQL
    + """
SELECT event_id,
  CASE WHEN status IS NULL THEN 'failed' WHEN status = 404 THEN 'not_found' WHEN status >= 400 THEN 'failed'
       WHEN body = '' OR NOT json_valid(body) THEN 'failed'
       WHEN json_extract_string(body, '$.error') IN ('ERROR_METHOD_NOT_FOUND', 'NOT_FOUND') THEN 'not_found'
       WHEN json_extract(body, '$.error') IS NOT NULL THEN 'failed' ELSE 'written' END AS outcome,
  CASE WHEN status IS NULL THEN 'unreachable' WHEN status = 404 THEN 'no such entity (HTTP 404)'
       WHEN status IN (401, 403) THEN 'credentials rejected (HTTP ' || status || ')'
       WHEN status >= 400 THEN 'HTTP ' || status || ': ' || body
       WHEN body = '' OR NOT json_valid(body) THEN 'response is not JSON'
       ELSE coalesce(json_extract_string(body, '$.error_description'), json_extract_string(body, '$.error')) END AS reason
FROM responses""",
)
def reply_classify(spark, folder):
    return R.classify_responses(_responses(spark, folder)).select("event_id", "outcome", "reason")


@query(
    "reply_echoed_items",
    """
SELECT o_orderkey // 20 AS batch, CAST(count(*) AS INT) AS written FROM orders GROUP BY 1
""",
)
def reply_echoed_items(spark, folder):
    # One reply per batch of 20 order keys that lists the orders as written.
    listed = F.collect_list(F.struct(F.col("o_orderkey").alias("id")))
    reply = F.to_json(F.struct(F.struct(listed.alias("leads")).alias("_embedded")))
    batch = F.call_function("div", F.col("o_orderkey"), F.lit(20))
    replies = table(spark, folder, "orders").groupBy(batch.alias("batch")).agg(reply.alias("body"))
    return replies.select("batch", R.echoed_items(F.col("body"), "leads").alias("written"))
