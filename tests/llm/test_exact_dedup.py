from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from rowferry.llm import exact_dedup


def brute(rows):
    groups: dict[str, list] = {}
    for ident, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(ident)
    return groups


def check(df, rows):
    groups = brute(rows)
    found = exact_dedup.exact_duplicates(df).collect()
    assert len(found) == len(rows)
    by_sha = {hashlib.sha256(text.encode()).hexdigest(): ids for text, ids in groups.items()}
    kept: dict[str, list] = {}
    for r in found:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(known) if known else None)
        kept.setdefault(r["text_sha256"], [])
        if r["kept"]:
            kept[r["text_sha256"]].append(r["doc_id"])
    for sha, ids in kept.items():
        known = [i for i in by_sha[sha] if i is not None]
        assert ids == [min(known) if known else None]


def test_odd_rows(odd, nothing):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_a_text_that_a_third_of_all_rows_share(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 1, "the  hot text").when(F.col("id") % 3 == 2, F.concat(F.lit("t"), F.col("id") % 500)).otherwise(
            F.concat(F.lit("the hot text "), F.col("id"))
        ).alias("text"),
    )
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()])


def test_hot_copies_are_split_and_texts_move_once(spark):
    texts = spark.range(1000).select(F.lit("x").alias("norm")).withColumn("text_sha256", F.sha2(F.col("norm"), 256))
    hot = exact_dedup._hot_texts(texts, 8).collect()
    assert len(hot) == 1 and hot[0]["salts"] > 4
