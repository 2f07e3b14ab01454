"""A corpus as a job of stages: language, exact copies, near copies, packing.

Each stage takes what its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm import exact_dedup, language, near_dedup, packing
from rowferry.llm.tables import table
from rowferry.session import stage


def _kept(docs: DataFrame, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that ``decide(docs, id column)`` keeps. It decides per row, so ids that repeat or are missing
    would not tell its rows apart: where there are such, rows are numbered in the order of their ids (null last)."""
    several = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR doc_id IS NULL")
    if several.isEmpty():
        return docs.join(decide(docs, "doc_id").where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    taken = {c.lower() for c in docs.columns}
    row, place = (next(n for n in (f"_{name}{i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("row", "place"))
    # The place cuts through many rows of one id.
    order = [F.col("doc_id").asc_nulls_last(), F.col(place)]
    ranged = docs.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(ranged.drop(place).withColumn(row, F.monotonically_increasing_id()), "rows")
    kept = decide(rows, row).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def keep_told_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (8), trained on the stage's own labelled documents; documents that it rejects go."""
    return language.accepted(docs, language.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (3)."""
    return _kept(docs, exact_dedup.exact_duplicates)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (10): one document of each group stays. Five words, similarity 0.8."""
    return _kept(docs, lambda rows, doc_id: near_dedup.near_duplicates(rows, words=5, percent=80, doc_id=doc_id))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (4)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", keep_told_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# Token counts and trained models are beyond SQL; tests/llm holds the job against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
