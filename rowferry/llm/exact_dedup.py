"""Exact dedup by content sort, in DataFrame functions only.

The normalised texts are range-partitioned by sampled splitters and sorted, so
that equal ones lie side by side; neighbours are compared in full and the
smallest identifier of a run of equals stays.

* The sort key is (first bytes, SHA-256, salt, text): splitters stay short
  however long the texts are, texts with a long common beginning still fall
  apart, and equality is decided by the whole text, not by the digest.
* Range partitioning cannot cut through equal keys. Texts whose copies would
  fill more than a quarter of a partition get salts, so many that each salted
  run is within that quarter; at most 8 texts per partition can be that
  frequent, so they are broadcast. The runs of one such text, one row each,
  are joined at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .tables import shuffle_partitions

PREFIX_CHARS = 24
SMALL_GROUP_ROWS = 64
SMALL_GROUP_BYTES = 1 << 20


def normalised(text: Column) -> Column:
    """Runs of space, tab and line breaks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _hot_texts(texts: DataFrame, partitions: int) -> DataFrame:
    """(text_sha256, salts) of the texts whose copies need more than one run: 8 per partition at most."""
    copies = stage(
        texts.groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("norm")).alias("bytes"))
        .where("rows > 1"),
        "copies",
    )
    total = copies.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    rows = max(SMALL_GROUP_ROWS, (total["rows"] or 0) / (4 * partitions))
    size = max(SMALL_GROUP_BYTES, (total["bytes"] or 0) / (4 * partitions))
    salts = F.ceil(F.greatest(F.col("rows") / rows, F.col("bytes") / size)).cast("int")
    return copies.select("text_sha256", salts.alias("salts")).where("salts > 1")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Other columns of ``docs`` are not read, whatever their names. A null text
    is an empty one. Exactly one row of each group is kept: the one with the
    smallest id; of rows that repeat it, any one. Null ids come after all others,
    so a group has a null ``keep_id`` only if all its ids are null. An
    empty table gives an empty result.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm")).withColumn(
        "text_sha256", F.sha2(F.col("norm").cast("binary"), 256)
    )
    hot = _hot_texts(texts, partitions)
    spread = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("salts"))
    keyed = (
        texts.join(F.broadcast(hot), "text_sha256", "left")
        .withColumn("prefix", F.substring("norm", 1, PREFIX_CHARS))
        .withColumn("salt", F.coalesce(spread, F.lit(-1)))
    )
    run = Window.partitionBy("prefix", "text_sha256", "salt", "norm").orderBy(F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    compared = (
        # Range partitions keep equal (prefix, text_sha256, salt) together: the window needs no second exchange.
        keyed.repartitionByRange("prefix", "text_sha256", "salt")
        .withColumn("first_id", F.first("doc_id").over(whole))
        .withColumn("run_size", F.count(F.lit(1)).over(whole))
        .withColumn("leads", F.row_number().over(run) == 1)
        .select("doc_id", "text_sha256", "salt", "first_id", "run_size", "leads")
    )
    runs = stage(compared, "runs")
    best = F.min(F.struct(F.col("first_id").isNull(), "first_id", "salt"))
    joined = (
        runs.where("leads AND salt >= 0")
        .groupBy("text_sha256")
        .agg(best.alias("best"), F.sum("run_size").alias("rows"))
    )
    return runs.join(F.broadcast(joined), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("salt") < 0, F.col("first_id")).otherwise(F.col("best.first_id")).alias("keep_id"),
        F.coalesce("rows", "run_size").alias("group_size"),
        (F.col("leads") & ((F.col("salt") < 0) | (F.col("salt") == F.col("best.salt")))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW g AS (PARTITION BY norm)
"""
