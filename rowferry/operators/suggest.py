"""Checking and proposing pairs of source column and destination field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: pairs below this confidence are shown but not applied.
APPLY_FROM = 0.5


def validate_pairs(pairs: DataFrame, source_columns: DataFrame, destination_fields: DataFrame, owner: str = "mapping_id") -> DataFrame:
    """Pairs whose names both exist; of a destination used twice the first pair stays.

    ``pairs`` has (owner, pos, source_field, destination_field, confidence);
    the name tables have (owner, source_field) and (owner, destination_field).
    """
    known = pairs.join(source_columns.select(owner, "source_field"), [owner, "source_field"], "left_semi").join(
        destination_fields.select(owner, "destination_field"), [owner, "destination_field"], "left_semi"
    )
    # min_by combines before the shuffle; a window would not.
    return (
        known.groupBy(owner, "destination_field")
        .agg(F.min_by(F.struct("source_field", "confidence"), "pos").alias("p"), F.min("pos").alias("pos"))
        .select(owner, "pos", F.col("p.source_field"), "destination_field", F.col("p.confidence"))
    )


def pairs_to_apply(pairs: DataFrame, current: DataFrame, owner: str = "mapping_id", threshold: float = APPLY_FROM) -> DataFrame:
    """Pairs that are sure enough and not already in the mapping."""
    return pairs.where(F.col("confidence") >= threshold).join(
        current.select(owner, "source_field", "destination_field"), [owner, "source_field", "destination_field"], "left_anti"
    )


def _tokens(name: Column) -> Column:
    """Lower-case words of a name: camelCase, digits and punctuation separate them."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^\p{L}0-9]+"), lambda t: t != ""))


def _keys(name: Column) -> Column:
    """What a name can be matched by, best first: same spelling, same letters,
    same words in any order, one common word."""
    words = _tokens(name)
    tier = lambda n, k: F.struct(F.lit(n).alias("tier"), k.alias("key"))
    return F.concat(
        F.array(
            tier(0, F.lower(name)),
            tier(1, F.array_join(words, "")),
            tier(2, F.array_join(F.array_sort(words), " ")),
        ),
        F.transform(words, lambda w: tier(3, w)),
    )


def suggest_by_name(source_columns: DataFrame, destination_fields: DataFrame, owner: str = "mapping_id") -> DataFrame:
    """For each destination field the source column whose name fits best.

    Inputs: (owner, source_field, pos) and (owner, destination_field, pos).
    Confidence: 1.0 same spelling, 0.9 same letters, 0.8 same words, and for
    one common word 0.5 + 0.2 times the overlap that word alone makes.

    No pair of names is ever compared. Both sides are turned into match keys;
    per key only the best source column is kept (the earliest, but for a common
    word the one with the fewest words, since that makes the largest overlap), so the join has one partner per key at most and a
    word that occurs everywhere costs no more than a rare one.
    """
    words = F.size(_tokens(F.col("source_field")))
    offered = (
        source_columns.select(owner, "source_field", "pos", words.alias("n"), F.inline_outer(_keys(F.col("source_field"))))
        .groupBy(owner, "tier", "key")
        .agg(F.min(F.struct(F.when(F.col("tier") == 3, F.col("n")).otherwise(0).alias("n"), "pos", "source_field")).alias("s"))
    )
    wanted = destination_fields.select(
        owner,
        "destination_field",
        F.size(_tokens(F.col("destination_field"))).alias("m"),
        F.inline_outer(_keys(F.col("destination_field"))),
    ).where(F.col("key") != "")
    overlap = F.lit(1.0) / (F.col("s.n") + F.col("m") - 1)
    confidence = (
        F.when(F.col("tier") == 0, 1.0)
        .when(F.col("tier") == 1, 0.9)
        .when(F.col("tier") == 2, 0.8)
        .otherwise(F.lit(0.5) + F.lit(0.2) * overlap)
    )
    best = F.max_by(F.struct("source_field", "confidence"), F.struct("confidence", (-F.col("pos")).alias("p")))
    return (
        wanted.join(offered, [owner, "tier", "key"])
        .select(owner, "destination_field", F.col("s.source_field"), F.col("s.pos"), confidence.alias("confidence"))
        .groupBy(owner, "destination_field")
        .agg(best.alias("b"))
        .select(owner, F.col("b.source_field"), "destination_field", F.col("b.confidence"))
    )
