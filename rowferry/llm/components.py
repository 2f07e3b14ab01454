"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _state(pairs: DataFrame):
    return pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    lowest = pairs.groupBy("a").agg(F.min("b").alias("m"))
    smaller = pairs.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(lowest.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes but the smallest of each component, from links (u, v) in any order.

    The minimum per node is combined before the shuffle, and the join with it may be split,
    so a node with very many links is no hot spot. Both stars of a round are written to the shared folder;
    the driver sees one row per round. Links with a null end and loops are left out.
    """
    pairs = stage(
        links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(),
        "links",
    )
    state = _state(pairs)
    while state[0]:
        # Each star is a short plan of its own: planned as one, the driver takes several times the memory.
        pairs = stage(_small_star(stage(_large_star(pairs), "links")), "links")
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
