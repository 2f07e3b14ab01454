"""The best use of proposed pairs: every source and every destination once, with the greatest total confidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

# Confidences count in so many steps.
STEPS = 1_000_000
# A mapping of at most so many pairs is settled inside one task.
TASK_PAIRS = 1 << 20
# About so many pairs of small mappings bid in the same rounds of a task.
BLOCK_PAIRS = 1 << 14
# Each phase divides the least raise of a bid by this.
FINER = 8


def assigned_pairs(pairs: DataFrame, owner: str = "mapping_id", steps: int = STEPS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Of (owner, source_field, destination_field, confidence) the pairs of a best assignment, in the same columns.

    Each name is used once at most and the total confidence of a mapping is the greatest possible, counted
    in ``steps``; of the assignments that reach it, it is one with the most pairs. A pair without a
    confidence above half a step adds nothing and is left out, as are nulls and NaN; above 1 counts as 1. Of a repeated
    pair the greatest confidence counts. A null owner is a mapping like others; nulls among the names are left out.

    The method is an auction: sources bid for destinations, each raising the price of what it likes best by as
    much as it likes it better than the second, and who is outbid bids again. To let names stay
    without a partner, the pairs are doubled: a mirrored copy has the sides exchanged, and each name may take
    its own mirror image for nothing. With whole weights times (names + 1) and a last raise of 1 the outcome is exact.
    Small mappings bid in blocks of about ``BLOCK_PAIRS`` pairs inside tasks; one of more than ``task_pairs`` pairs, which is more than a task should
    hold, runs the same rounds as joins.
    """
    names = [owner, "source_field", "destination_field"]
    confidence = F.least(F.col("confidence").cast("double"), F.lit(1.0))
    weighed = (
        pairs.where("source_field IS NOT NULL AND destination_field IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(double(confidence))")
        .select(*names, "confidence", F.round(confidence * steps).cast("long").alias("w"))
        .where(F.col("w") > 0)
        .groupBy(*names).agg(F.max("confidence").alias("confidence"), F.max("w").alias("w"))
    )
    # Used three times: as edges of either kind and for the confidences of what is chosen.
    weighed = stage(weighed, "pairs")
    counts = weighed.groupBy(owner).agg(
        F.count("*").alias("_pairs"), (F.count_distinct("source_field") + F.count_distinct("destination_field")).alias("_names")
    )
    sized = weighed.alias("w").join(counts.alias("c"), F.col(f"w.{owner}").eqNullSafe(F.col(f"c.{owner}"))).select("w.*", "_pairs", "_names")
    # A step outweighs any number of pairs; each pair counts one besides.
    weight = ((F.col("w") * F.col("_names") + 1) * (F.col("_names") + 1)).alias("weight")
    sized = sized.select(*names, "confidence", weight, _owner_key(owner), "_pairs")
    small, large = sized.where(F.col("_pairs") <= task_pairs).drop("_pairs"), sized.where(F.col("_pairs") > task_pairs).drop("_pairs")
    blocks = weighed.count() // BLOCK_PAIRS + 1
    chosen = small.groupBy(F.pmod(F.xxhash64("_owner"), F.lit(blocks))).applyInArrow(_settle, small.drop("weight", "_owner").schema)
    return chosen if large.isEmpty() else chosen.union(_settle_by_joins(large))


def _owner_key(owner: str) -> Column:
    """A text key, so that a null owner joins like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("_owner")


def _settle(pairs: pa.Table) -> pa.Table:
    """The chosen pairs of some mappings."""
    frame = pairs.select(["_owner", "source_field", "destination_field", "weight"]).to_pandas()
    source = frame.groupby(["_owner", "source_field"]).ngroup().to_numpy()
    destination = frame.groupby(["_owner", "destination_field"]).ngroup().to_numpy()
    weight, s, d = frame["weight"].to_numpy(), source.max() + 1, destination.max() + 1
    # Bidders: sources, then mirrored destinations. Things: destinations, then mirrored sources.
    own_source, own_destination = np.arange(s), np.arange(d)
    bidder = np.concatenate([source, s + destination, own_source, s + own_destination])
    thing = np.concatenate([destination, d + source, d + own_source, own_destination])
    worth = np.concatenate([weight, weight, np.zeros(s + d, dtype=np.int64)])
    order = np.lexsort((thing, bidder))
    gets = auction(bidder[order], thing[order], worth[order])
    return pairs.filter(pa.array(gets[source] == destination)).drop_columns(["weight", "_owner"])


def auction(bidder: np.ndarray, thing: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The thing each bidder gets; the rows are sorted by bidder, each of whom knows two things or more."""
    bidders, things = bidder[-1] + 1, thing.max() + 1
    price = np.zeros(things, dtype=np.int64)
    raise_ = max(int(worth.max()) // 4, 1)
    while True:
        gets, holder = np.full(bidders, -1), np.full(things, -1)
        while (free := gets < 0).any():
            rows = np.flatnonzero(free[bidder])
            who, what = bidder[rows], thing[rows]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            value = worth[rows] - price[what]
            best = np.maximum.reduceat(value, first)
            likes = np.flatnonzero(value == np.repeat(best, np.diff(first, append=len(rows))))
            likes = likes[np.diff(who[likes], prepend=-1) != 0]
            value[likes] = np.iinfo(np.int64).min
            bid = price[what[likes]] + best - np.maximum.reduceat(value, first) + raise_
            # The highest bid for each thing; of equal ones that of the first bidder.
            order = np.lexsort((who[likes], -bid, what[likes]))
            won = likes[order][np.diff(what[likes][order], prepend=-1) != 0]
            price[what[won]] = bid[np.searchsorted(likes, won)]
            outbid = holder[what[won]]
            gets[outbid[outbid >= 0]] = -1
            holder[what[won]], gets[who[won]] = who[won], what[won]
        if raise_ == 1:
            return gets
        raise_ = max(raise_ // FINER, 1)


def _settle_by_joins(pairs: DataFrame) -> DataFrame:
    """The chosen pairs of large mappings; all of them bid in the same rounds, each round is staged."""
    source, destination = F.col("source_field"), F.col("destination_field")

    def node(kind: str, name: Column) -> Column:
        return F.concat(F.lit(kind), name)

    edges = pairs.select(
        "_owner",
        F.inline(
            F.array(
                *[
                    F.struct(node(a, x).alias("bidder"), node(b, y).alias("thing"), w.alias("worth"))
                    for a, x, b, y, w in (
                        ("s", source, "d", destination, F.col("weight")),
                        ("d", destination, "s", source, F.col("weight")),
                        ("s", source, "s", source, F.lit(0).cast("long")),
                        ("d", destination, "d", destination, F.lit(0).cast("long")),
                    )
                ]
            )
        ),
    ).groupBy("_owner", "bidder", "thing").agg(F.max("worth").alias("worth"))
    edges = stage(edges, "auction-edges")
    bidders = edges.select("_owner", "bidder").distinct()
    held = edges.select("_owner", "thing", F.lit(0).cast("long").alias("price"), F.lit(None).cast("string").alias("bidder")).where(F.lit(False))
    best_first = Window.partitionBy("_owner", "bidder").orderBy(F.desc("value"), "thing")
    raise_ = max(edges.agg(F.max("worth")).first()[0] // 4, 1)
    while True:
        held = held.withColumn("bidder", F.lit(None).cast("string"))
        while not (free := bidders.join(held.where("bidder IS NOT NULL"), ["_owner", "bidder"], "left_anti")).isEmpty():
            offers = (
                edges.join(free, ["_owner", "bidder"], "left_semi")
                .join(held.select("_owner", "thing", "price"), ["_owner", "thing"], "left")
                .withColumn("value", F.col("worth") - F.coalesce("price", F.lit(0)))
                # Two rows of a bidder leave a task.
                .withColumn("n", F.row_number().over(best_first)).where("n <= 2")
                .groupBy("_owner", "bidder")
                .agg(
                    F.max(F.when(F.col("n") == 1, F.col("thing"))).alias("thing"),
                    (F.max(F.when(F.col("n") == 1, F.col("worth"))) - F.max(F.when(F.col("n") == 2, F.col("value"))) + raise_).alias("price"),
                )
            )
            won = offers.groupBy("_owner", "thing").agg(F.max(F.struct("price", "bidder")).alias("b")).select("_owner", "thing", "b.*")
            held = stage(
                held.withColumn("round", F.lit(0)).union(won.withColumn("round", F.lit(1)))
                .groupBy("_owner", "thing").agg(F.max_by(F.struct("price", "bidder"), "round").alias("b")).select("_owner", "thing", "b.*"),
                "auction-round",
            )
        if raise_ == 1:
            break
        raise_ = max(raise_ // FINER, 1)
    taken = held.select("_owner", F.col("bidder").alias("_source"), F.col("thing").alias("_destination"))
    marked = pairs.select("*", node("s", source).alias("_source"), node("d", destination).alias("_destination"))
    return marked.join(taken, ["_owner", "_source", "_destination"], "left_semi").select(*[c for c in pairs.columns if c not in ("weight", "_owner")])
