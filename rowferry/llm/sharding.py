"""Shards by a K-d tree over document metadata.

The rows are points in a space of metadata dimensions. A node that is to become
k shards is cut along its widest dimension at the weighted quantile
floor(k / 2) / k of its bytes (the median for even k), until every node is one shard. The
number of shards follows from the target bytes, or is given.

All statistics cover all rows and are distributed: each round is one
aggregation with map-side combine whose result has at most shards x 8192
rows. The quantile is found by refining histograms, 13 bits of the coordinate
per round, until a cut is within a thousandth of a shard; no sample is taken. The rows themselves
never move while the tree grows: each level writes the slim table of sizes and
coordinates (no texts) once more, with the node each row has come to.

Ties: a coordinate is the value (16 bits), a hash of row and text (24 bits) and of
the row's place (12 bits), so that a cut can go through any group of equal values, also
through copies of one row that hold a third of all bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

ROW_OVERHEAD = 16
VALUE_BITS, HASH_BITS, PLACE_BITS = 16, 24, 12
TIE_BITS = HASH_BITS + PLACE_BITS
COORDINATE_BITS = VALUE_BITS + TIE_BITS
STEP_BITS = 13
TOLERANCE = 1 / 1000  # of a shard's bytes: how far a cut may be off
_PLACE = 33  # monotonically_increasing_id: partition number above, row number below


@dataclass(frozen=True)
class Node:
    """A part of the space that becomes ``shards`` shards from ``first`` on."""

    first: int
    shards: int


def _scaled(value: Column, low, high) -> Column:
    top = (1 << VALUE_BITS) - 1
    if low is None or high is None or high <= low:
        return F.lit(0)
    return F.coalesce(F.floor((value - low) / (high - low) * top), F.lit(0)).cast("bigint")


def metadata_points(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """(doc_id, size, text_crc32, place, c0..) staged, and the names of the coordinates.

    Dimensions: id (documents are numbered as they came in), language and source (by
    hash: they have no order). Not the length: that would put the longest documents
    into nodes of their own, which can't be cut evenly.
    """
    names = {c.lower() for c in docs.columns}
    words = [F.col(c).cast("string") if c in names else F.lit(None).cast("string") for c in ("lang", "source")]
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        words[0].alias("lang"),
        words[1].alias("source"),
        F.monotonically_increasing_id().alias("place"),
    )
    points = stage(slim, "points")
    low_id, high_id = points.agg(F.min("doc_id"), F.max("doc_id")).first()
    mask = (1 << VALUE_BITS) - 1
    values = [
        _scaled(F.col("doc_id").cast("double"), low_id, high_id),
        *(F.coalesce(F.crc32(F.col(c).cast("binary")).bitwiseAND(F.lit(mask)), F.lit(0)) for c in ("lang", "source")),
    ]
    row = F.xxhash64("doc_id", "text_crc32").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    place = F.xxhash64("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    tie = F.shiftleft(row, PLACE_BITS) + place
    coordinates = [(F.shiftleft(v.cast("bigint"), TIE_BITS) + tie).alias(f"c{i}") for i, v in enumerate(values)]
    return stage(points.select("doc_id", "size", "text_crc32", "place", *coordinates), "coordinates"), [f"c{i}" for i in range(len(values))]


def _numbers(values: list[int]) -> Column:
    """An array literal: one value per node, looked up by the node's number."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _of_node(values: list[int]) -> Column:
    return F.element_at(_numbers(values), F.col("node") + 1)


def _widest(points: DataFrame, names: list[str]) -> dict[int, tuple[int, int]]:
    """node -> (its widest dimension, its bytes)."""
    facts = points.groupBy("node").agg(
        F.sum("size").alias("bytes"),
        *((F.max(F.shiftright(c, TIE_BITS)) - F.min(F.shiftright(c, TIE_BITS))).alias(f"w_{c}") for c in names),
    )
    found = {}
    for row in facts.collect():  # one row per node
        widths = [row[f"w_{c}"] for c in names]
        found[row["node"]] = (widths.index(max(widths)), row["bytes"])
    return found


def _cuts(points: DataFrame, nodes: list[Node], names: list[str], axes: dict[int, tuple[int, int]]) -> dict[int, int]:
    """node -> the coordinate whose left side comes closest to the wanted share of the node's bytes.

    The goal is kept as an integer, ``shards`` times the wanted bytes, so no round loses a part of it.
    """
    goal = {i: axes[i][1] * (nodes[i].shards // 2) for i in axes}
    near = {i: TOLERANCE * axes[i][1] / nodes[i].shards for i in axes}
    before = dict.fromkeys(axes, 0)  # bytes left of the interval that holds the cut
    start = dict.fromkeys(axes, 0)  # first coordinate of that interval
    axis = [axes[i][0] + 1 if i in axes else 1 for i in range(len(nodes))]
    on_axis = points.select("node", "size", F.element_at(F.array(*names), _of_node(axis).cast("int")).alias("x"))
    shift, cuts = COORDINATE_BITS, {}
    while open_nodes := [i for i in axes if i not in cuts]:
        width, shift = shift, max(0, shift - STEP_BITS)
        # Outside of the open nodes no coordinate is in the interval.
        low = _of_node([start[i] if i in open_nodes else -(1 << width) for i in range(len(nodes))])
        bins = (
            on_axis.where((F.col("x") >= low) & (F.col("x") < low + (1 << width)))
            .groupBy("node", F.shiftright("x", shift).alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        )
        running = bins.withColumn("through", F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")))
        # The bin in which the goal is reached: the least bytes from its interval on, rounded up. The interval holds them.
        needed = {i: goal[i] - before[i] * nodes[i].shards for i in open_nodes}
        target = _of_node([-(-needed[i] // nodes[i].shards) if i in needed else 0 for i in range(len(nodes))])
        reached = running.where(F.col("through") >= target).groupBy("node").agg(
            F.min_by(F.struct("bin", "bytes", "rows", "through"), "bin").alias("hit")
        )
        hits = {row["node"]: row["hit"] for row in reached.collect()}  # one row per node
        for i in open_nodes:
            hit = hits[i]
            left = before[i] + hit["through"] - hit["bytes"]
            if shift == 0 or hit["rows"] == 1 or hit["bytes"] <= near[i]:
                off = left * nodes[i].shards - goal[i]
                with_it = abs(off + hit["bytes"] * nodes[i].shards) <= abs(off)
                cuts[i] = (hit["bin"] + (1 if with_it else 0)) << shift
            else:
                before[i], start[i] = left, hit["bin"] << shift
    return cuts


def kd_tree(points: DataFrame, names: list[str], shards: int) -> tuple[DataFrame, list[Node]]:
    """The points with the number of their leaf as ``node``, and the leaves, one per shard."""
    leaves = [Node(0, shards)]
    points = points.withColumn("node", F.lit(0))
    while any(node.shards > 1 for node in leaves):
        axes = {i: x for i, x in _widest(points, names).items() if leaves[i].shards > 1}
        cuts = _cuts(points, leaves, names, axes)
        grown, moved = [], []
        for node in leaves:
            moved.append(len(grown))
            half = node.shards // 2
            grown += [Node(node.first, half), Node(node.first + half, node.shards - half)] if half else [node]
        # A leaf that stays, or has no rows, is cut behind its last coordinate.
        axis = [axes[i][0] + 1 if i in axes else 1 for i in range(len(leaves))]
        cut = [cuts.get(i, 1 << COORDINATE_BITS) for i in range(len(leaves))]
        right = F.element_at(F.array(*names), _of_node(axis).cast("int")) >= _of_node(cut)
        # Staged: as an expression, a row's node would be copied into every use of it at the next level.
        points = stage(points.withColumn("node", (_of_node(moved) + right.cast("int")).cast("int")), "nodes")
        leaves = grown
    return points, leaves


def _slots(assigned: DataFrame) -> DataFrame:
    """A gapless ``slot`` per shard. Shards are cut into range partitions as large as any other:
    only one row per partition and shard is gathered to tell how many rows lie before it."""
    ranged = assigned.repartitionByRange("shard", "order", "place").sortWithinPartitions("shard", "order", "place")
    numbered = stage(
        ranged.withColumn("_id", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("_id", _PLACE))
        .withColumn("row", F.col("_id").bitwiseAND(F.lit((1 << _PLACE) - 1)))
        .drop("_id", "order", "place"),
        "slots",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        numbered.groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("lowest"))
        .select("shard", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("lowest")).alias("shift"))
    )
    # Partitions + shards rows at most.
    joined = numbered.join(F.broadcast(pieces), ["shard", "part"])
    return joined.withColumn("slot", (F.col("row") + F.col("shift")).cast("bigint")).drop("part", "row", "shift")


def shard_documents(
    docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Give ``shards``, or ``target_bytes`` per shard. ``size`` is the text's UTF-8 bytes
    (null: none) plus 16. Law ``bytes``: shard sizes are equal up to about one document.
    Equal texts are not kept together: a group may be larger than a shard. Null metadata
    counts as the lowest value; missing ``lang`` and ``source`` columns as null; other columns
    are not read. A table of fewer rows than shards leaves shards empty; an empty
    table gives an empty result.
    """
    points, names = metadata_points(docs, doc_id, text)
    if shards is None:
        if not target_bytes:
            raise ValueError("give target_bytes or shards")
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    points, leaves = kd_tree(points, names, shards)
    shard = _of_node([node.first for node in leaves]).cast("int")
    assigned = points.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.col(names[0]).alias("order"), "place")
    return _slots(assigned).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """The documents as parquet, one folder ``shard=n`` each. Ids must be unique here."""
    places = assignment.select(F.col("doc_id").alias(doc_id), "shard", "slot")
    ranged = docs.join(places, doc_id).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.partitionBy("shard").parquet(path)
