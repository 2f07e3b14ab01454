"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Index. Equal vectors are one node that knows its k + 1 smallest ids, so copies
don't crowd the graph. Seed neighbours come from cells between random planes, in which all
pairs of a leaf of bounded size are compared. Each round of NN-descent then joins every node with the neighbours
of its neighbours (both directions, a bounded sample of the incoming ones): a hub's members are
compared in the task that holds the hub, and only pairs that improve a member's list leave
it. Lists hold ``NEIGHBOURS`` nodes. All rows are indexed.

Search. Each query keeps the ``BEAM`` nearest nodes seen; a step opens the nearest unopened
ones and looks at their neighbours, until nothing in the beam is left to open. Queries that are
nodes begin at themselves, others at the nearest of ``ENTRIES`` fixed nodes.

The graph is built on exact copies. To choose pairs, vectors are taken from the middle of their leaf or
hub, so near copies far from the origin keep their distances apart; pairs that are chosen, and
all distances that are returned, are measured directly in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from ..session import stage

NEIGHBOURS = 32
INCOMING = 20
SEEDINGS = 2
BLOCK = 8192  # nodes of a cell that a task holds at a time
LEAF = 2048
IMPROVED = 8  # pairs a hub passes on per member
ROUNDS = 4
LITTLE_CHANGE = 0.02  # of the list entries: the descent ends
BEAM = 320
OPENED = 64  # nodes a query opens per step
ENTRIES = 64


@dataclass(frozen=True)
class Index:
    """nodes: (node, vec, members); graph: (node, others), both directions; entries: a few nodes with vectors."""

    nodes: DataFrame
    graph: DataFrame
    entries: list[tuple[int, list[float]]]
    dimension: int


def _distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: with an id, and a vector that is not null, empty or zero and has
    finite components only. Of rows that repeat an id the smallest vector counts."""
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _nodes(rows: DataFrame, keep: int) -> DataFrame:
    """(node, vec, members): one row per distinct vector with its ``keep`` smallest ids; the first names it.

    The rank limit cuts a vector that very many rows share before the shuffle.
    """
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= keep)
    grouped = ranked.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    return stage(grouped.select(F.col("members")[0].alias("node"), "vec", "members"), "nodes")


def _matrix(column: pa.Array, kind, dimension: int) -> np.ndarray:
    """Binary rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dimension)


def _kind(nodes: DataFrame):
    """The numpy type that holds the vectors as they are."""
    return np.float32 if isinstance(nodes.schema["vec"].dataType.elementType, FloatType) else np.float64


def _projected(nodes: DataFrame, dimension: int, bits: int) -> DataFrame:
    """(node, copy, cell0..): the vectors as bytes, and the cells of the seeds.

    A cell is told by the sides of ``bits`` random planes a vector lies on; the planes go through
    the medians, so cells are about equal. They don't depend on how Spark deals the rows.
    """
    kind = _kind(nodes)
    directions = np.random.default_rng(5).standard_normal((dimension, SEEDINGS * bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            copies = pa.array([row.tobytes() for row in values.astype(kind)], pa.binary())
            along = pa.array((values.astype(np.float64) @ directions).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), copies, along], ["node", "copy", "along"])

    table = stage(nodes.select("node", "vec").mapInArrow(run, "node bigint, copy binary, along array<double>"), "projected")
    middles = table.agg(*(F.percentile_approx(F.col("along")[k], 0.5, 1000) for k in range(SEEDINGS * bits))).first() if bits else []
    cells = []
    for t in range(SEEDINGS):
        cell = F.lit(0).cast("bigint")
        for k in range(bits):
            cell = cell + F.when(F.col("along")[t * bits + k] > F.lit(middles[t * bits + k]), 1 << k).otherwise(0)
        cells.append(cell.alias(f"cell{t}"))
    return table.select("node", "copy", *cells)


def _pairs(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], ["a", "b", "d"])


_PAIRS = "a bigint, b bigint, d double"


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of the last two axes, to choose by."""
    x = x - np.median(x, axis=-2, keepdims=True)
    norms = (x * x).sum(axis=-1)
    return np.maximum(norms[..., :, None] + norms[..., None, :] - 2 * (x @ np.swapaxes(x, -1, -2)), 0)


def _between(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows a and b, from their differences."""
    out = np.empty(len(a))
    for at in range(0, len(a), 8192):
        gap = x[a[at : at + 8192]] - x[b[at : at + 8192]]
        out[at : at + 8192] = np.einsum("ij,ij->i", gap, gap)
    return out


def _leaves(x: np.ndarray, rows: np.ndarray, random) -> Iterator[np.ndarray]:
    """Rows split at medians of random directions until they are few."""
    if len(rows) <= LEAF:
        yield rows
        return
    ends = x[rows[random.integers(0, len(rows), 2)]]
    along = x[rows] @ (ends[0] - ends[1] + 1e-6 * random.standard_normal(x.shape[1]))
    order = np.argsort(along, kind="stable")
    half = len(rows) // 2
    yield from _leaves(x, rows[order[:half]], random)
    yield from _leaves(x, rows[order[half:]], random)


def _seeds(projected: DataFrame, dimension: int, kind) -> DataFrame:
    """Nearest nodes within the leaves of each cell. A cell of more than ``BLOCK`` nodes is dealt in parts."""

    def run(batches: Iterable[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
        def blocks():
            """Whole cells, sorted by (cell, part)."""
            rest = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
                keys = np.stack([rest.column(i).to_numpy() for i in (0, 1)], axis=1)
                ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                begin = 0
                for end in ends:
                    yield rest.slice(begin, end - begin)
                    begin = end
                rest = rest.slice(begin)
            if rest is not None:
                yield rest

        random = np.random.default_rng((7, t))  # other leaves in each seeding, which connect the graph
        for block in blocks():
            ids, x = block.column(2).to_numpy(), _matrix(block.column(3), kind, dimension).astype(np.float64)
            for leaf in _leaves(x, np.arange(len(ids)), random):
                d = _squared(x[leaf])
                np.fill_diagonal(d, np.inf)
                k = min(NEIGHBOURS, len(leaf) - 1)
                if k > 0:
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    a, b = np.repeat(leaf, k), leaf[near].ravel()
                    yield _pairs(ids[a], ids[b], _between(x, a, b))

    out = None
    for t in range(SEEDINGS):
        rows = projected.select("node", "copy", F.col(f"cell{t}").alias("cell"))
        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        dealt = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
        key = ["cell", "part"]
        found = dealt.repartition(*key).sortWithinPartitions(*key).select(*key, "node", "copy").mapInArrow(partial(run, t=t), _PAIRS)
        out = found if out is None else out.union(found)
    return out


def _best(pairs: DataFrame) -> DataFrame:
    """(a, b, d, fresh, rank): the nearest ``NEIGHBOURS`` of each node; ``fresh`` unless it was there before."""
    # Dealt by node once, for both steps.
    dealt = pairs.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return dealt.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS)


def _incoming(edges: DataFrame, *extra: str) -> DataFrame:
    """(a, b, ..) of edges b -> a, ``INCOMING`` of them per node at most, by hash; the limit holds before the shuffle."""
    pick = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b"), "a"))
    kept = edges.withColumn("n", pick).where(F.col("n") <= INCOMING)
    return kept.select(F.col("b").alias("a"), F.col("a").alias("b"), *extra)


def _joined(graph: DataFrame, projected: DataFrame, dimension: int, kind) -> DataFrame:
    """Pairs of members of one hub that may improve a member's list."""
    forward = graph.select("a", "b", "fresh")
    members = forward.union(_incoming(forward, "fresh")).groupBy("a", "b").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("a").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n")).select(
        F.col("a").alias("node"), F.when(F.col("n") == NEIGHBOURS, F.col("worst")).alias("worst")
    )
    known = projected.select("node", "copy").join(worst, "node", "left")
    dealt = members.join(known, F.col("b") == F.col("node")).select("a", "b", "fresh", "worst", "copy")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        hub, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
        fresh = table.column(2).to_numpy().astype(bool)
        worst = table.column(3).fill_null(np.inf).to_numpy()
        x = _matrix(table.column(4), kind, dimension).astype(np.float64)
        first = np.flatnonzero(np.concatenate(([True], hub[1:] != hub[:-1])))
        sizes = np.diff(np.append(first, len(hub)))
        for at in range(0, len(first), 256):
            begin, size = first[at : at + 256], sizes[at : at + 256]
            width = int(size.max())
            place = begin[:, None] + np.minimum(np.arange(width), size[:, None] - 1)
            there = np.arange(width) < size[:, None]
            d = _squared(x[place])
            able = there[:, :, None] & there[:, None, :] & (fresh[place][:, :, None] | fresh[place][:, None, :])
            able &= (ids[place][:, :, None] != ids[place][:, None, :]) & (d < worst[place][:, :, None])
            d = np.where(able, d, np.inf)
            k = min(IMPROVED, width)
            near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
            far = np.take_along_axis(d, near, 2)
            group, member, nth = np.nonzero(np.isfinite(far))
            if len(group):
                a, b = place[group, member], place[group, near[group, member, nth]]
                yield _pairs(ids[a], ids[b], _between(x, a, b))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last hub may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            hubs = table.column(0).to_numpy()
            cut = int(np.searchsorted(hubs, hubs[-1])) if len(hubs) else 0
            if cut:
                yield from compare(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield from compare(rest.combine_chunks())

    return dealt.repartition("a").sortWithinPartitions("a").mapInArrow(run, _PAIRS)


def build_index(rows: DataFrame, results: int = 10, dimension: int | None = None) -> Index:
    """The index over the (vec_id, vec) of one dimension, the most frequent one unless it is given."""
    if dimension is None:
        sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
        top = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
        dimension = top[0]["size"] if top else 0
    nodes = _nodes(rows.where(F.size("vec") == dimension), results + 1)
    entries = [tuple(r) for r in nodes.select("node", "vec").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    bits = max(0, (nodes.count() // LEAF).bit_length() - 1)
    kind = _kind(nodes)
    projected = _projected(nodes, dimension, bits)
    fresh, old = F.lit(1).alias("fresh"), F.lit(0).alias("fresh")
    graph = stage(_best(_seeds(projected, dimension, kind).select("a", "b", "d", fresh)), "graph")
    for _ in range(ROUNDS):
        found = _joined(graph, projected, dimension, kind).select("a", "b", "d", fresh)
        graph = stage(_best(graph.select("a", "b", "d", old).union(found)), "graph")
        entered, total = graph.agg(F.sum("fresh"), F.count(F.lit(1))).first()
        if not total or entered < LITTLE_CHANGE * total:
            break
    both = graph.select("a", "b").union(_incoming(graph.select("a", "b")))
    # Bounded: NEIGHBOURS + INCOMING per node.
    lists = both.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("others"))
    return Index(nodes, stage(lists, "lists"), entries, dimension)


def _measured(pairs: DataFrame) -> DataFrame:
    """(query, node, d) of (query, node, goal, vec): squared distances, in batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                goal, vec = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))
                gap = ((goal - vec) ** 2).reshape(batch.num_rows, -1).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gap)], ["query", "node", "d"])

    return pairs.select("query", "node", "goal", "vec").mapInArrow(run, "query bigint, node bigint, d double")


def search(index: Index, queries: DataFrame, results: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for (query, goal, start): the vector to search for and the node to begin at, or null.

    Results are nearest first, ties to the smaller vec_id; a query's own id is no result.
    """
    queries = stage(queries.select("query", "goal", "start"), "queries")
    entries = np.array([vec for _, vec in index.entries], dtype=np.float64).reshape(len(index.entries), index.dimension)
    names = [node for node, _ in index.entries]

    def begin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for query, goal, start in zip(*(column.to_pylist() for column in batch.columns)):
                if start is not None:
                    rows.append((query, start))
                elif names:
                    near = np.argsort(((entries - np.array(goal)) ** 2).sum(axis=1), kind="stable")[:3]
                    rows += [(query, names[i]) for i in near]
            columns = zip(*rows) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "node"])

    goals, vectors = queries.select("query", "goal"), index.nodes.select("node", "vec")
    nearest = Window.partitionBy("query").orderBy("d", "node")
    places = (F.row_number().over(nearest).alias("place"), F.sum(F.col("open").cast("int")).over(nearest).alias("turn"))

    def best(seen: DataFrame) -> DataFrame:
        """The beams; ``turn`` numbers what is still open, nearest first."""
        ranked = seen.select("*", *places).where(F.col("place") <= BEAM)
        return stage(ranked.select("query", "node", "d", "open", "turn"), "beam")

    def measured(pairs: DataFrame) -> DataFrame:
        return _measured(pairs.join(vectors, "node").join(goals, "query")).withColumn("open", F.lit(True))

    beam = best(measured(queries.mapInArrow(begin, "query bigint, node bigint").distinct()))
    while not (turn := beam.where(F.col("open") & (F.col("turn") <= OPENED))).isEmpty():
        around = turn.join(index.graph, "node").select("query", F.explode("others").alias("node")).distinct()
        unseen = around.join(beam.select("query", "node"), ["query", "node"], "left_anti")
        opened = beam.select("query", "node", "d", (F.col("open") & (F.col("turn") > OPENED)).alias("open"))
        beam = best(opened.union(measured(unseen)))
    listed = beam.join(index.nodes, "node").join(goals, "query").select(
        "query", F.explode("members").alias("vec_id"), _distance(F.col("goal"), F.col("vec")).alias("score")
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return (
        listed.where(F.col("vec_id") != F.col("query"))
        .withColumn("rank", rank).where(F.col("rank") <= results)
        .select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
    )


def nearest_neighbours(
    vectors: DataFrame, every: int = 100, results: int = 10, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its nearest other rows.

    Rows that take part: see ``usable``. Vectors of several dimensions are searched apart, each among those of its own, with
    an index per dimension that a query has. Rows of equal vectors are all candidates. With fewer candidates than ``results`` a
    query gets all that the search reaches. Other columns are not read. An empty table gives an empty result.
    """
    rows = stage(usable(vectors, vec_id, embedding), "vectors")
    is_query, size = F.col("vec_id") % every == 0, F.size("vec")
    asked_for = rows.groupBy(size.alias("size")).agg(F.max(is_query).alias("asked")).where("asked")
    out = None
    for dimension in sorted(r["size"] for r in asked_for.collect()) or [0]:
        alike = rows.where(size == dimension)
        index = build_index(alike, results, dimension)
        own = index.nodes.select(F.col("node").alias("start"), "vec")
        queries = alike.where(is_query).join(own, "vec").select(F.col("vec_id").alias("query"), F.col("vec").alias("goal"), "start")
        found = search(index, queries, results)
        out = found if out is None else out.union(found)
    return out
