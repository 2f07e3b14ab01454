"""MinHash near-dedup with sequential Bayesian verification.

1. Tasks turn each text into its shingle set and a signature of 128 minima. Documents with
   equal sets are one class from here on, so copies are never compared.
2. Signatures are cut into 32 bands of 4. Documents that agree in a band are
   candidates. Each bucket only links its members to its smallest one; the components of these
   links are clusters outside of which no document has a candidate.
3. Candidates are compared inside tasks, never as rows of pairs. A cluster (or,
   where that moves less, each of its buckets) is dealt as pairs of blocks of bounded
   rows and bytes; a task compares two blocks at a time.
4. Signatures are compared 32 minima at a time. After each batch, pairs are dropped whose
   posterior probability to reach the similarity is below ``MISS``; what is left is counted on the
   full sets. A task returns a spanning forest of the links it found.
5. The components of the links are the groups.

At similarity 0.85 a pair has no band in common with probability 6e-11; pairs dropped by
the bounds reach it with less than 1e-9 each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .shingles import Shingler, mixed

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32  # minima per comparison
MISS = 1e-9
BLOCK_ROWS = 512
BLOCK_BYTES = 4 << 20
PAIRS_AT_ONCE = 1 << 16

_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set under ``HASHES`` hash functions."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(keys), 4096):
        low = np.minimum(low, (keys[at : at + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(signatures, bands): one 64-bit bucket per band."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For 32, 64, .. compared minima: the fewest matches with which the similarity is still likely enough.

    With a uniform prior, P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


_SIGNED = "doc_id bigint, n_shingles bigint, set_low bigint, set_high bigint, bytes bigint, signature binary"


def _signed(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """Per row: the size and a 128-bit key of its set, and its signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, names = Shingler(words), [field.split()[0] for field in _SIGNED.split(", ")]
        for batch in batches:
            rows = []
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingler(value)
                rows.append((ident, len(found), *_set_key(found), found.nbytes, signature(found).tobytes()))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    columns = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return stage(columns.mapInArrow(run, _SIGNED), "signatures")


def _banded(classes: DataFrame) -> DataFrame:
    """(class, bytes, bucket), one row per band. The buckets are many, and kept nowhere."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            own = [pa.array(np.repeat(batch.column(i).to_numpy(), BANDS)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(band_keys(low).ravel())], ["class", "bytes", "bucket"])

    return classes.select("class", "bytes", "signature").mapInArrow(run, "class bigint, bytes bigint, bucket bigint")


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    key = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def _sets(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(class, set_low, set_high, shingles) of the wanted classes, computed once more from their texts.

    A task gives each set of an id once, however often rows repeat it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            rows = []
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingler(value)
                key = (ident, *_set_key(found))
                if key not in seen:
                    seen.add(key)
                    rows.append((*key, found.tobytes()))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["class", "set_low", "set_high", "shingles"])

    columns = docs.select(F.col(doc_id).cast("bigint").alias("class"), F.col(text).alias("text"))
    schema = "class bigint, set_low bigint, set_high bigint, shingles binary"
    return columns.join(wanted, "class", "left_semi").mapInArrow(run, schema)


def _units(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(unit, i, j, side, class): which two blocks of which unit a member is compared in.

    A unit is a whole cluster, or one bucket of a cluster whose buckets together move fewer rows.
    """
    blocks = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    total = (F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("size"))
    inside = members.join(clusters.select("class", "cluster"), "class")
    buckets = inside.groupBy("cluster", "bucket").agg(*total).withColumn("blocks", blocks(F.col("rows"), F.col("size")))
    by_bucket = buckets.groupBy("cluster").agg(F.sum(F.col("rows") * F.col("blocks")).alias("moved"))
    whole = clusters.groupBy("cluster").agg(*total).withColumn("blocks", blocks(F.col("rows"), F.col("size")))
    choice = whole.join(by_bucket, "cluster").select(
        "cluster", "blocks", (F.col("rows") * F.col("blocks") <= F.col("moved")).alias("whole")
    )
    as_cluster = clusters.join(choice.where("whole"), "cluster").select(
        F.lit(0).alias("kind"), F.col("cluster").alias("unit"), "blocks", "class"
    )
    split = buckets.drop("rows", "size").join(choice.where("NOT whole").select("cluster"), "cluster", "left_semi")
    as_bucket = inside.select("bucket", "class").join(split.select("bucket", "blocks"), "bucket").select(
        F.lit(1).alias("kind"), F.col("bucket").alias("unit"), "blocks", "class"
    )
    dealt = as_cluster.union(as_bucket).withColumn("side", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(
        "kind", "unit", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "class"
    )


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right]."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one set only is in no intersection
    rows, column = rows[shared], column[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], np.unique(column[order], return_inverse=True)[1]
    out, width = np.zeros((len(sets), len(sets)), dtype=np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[rows[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out[left, right].astype(np.int64)


def _linked(ids: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int):
    """The pairs (of positions) that are links: by batches of the signatures, survivors on the sets."""
    if not len(left):  # a block of one row, or a pair of blocks of which one is empty
        return left, right
    limits, keep = least_matches(percent), []
    for at in range(0, len(left), PAIRS_AT_ONCE):
        a, b = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
        matches = np.zeros(len(a), dtype=np.int64)
        for k, limit in enumerate(limits):
            columns = slice(k * BATCH, (k + 1) * BATCH)
            matches += (signatures[a, columns] == signatures[b, columns]).sum(axis=1)
            likely = matches >= limit
            a, b, matches = a[likely], b[likely], matches[likely]
        keep.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*keep))
    if not len(a):
        return a, b
    used, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    common = _common([sets[i] for i in used], where[: len(a)], where[len(a) :])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    yes = 100 * common >= percent * (sizes[a] + sizes[b] - common)
    return a[yes], b[yes]


def _forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links from each linked id to the smallest id it is connected with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(ids[left].tolist(), ids[right].tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(find(x), x) for x in list(root) if find(x) != x]


def _compare(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v): forests of the links within each pair of blocks; rows come sorted by pair of blocks."""

    def groups(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[:4] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[:4], []
                rows.append(row[4:])
        if rows:
            yield key, rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), rows in groups(batches):
            ids = np.array([row[1] for row in rows], dtype=np.int64)
            side = np.array([row[0] for row in rows])
            signatures = np.stack([np.frombuffer(row[2], dtype=np.uint32) for row in rows])
            sets = [np.frombuffer(row[3], dtype=np.uint64) for row in rows]
            if i == j:
                left, right = np.triu_indices(len(rows), 1)
            else:
                left, right = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == i), np.flatnonzero(side == j)))
            if not len(left):
                continue
            links = _forest(ids, *_linked(ids, signatures, sets, left, right, percent))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"])

    key = ["kind", "unit", "i", "j"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key).select(*key, "side", "class", "signature", "shingles")
    return ordered.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingles of
    ``words`` words; ``component_id`` is the smallest id that links lead to. Null and empty texts have no
    shingles and no links. Rows with a null id are not linked either: their component is null
    and they are kept. Rows that repeat an id count as documents of their own under that id; all
    that carry the component's id are kept. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = _signed(docs, words, doc_id, text)
    own = F.min(F.struct("doc_id", "bytes", "signature"))
    classes = stage(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_low", "set_high").agg(own.alias("first"))
        .select(F.col("first.doc_id").alias("class"), "first.bytes", "first.signature", "set_low", "set_high"),
        "classes",
    )
    banded = _banded(classes)
    shared = banded.groupBy("bucket").agg(F.min("class").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(banded.join(shared.select("bucket", "pivot"), "bucket"), "members")
    stars = components(members.select(F.col("pivot").alias("u"), F.col("class").alias("v")))
    candidates = members.groupBy("class").agg(F.max("bytes").alias("bytes"))
    clusters = stage(
        candidates.join(stars, F.col("class") == F.col("node"), "left")
        .select("class", "bytes", F.coalesce("component", "class").alias("cluster")),
        "clusters",
    )
    signed = classes.select("class", "set_low", "set_high", "signature").join(candidates.select("class"), "class", "left_semi")
    full = _sets(docs, candidates.select("class"), words, doc_id, text)
    # Staged, since one plan of all this takes much of the driver's memory; sets come last, they are large.
    units = stage(_units(members, clusters), "units")
    links = _compare(units.join(signed, "class").join(full, ["class", "set_low", "set_high"]), percent)
    groups = components(links)
    named = classes.select("set_low", "set_high", "class").join(groups, F.col("class") == F.col("node"), "left")
    named = named.select("set_low", "set_high", F.coalesce("component", "class").alias("component"))
    placed = rows.select("doc_id", "n_shingles", "set_low", "set_high").join(named, ["set_low", "set_high"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
