"""Centroid clustering (Lloyd's rounds) on integer vectors kept as bit planes.

The 64 components of a vector become integers of B bits; bit plane b, one uint64, holds
bit b of all 64. A dot product is then exact and needs no multiplication per component:

    x . c = sum over planes a, b of  weight(a) * weight(b) * popcount(x_a AND c_b)

with weight(b) = 2**b, negative for the sign's plane (two's complement). The squared distance is
x . x + c . c - 2 x . c, all in 64-bit integers.

The packed table (8 * B bytes a vector) is staged once. A round is one pass over it without a
shuffle of vectors: each task adds up its vectors per centroid and sends one row per centroid
(count and 64 sums), so a cluster with most of all rows costs no more than another. The
driver sees k rows per round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

DIMENSION = 64
MAX_BITS = 28  # beyond that a squared distance might not fit into 64 bits
_ROWS = 4096  # vectors a block of distances is made of


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows whose vector has 64 components, none of them null or not finite; vec is in double precision."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where((F.size("vec") == DIMENSION) & finite)


def _scaled(scale: int) -> Column:
    return F.transform("vec", lambda x: F.floor(x * scale).cast("bigint"))


def plane_weights(bits: int) -> np.ndarray:
    weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    weights[-1] = -weights[-1]
    return weights


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Integer rows (n, 64) as bit planes (n, bits) of uint64; component i is bit i of each plane."""
    values = np.ascontiguousarray(values, dtype="<i8")
    out = np.empty((len(values), bits), dtype="<u8")
    for b in range(bits):
        out[:, b] = np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def unpack(planes: np.ndarray) -> np.ndarray:
    """The integers (n, 64) that bit planes (n, bits) stand for."""
    count, bits = planes.shape
    out = np.zeros((count, DIMENSION), dtype=np.int64)
    for b, weight in enumerate(plane_weights(bits)):
        plane = np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(count, 8)
        out += weight * np.unpackbits(plane, axis=1, bitorder="little")
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, k): exact dot products of packed vectors and packed centroids."""
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for a, of_x in enumerate(plane_weights(x.shape[1])):
        row = np.zeros_like(out)
        for b, of_c in enumerate(plane_weights(c.shape[1])):
            row += of_c * np.bitwise_count(x[:, a, None] & c[None, :, b]).astype(np.int64)
        out += of_x * row
    return out


def nearest(x: np.ndarray, norms: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); of equally near ones the smaller number."""
    own = (unpack(c) ** 2).sum(axis=1)
    number, distance = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), _ROWS):
        part = slice(at, at + _ROWS)
        squared = norms[part, None] + own[None, :] - 2 * dots(x[part], c)
        number[part] = squared.argmin(axis=1)
        distance[part] = squared.min(axis=1)
    return number, distance


def _planes(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, bits)


def packed_vectors(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, planes, norm) of the kept vectors, staged, and the number of bits: floor(scale * x) per component."""
    kept = kept_vectors(vectors, vec_id, embedding).select("vec_id", _scaled(scale).alias("vec"))
    low, high = kept.agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    bits = 1 if low is None else max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    if bits > MAX_BITS:
        raise ValueError(f"components need {bits} bits; squared distances fit into 64 bits up to {MAX_BITS}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSION)
            planes = pa.array([row.tobytes() for row in pack(values, bits)], pa.binary())
            norms = pa.array((values * values).sum(axis=1), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), planes, norms], ["vec_id", "planes", "norm"])

    return stage(kept.mapInArrow(run, "vec_id bigint, planes binary, norm bigint"), "planes"), bits


def _sums(packed: DataFrame, bits: int, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """number -> (vectors, sum per component) of the centroids that have vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = pack(centroids, bits)
        counts = np.zeros(len(centroids), dtype=np.int64)
        sums = np.zeros((len(centroids), DIMENSION), dtype=np.int64)
        for batch in batches:
            x = _planes(batch.column(0), bits)
            number, _ = nearest(x, batch.column(1).to_numpy(), planes)
            counts += np.bincount(number, minlength=len(centroids))
            np.add.at(sums, number, unpack(x))
        some = np.flatnonzero(counts)
        columns = [pa.array(some, pa.int64()), pa.array(counts[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "rows", "sums"])

    parts = packed.select("planes", "norm").mapInArrow(run, "cluster bigint, rows bigint, sums array<bigint>")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMENSION)]
    rows = parts.groupBy("cluster").agg(F.sum("rows").alias("rows"), *exact).collect()  # k rows at most
    return {r["cluster"]: (r["rows"], [int(r[f"s{i}"]) for i in range(DIMENSION)]) for r in rows}


def seeds(packed: DataFrame, bits: int, k: int, salt: str) -> np.ndarray:
    """The vectors of the k smallest SHA-256 of ``<salt>:<vec_id>``, in that order; ids that are null come last,
    rows that repeat an id in the order of their planes."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = packed.orderBy(digest.asc_nulls_last(), "planes").limit(k).select("planes").collect()
    return unpack(np.frombuffer(b"".join(bytes(r["planes"]) for r in rows), dtype="<u8").reshape(-1, bits))


@dataclass(frozen=True)
class Clustering:
    """``assigned``: (vec_id, cluster, distance), staged; ``centroids``: their integer components."""

    assigned: DataFrame
    centroids: np.ndarray


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2",
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> Clustering:
    """``rounds`` of Lloyd's algorithm, then one more assignment.

    A component x counts as floor(scale * x). A round assigns every vector to the nearest centroid and
    moves each centroid that has vectors to floor(sum / count) per component, exactly; one without
    vectors stays. Vectors that are null, of another length than 64, or hold null or non-finite
    components take no part. Rows that repeat an id are vectors of their own; null ids are kept.
    Fewer than k vectors are as many centroids. Components of more than ``MAX_BITS`` bits raise ValueError.
    """
    packed, bits = packed_vectors(vectors, scale, vec_id, embedding)
    centroids = seeds(packed, bits, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for number, (rows, sums) in _sums(packed, bits, centroids).items():
            moved[number] = [s // rows for s in sums]
        centroids = moved

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = pack(centroids, bits)
        for batch in batches:
            number, distance = nearest(_planes(batch.column(1), bits), batch.column(2).to_numpy(), planes)
            columns = [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return Clustering(stage(packed.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), "clusters"), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    An empty table gives an empty result. Sums that do not fit into 64 bits fail.
    """
    spark = found.assigned.sparkSession
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["inertia"]) for r in found.assigned.groupBy("cluster").agg(exact.alias("inertia")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in found.centroids.tolist()]
    facts = [(number, inertia, sum(sums.values()), digests[number]) for number, inertia in sorted(sums.items())]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    # k rows: a parameter, whatever the table's size.
    of_cluster = F.broadcast(spark.createDataFrame(facts, schema))
    return found.assigned.join(of_cluster, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2") -> str:
    """The same as SQL over ``embeddings``, by multiplication of components."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64
), x AS MATERIALIZED (
  SELECT row, unnest(range(64)) AS i, unnest(vec) AS v FROM kept
), chosen AS (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), vec) - 1 AS cluster, vec FROM kept
  QUALIFY cluster < {k}
), c0 AS MATERIALIZED (
  SELECT CAST(cluster AS INTEGER) AS cluster, unnest(range(64)) AS i, unnest(vec) AS v FROM chosen
)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT row, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT row, cluster, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS distance FROM x JOIN c{n} c USING (i) GROUP BY row, cluster)
  GROUP BY row
)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS MATERIALIZED (
  SELECT cluster, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM a{n} JOIN x USING (row) GROUP BY cluster, i
), c{n + 1} AS MATERIALIZED (
  SELECT cluster, i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (cluster, i)
)"""
            )
    return (
        ", ".join(steps)
        + f"""
SELECT vec_id, a.cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       centroid_sha256
FROM a{rounds} a JOIN kept USING (row)
JOIN (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster) d
  ON d.cluster = a.cluster"""
    )
