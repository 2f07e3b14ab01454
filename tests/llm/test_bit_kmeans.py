from __future__ import annotations

import hashlib

import numpy as np
import pytest

from rowferry.llm import bit_kmeans as km

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, planes int, norm int"


def brute(rows, k, rounds=5):
    """id-ordered (vec_id, cluster, distance, cluster inertia, inertia, digest) in plain Python integers."""
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows]
    seeds = sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]
    centres = [list(v) for _, v in seeds]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((min(range(len(d)), key=lambda j: (d[j], j)), min(d)))
        return out

    for _ in range(rounds):
        of = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (c, _) in zip(kept, of) if c == j]
            if mine:
                centres[j] = [sum(column) // len(mine) for column in zip(*mine)]
    of = assign()
    total = sum(d for _, d in of)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, c, d, sum(e for b, e in of if b == c), total, digest[c]) for (i, _), (c, d) in zip(kept, of))


def test_packing_and_dots_are_exact():
    random = np.random.default_rng(1)
    for bits in (1, 2, 9, 28):
        top = 1 << (bits - 1)
        x, c = random.integers(-top, top, (50, 64)), random.integers(-top, top, (7, 64))
        assert (km.unpack(km.pack(x, bits)) == x).all()
        assert (km.dots(km.pack(x, bits), km.pack(c, bits)) == x @ c.T).all()


@pytest.mark.parametrize("count,k", [(300, 40), (25, 40), (60, 3)])
def test_against_brute_force(spark, count, k):
    random = np.random.default_rng(count)
    x = random.standard_normal((count, 64)) * random.choice([0.01, 1, 30], (count, 1))
    x[1::7] = x[0]  # a group of equal vectors: ties
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    found = km.with_inertia(km.cluster(spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA), k=k))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, k)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [float(i) for i in range(64)]
    odd = [None, [], good[:63], good + [1.0], good[:63] + [nan], good[:63] + [inf], good[:63] + [None]]
    rows = [(i, v, None, None, None) for i, v in enumerate(odd)]
    rows += [(10, good, "x", 0, 0), (10, good, "x", 0, 0), (None, [v + 1 for v in good], "x", 0, 0)]
    found = sorted(km.with_inertia(km.cluster(spark.createDataFrame(rows, SCHEMA), k=2)).collect(), key=str)
    assert [r["vec_id"] for r in found].count(10) == 2 and [r["vec_id"] for r in found].count(None) == 1
    # Both centroids start at the repeated vector; the first takes all, moves away and ends at the third vector.
    assert sorted(r["cluster"] for r in found) == [0, 1, 1] and {r["inertia"] for r in found} == {0}
    assert km.with_inertia(km.cluster(spark.createDataFrame(rows[:7], SCHEMA))).count() == 0
    assert km.with_inertia(km.cluster(spark.createDataFrame([], SCHEMA))).count() == 0


def test_components_without_room_fail(spark):
    with pytest.raises(ValueError, match="bits"):
        km.cluster(spark.createDataFrame([(1, [1e30] * 64, "x", 0, 0)], SCHEMA))
