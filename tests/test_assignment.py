from __future__ import annotations

import itertools
import random

import pytest

from rowferry.operators.assignment import assigned_pairs

PAIRS = "mapping_id int, source_field string, destination_field string, confidence double"


def best(rows, steps):
    """(total in steps, pairs) of the best assignment, by trying all."""
    sources, destinations = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
    worth = {}
    for _, s, d, c in rows:
        worth[s, d] = max(worth.get((s, d), 0), round(min(c, 1.0) * steps))
    found = (0, 0)
    places = destinations + [None] * len(sources)
    for chosen in set(itertools.permutations(places, len(sources))):
        used = [worth[p] for p in zip(sources, chosen) if worth.get(p)]
        found = max(found, (sum(used), len(used)))
    return found


def total(rows, steps):
    assert len({r["source_field"] for r in rows}) == len(rows) == len({r["destination_field"] for r in rows})
    return sum(round(min(r["confidence"], 1.0) * steps) for r in rows), len(rows)


def mappings(count, seed, most):
    rnd = random.Random(seed)
    rows = []
    for m in range(count):
        sources, destinations = rnd.randint(1, most), rnd.randint(1, most)
        levels = rnd.choice([[0.5], [0.5, 1.0], [i / 100 for i in range(1, 101)]])
        rows += [
            (m, f"s{rnd.randrange(sources)}", f"d{rnd.randrange(destinations)}", rnd.choice(levels))
            for _ in range(rnd.randint(1, sources * destinations + 2))
        ]
    return rows


def test_against_all_assignments(spark):
    rows = mappings(80, 1, 4)
    found = assigned_pairs(spark.createDataFrame(rows, PAIRS).repartition(5)).collect()
    for m in range(80):
        mine = [r for r in rows if r[0] == m]
        assert total([r for r in found if r["mapping_id"] == m], 10**6) == best(mine, 10**6), mine


def test_the_first_pair_may_lose(spark):
    rows = [(1, "name", "TITLE", 0.9), (1, "name", "NAME", 0.8), (1, "label", "TITLE", 0.8), (None, "name", "TITLE", 0.9)]
    found = assigned_pairs(spark.createDataFrame(rows, PAIRS))
    assert sorted((r[0] or 0, r[1], r[2], r[3]) for r in found.collect()) == [
        (0, "name", "TITLE", 0.9), (1, "label", "TITLE", 0.8), (1, "name", "NAME", 0.8),
    ]


def test_large_mappings_bid_by_joins(spark):
    rows = [(m or None, *rest) for m, *rest in mappings(6, 4, 3)]
    found = assigned_pairs(spark.createDataFrame(rows, PAIRS).repartition(3), steps=10, task_pairs=2).collect()
    for m in [None, *range(1, 6)]:
        assert total([r for r in found if r["mapping_id"] == m], 10) == best([r for r in rows if r[0] == m], 10)


def test_odd_rows(spark):
    rows = [
        (1, "a", "A", 0.0), (1, "b", None, 0.9), (1, None, "B", 0.9), (1, "c", "C", None), (1, "d", "D", float("nan")),
        (1, "e", "E", 7.0), (1, "e", "E", 0.5), (1, "f", "F", -1.0), (2, "", "", 0.25),
    ]
    table = spark.createDataFrame(rows, PAIRS).selectExpr("*", "1 AS _pairs", "'x' AS weight")
    found = assigned_pairs(table).collect()
    assert sorted((r["mapping_id"], r["source_field"], r["destination_field"], r["confidence"]) for r in found) == [(1, "e", "E", 7.0), (2, "", "", 0.25)]
    assert assigned_pairs(table.limit(0)).count() == 0


@pytest.mark.parametrize("names", [60])
def test_a_price_war(spark, names):
    """One destination fewer than sources, all equally sure: what is left over bids until it gives up."""
    rows = [(1, f"s{i}", f"d{j}", 0.5) for i in range(names) for j in range(names - 1)] + [(1, "s0", "only", 0.1)]
    assert total(assigned_pairs(spark.createDataFrame(rows, PAIRS)).collect(), 10) == (5 * (names - 1) + 1, names)
