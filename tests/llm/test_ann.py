from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowferry.llm import ann


def brute(ids, x, query, results=10):
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
    d[ids == query] = np.inf
    order = np.lexsort((ids, d))[: min(results, len(ids) - 1)]
    return ids[order].tolist(), d[order]


def by_query(df):
    found: dict[int, list] = {}
    for r in df.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {k: sorted(v) for k, v in found.items()}


def test_recall_and_exact_scores(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = by_query(ann.nearest_neighbours(vectors, every=20))
    assert sorted(found) == sorted(i for i in ids if i % 20 == 0)
    hits = 0
    for query, list_ in found.items():
        best, _ = brute(ids, x, query)
        assert [r for r, _, _ in list_] == list(range(1, 11))
        for _, ident, score in list_:
            assert score == pytest.approx(np.sqrt(((x[ids == ident][0] - x[ids == query][0]) ** 2).sum()), rel=1e-12)
        hits += len(set(best) & {i for _, i, _ in list_})
    assert hits >= 0.95 * 10 * len(found)


def test_a_small_graph_still_finds_neighbours(spark, monkeypatch):
    # Many leaves and a narrow beam: the rounds of the descent and the search have to do the work.
    for name, value in {"LEAF": 40, "NEIGHBOURS": 12, "INCOMING": 12, "BEAM": 60, "OPENED": 12}.items():
        monkeypatch.setattr(ann, name, value)
    random = np.random.default_rng(3)
    x = random.standard_normal((1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = by_query(ann.nearest_neighbours(df, every=50))
    ids = np.arange(1500)
    hits = sum(len(set(brute(ids, x.astype(np.float64), q)[0]) & {i for _, i, _ in rows}) for q, rows in found.items())
    assert len(found) == 30 and hits >= 0.9 * 300


@pytest.mark.parametrize("jitter,outlier", [(1e-5, False), (1e-4, True)])
def test_a_tight_group_and_an_outlier(spark, jitter, outlier):
    random = np.random.default_rng(6)
    x = random.standard_normal((3600, 32)) / np.sqrt(32)
    x[:1200] = x[0] + jitter * random.standard_normal((1200, 32))
    x = x.astype(np.float32)
    if outlier:
        x[3599] *= 1e8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = by_query(ann.nearest_neighbours(df, every=60))
    ids = np.arange(3600)
    right = {q: len(set(brute(ids, x.astype(np.float64), q)[0]) & {i for _, i, _ in rows}) for q, rows in found.items()}
    assert len(right) == 60
    assert sum(n for q, n in right.items() if q < 1200) >= 0.95 * 10 * 20
    assert sum(n for q, n in right.items() if q >= 1200) >= 0.9 * 10 * 40


def test_copies_ties_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0], 0) for i in range(0, 40)] + [(i, [1.0, 2.0 + i], 0) for i in range(40, 60)]
    rows += [(100, None, 0), (200, [0.0, 0.0], 0), (300, [1.0, nan], 0), (400, [inf, 1.0], 0), (500, [1.0, None], 0), (600, [], 0)]
    rows += [(700, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0], 0), (41, [1.0, 43.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, vec int")
    found = by_query(ann.nearest_neighbours(df, every=20))
    assert sorted(found) == [0, 20, 40]
    assert [i for _, i, _ in found[0]] == list(range(1, 11))
    assert [i for _, i, _ in found[20]] == list(range(0, 10))
    # 40 lies 40 away from the copies; the nearest are 41 (the smaller of its two vectors) to 50.
    assert [i for _, i, _ in found[40]] == list(range(41, 51)) and found[40][0][2] == 1.0


def test_dimensions_are_searched_apart(spark):
    random = np.random.default_rng(8)
    vectors = {i: random.standard_normal(2 if i % 61 else 3).astype(np.float32) for i in range(1, 400)}
    vectors |= {1000 + i: random.standard_normal(7).astype(np.float32) for i in range(1, 9)} | {2000: np.ones(1, np.float32)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id bigint, embedding array<float>")
    found = by_query(ann.nearest_neighbours(df, every=10))
    asked = {i for i in vectors if i % 10 == 0}
    assert {61 * k for k in (1, 2)} & set(vectors) and set(found) == asked - {2000}  # 2000 is alone in its dimension
    for query, listed in found.items():
        alike = [i for i in vectors if len(vectors[i]) == len(vectors[query])]
        best, _ = brute(np.array(alike), np.array([vectors[i] for i in alike], dtype=np.float64), query)
        assert [i for _, i, _ in listed] == best


def test_few_and_no_candidates(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = by_query(ann.nearest_neighbours(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], schema)))
    assert few == {0: [(1, 1, 1.0), (2, 2, 3.0)]}
    assert ann.nearest_neighbours(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0


def test_queries_that_are_no_nodes(spark):
    random = np.random.default_rng(4)
    x = random.standard_normal((800, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    index = ann.build_index(ann.usable(df))
    goals = random.standard_normal((10, 6))
    queries = spark.createDataFrame([(-1 - i, v.tolist()) for i, v in enumerate(goals)], "query bigint, goal array<double>")
    found = by_query(ann.search(index, queries.withColumn("start", F.lit(None).cast("bigint"))))
    hits = 0
    for i, goal in enumerate(goals):
        best = np.argsort(((x - goal) ** 2).sum(axis=1))[:10]
        hits += len(set(best.tolist()) & {j for _, j, _ in found[-1 - i]})
    assert hits >= 90
