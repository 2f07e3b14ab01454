from __future__ import annotations

import random
import re
from math import comb

import numpy as np
import pytest

from rowferry.llm import near_dedup
from rowferry.llm.components import components


def shingle_set(text, words):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return set()
    size = min(words, len(found))
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def brute(rows, words, percent):
    """Every pair; rows with a null id are not linked."""
    sets = [shingle_set(text, words) for _, text in rows]
    root = {ident: ident for ident, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return sorted(
        (ident is not None, ident or 0, len(s), -1 if ident is None else find(ident), ident is None or find(ident) == ident)
        for (ident, _), s in zip(rows, sets)
    )


def found(df, words, percent):
    rows = near_dedup.near_duplicates(df, words, percent).collect()
    return sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"])
        for r in rows
    )


def varied(base, random_, changes):
    words = list(base)
    for _ in range(changes):
        words[random_.randrange(len(words))] = f"new{random_.randrange(10**6)}"
    return " ".join(words)


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, 3, 85) == brute(rows, 3, 85)
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_groups_of_near_copies(spark, monkeypatch, block):
    # Similarities all around the limit, a hot group, and chains whose ends are unlike; small blocks split the groups.
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    random_ = random.Random(block)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size, length in ((90, 150), (12, 60), (5, 40), (3, 300)):
        base = [random_.choice(vocabulary) for _ in range(length)]
        texts += [varied(base, random_, random_.randrange(0, 1 + length // 20)) for _ in range(size)]
    chain = [random_.choice(vocabulary) for _ in range(200)]
    for step in range(12):
        chain[step * 15] = f"link{step}"
        texts.append(" ".join(chain))
    texts += [" ".join(random_.choice(vocabulary) for _ in range(80)) for _ in range(60)]
    texts += ["one", "One", "one two", "", None, "ONE TWO"]
    random_.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, 3, 85) == brute(rows, 3, 85)


@pytest.mark.parametrize("copies", [2, 3, 6])
def test_blocks_cut_by_bytes(spark, monkeypatch, copies):
    # Fewer rows than blocks: blocks of one row, and pairs of blocks that hold one side only.
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 2000)
    random_ = random.Random(copies)
    base = [f"w{i}" for i in range(400)]
    rows = list(enumerate([" ".join(base), *(varied(base, random_, 3) for _ in range(copies - 1))]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, 3, 85) == brute(rows, 3, 85)


def test_no_pairs_are_no_links():
    none = np.array([], dtype=np.int64)
    left, right = near_dedup._linked(np.array([1]), np.zeros((1, near_dedup.HASHES), np.uint32), [none], none, none, 85)
    assert not len(left) and not len(right)


def test_bounds_follow_the_posterior():
    t, miss = 0.85, 1e-9
    for k, limit in enumerate(near_dedup.least_matches(85)):
        n = 32 * (k + 1)
        # Numerically: the share of the posterior above t, with a uniform prior.
        grid = (np.arange(200_000) + 0.5) / 200_000
        above = grid >= t
        for m, kept in ((limit, True), (limit - 1, False)):
            density = comb(n, m) * grid**m * (1 - grid) ** (n - m)
            assert (density[above].sum() / density.sum() >= miss * 0.9) == kept


def test_signatures_estimate_the_similarity():
    random_ = np.random.default_rng(0)
    a = np.unique(random_.integers(0, 2**63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:2000], random_.integers(0, 2**63, 1000, dtype=np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true) < 0.15


def test_common_shingles_by_matrix_and_by_pair():
    random_ = np.random.default_rng(1)
    sets = [np.unique(random_.integers(0, 400, random_.integers(0, 300)).astype(np.uint64)) for _ in range(40)]
    left, right = np.triu_indices(40, 1)
    expected = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(left, right)]
    assert near_dedup._common(sets, left, right).tolist() == expected
    assert near_dedup._common(sets, left[:50], right[:50]).tolist() == expected[:50]


def test_components(spark):
    random_ = random.Random(5)
    links = [(random_.randrange(120), random_.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    links += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    root = {x: x for link in links for x in link if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    rows = components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    assert {r["node"]: r["component"] for r in rows} == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_plans_stay_short(spark, monkeypatch):
    # Plans, and their new versions as stages end, are held by the driver: no job may be one plan of all steps.
    plans, write = [], near_dedup.stage

    def counted(df, name):
        plans.append(str(df._jdf.queryExecution().executedPlan()).count("Exchange"))
        return write(df, name)

    monkeypatch.setattr(near_dedup, "stage", counted)
    monkeypatch.setitem(components.__globals__, "stage", counted)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:90] + [f"new{i}"]) for i in range(5)] + ["one text", "another text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r["component_id"] for r in near_dedup.near_duplicates(df).collect()) == [0, 0, 0, 0, 0, 5, 6]
    assert max(plans) <= 20, plans
