from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from rowferry.llm import periodic_runs as pr
from rowferry.llm.queries import QUERIES
from rowferry.llm.suffix_tree import SuffixTree


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute(words, shortest=12):
    """All runs, by every period and every stretch of equal words that far apart."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, 2 * q) and smallest_period(words[i : i + length]) == q:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = text.encode().split() if text else []  # bytes: ASCII blanks only
    words = [w.decode() for w in words]
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapse(words, runs))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def sequences(count, seed):
    choice = random.Random(seed)
    for _ in range(count):
        size, letters = choice.randint(0, 40), choice.randint(1, 4)
        parts, out = [[choice.randint(1, letters) for _ in range(choice.randint(1, 6))] for _ in range(4)], []
        while len(out) < size:
            out += choice.choice(parts) * choice.randint(1, 4)
        yield out[:size]


def test_tree_against_comparison_of_suffixes():
    for s in sequences(300, 1):
        tree, n = SuffixTree(np.array(s, dtype=np.int64)), len(s)
        for sign, ranks in ((1, tree.ranks()), (-1, tree.ranks(descending=True))):
            assert np.argsort(ranks).tolist() == sorted(range(n + 1), key=lambda i: [sign * x for x in s[i:]])
        a, b = np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j] or [(0, 0)]).T
        common = [next(k for k in range(n + 1) if i + k == n or j + k == n or s[i + k] != s[j + k]) for i, j in zip(a, b)]
        assert n == 0 or tree.extensions(a, b).tolist() == common


@pytest.mark.parametrize("shortest", [2, 3, 12])
def test_runs_against_brute_force(shortest):
    for s in sequences(600, shortest):
        assert [tuple(r) for r in pr.runs_of(np.array(s, dtype=np.int64), shortest).tolist()] == brute(s, shortest)


def test_cutting_loses_no_run():
    document, word, runs = [], [], []
    for d, s in enumerate(sequences(400, 9)):
        runs += [(len(word) + start, length, q) for start, length, q in brute(s, 4)]
        document += [d] * len(s)
        word += s
    found = []
    for first, end in pr.stretches(np.array(document), np.array(word), 4):
        found += [(first + s, n, q) for s, n, q in pr.runs_of(np.array(word[first:end]), 4).tolist()]
    assert sorted(found) == sorted(runs)


def test_table(spark, folder, documents):
    result = QUERIES["op12_runs"](spark, folder)
    assert result.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    short = {i for i, text in rows if len(text) < 12_000}
    assert len(short) > 100 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in short) > 5
    found = sorted(tuple(r) for r in result.collect())
    assert [r[0] for r in found] == sorted(i for i, _ in rows)
    assert [r for r in found if r[0] in short] == sorted(expected(i, t) for i, t in rows if i in short)


def test_odd_rows(odd, nothing, monkeypatch):
    monkeypatch.setattr(pr, "BLOCK_BYTES", 64)
    found = pr.run_digests(pr.periodic_runs(pr.with_repetition(odd)))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    mine = sorted((tuple(r) for r in found.collect() if r["doc_id"] != 7), key=str)
    assert mine == sorted((expected(*r) for r in rows if r[0] != 7), key=str)
    assert pr.run_digests(pr.periodic_runs(pr.with_repetition(nothing))).count() == 0


def test_separators_and_lengths(spark):
    text = "\t a\x0bb\x0ca\rb\na  b\ta b a b a b a b c\x1cd "
    long = "x " * 50_000 + "y"
    rows = [(1, text), (2, "a " * 11), (3, "a " * 12), (4, long)]
    found = {r["doc_id"]: r for r in pr.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[1]["n_words"] == 14 and [tuple(r) for r in found[1]["runs"]] == [(0, 12, 2)]
    assert found[1]["collapsed"] == "a b a b c\x1cd"
    assert [len(found[i]["runs"]) for i in (2, 3)] == [0, 1] and found[3]["collapsed"] == "a"
    assert [tuple(r) for r in found[4]["runs"]] == [(0, 50_000, 1)] and found[4]["collapsed"] == "x y"
