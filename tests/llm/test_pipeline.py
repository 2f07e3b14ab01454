from __future__ import annotations

import re
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rowferry.llm import language
from rowferry.llm.tables import table
from test_near_dedup import shingle_set


def brute(rows, model):
    """The ids that the first three stages keep, one document after the other."""
    told = []
    for ident, text in rows:
        if text is not None and any(c.isalpha() for c in text) and model.predict([text.encode()])[1][0] >= language.MIN_SCORE:
            told.append((ident, text))
    first: dict[str, int] = {}
    for ident, text in told:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        first[norm] = min(ident, first.get(norm, ident))
    alone = [(i, t) for i, t in told if i in set(first.values())]
    sets = [shingle_set(t, 5) for _, t in alone]
    root = {i: i for i, _ in alone}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(set)
    for k, s in enumerate(sets):
        for shingle in s:
            holders[shingle].add(k)
    for k, s in enumerate(sets):
        for j in {j for shingle in s for j in holders[shingle] if j < k}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = find(alone[k][0]), find(alone[j][0])
                root[max(a, b)] = min(a, b)
    return {i: t for i, t in alone if find(i) == i}


def test_stages_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = brute(rows, language.train(docs))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    found, bins = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        found[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]] += r["length"]
    assert found == lengths
    assert max(bins.values()) <= 2048 and len(bins) <= 1.05 * sum(lengths.values()) / 2048 + 1


def test_stages_return_documents(spark, folder, odd, nothing):
    docs = table(spark, folder, "documents")
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, folder).columns == docs.columns
        assert function(spark, nothing, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, folder).count() == 0
    # Rows without an id stay; of the rest one document of each group.
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_exact_copies(spark, odd, folder), folder)
    assert kept.columns == odd.columns and None in {r["doc_id"] for r in kept.collect()}


def test_repeated_rows_and_rows_without_ids_are_decided_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "one text", 1)] * 3 + [(None, "no id here", 1), (None, "no  id here", 2), (7, "other text", 1), (7, "seventh", 2), (3, "one\ntext", 1)]
    rows += [(9, long, 1), (9, long + " more", 2), (None, long + " end", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row0 int").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    # One row of each group of equal texts: that with the smallest id.
    found = sorted((str(r["doc_id"]), " ".join(r["text"].split())) for r in exact.collect())
    want = [("3", "one text"), ("7", "other text"), ("7", "seventh"), ("9", long), ("9", long + " more"), ("None", "no id here"), ("None", long + " end")]
    assert found == sorted(want)
    near = sorted((str(r["doc_id"]), len(r["text"].split())) for r in corpus_pipeline.drop_near_copies(spark, exact, "").collect())
    assert [n for n in near if n[1] >= 60] == [n for n in near if n[0] == "9"] and len([n for n in near if n[0] == "9"]) == 1
    assert len(near) == 5
