from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rowferry.llm import language
from conftest_texts import SENTENCES


def brute_bits(samples, text, order):
    """The code length of one text, straight from the definition."""
    follow = defaultdict(Counter)
    seen = []
    for sample in samples:
        data = bytes(order) + sample
        seen += [data[i - order : i + 1] for i in range(order, len(data))]
    for window in seen:
        for length in range(order + 1):
            follow[window[order - length : order]][window[order]] += 1
    total, data = 0.0, bytes(order) + text
    for i in range(order, len(data)):
        for length in range(order, -1, -1):
            counts = follow.get(data[i - length : i], Counter())
            n, d = sum(counts.values()), len(counts)
            if counts[data[i]]:
                total -= math.log2(counts[data[i]] / (n + d))
                break
            if d:
                total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    samples = {k: [s.encode() for s in v] for k, v in SENTENCES.items()}
    model = language.LanguageModel(samples, order=3)
    texts = [b"the cat and the hat", "où est la maison".encode(), b"x", "zzz \u4e00".encode()]
    bits = model.code_lengths(texts)
    for i, text in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert math.isclose(bits[i, j], brute_bits(samples[name], text, 3), rel_tol=1e-12)
    again = model.code_lengths(texts)  # from the table of remembered windows
    assert np.allclose(bits, again)


def test_long_texts_are_cut_into_blocks_without_a_seam(monkeypatch):
    model = language.LanguageModel({k: [s.encode() for s in v] for k, v in SENTENCES.items()}, order=3)
    text = " ".join(SENTENCES["fr"] * 20).encode()
    whole = model.code_lengths([text])
    monkeypatch.setattr(language, "BLOCK_BYTES", 37)
    assert np.allclose(model.code_lengths([text]), whole)


def test_held_out_accuracy(documents):
    model = language.train(documents)
    found = language.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    kept_out = [r for r in rows if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert kept_out and sum(r["lang"] == r["lang_pred"] for r in kept_out) >= 0.98 * len(kept_out)


def test_labels_and_held_out_texts_are_not_looked_at(documents):
    model = language.train(documents)
    out = documents.where(language.held_out(F.col("doc_id")))
    blind = documents.withColumn("text", F.when(~language.held_out(F.col("doc_id")), F.col("text")))
    assert (language.train(blind).code_lengths([b"some text"]) == model.code_lengths([b"some text"])).all()
    plain = {tuple(r) for r in language.identify(out, model).collect()}
    swapped = out.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    assert {tuple(r) for r in language.identify(swapped, model).collect()} == plain


def test_odd_rows(odd, nothing, documents):
    model = language.train(documents)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 5, 6}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert language.identify(nothing, model).count() == 0
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and not {2, 3, 5, 6} & {r["doc_id"] for r in kept.collect()}
    assert language.accepted(nothing, model).count() == 0


def test_without_labels_nothing_is_told(odd, nothing):
    model = language.train(nothing)
    assert {r["lang_pred"] for r in language.identify(odd, model).collect()} == {"und"}
    assert language.accepted(odd, model).count() == 0


def test_sample_is_the_same_however_few_rows_are_looked_at_first(spark, monkeypatch):
    """Ids repeat, most rows of one language cannot be used; what is chosen is what sorting all rows gives."""
    monkeypatch.setattr(language, "SAMPLE_DOCS", 7)
    rows = [(i % 300, "en", f"some words {i % 300}") for i in range(900)] + [(i, "fr", "1 2" if i % 40 else f"mots {i}") for i in range(1000, 1800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(5)
    usable = docs.where(F.col("text").rlike("[a-z]")).select("doc_id", "lang", "text").distinct()
    hashes = sorted((r["h"], r["doc_id"], r["lang"]) for r in usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect())
    expected = {name: [i for _, i, of in hashes if of == name][:7] for name in ("en", "fr")}
    for first in (1, 20, 10**6):
        monkeypatch.setattr(language, "LOOKED_AT", first)
        assert language._sampled(usable, {"en": 900, "fr": 800}) == expected


def test_total_of_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"l{i % 3}", "word " * 20) for i in range(300)], "doc_id bigint, lang string, text string")
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 3 * 450)
    assert {len(ids) for ids in language._sampled(docs, {f"l{i}": 100 for i in range(3)}).values()} == {4}
    monkeypatch.setattr(language, "SAMPLE_TOTAL", 1)
    assert len(language.train(docs).languages) == 3


def test_many_languages_share_the_table_of_costs(monkeypatch):
    samples = {f"l{i}": [f"text {i}".encode()] for i in range(40)}
    plain = language.LanguageModel(samples).code_lengths([b"text 7 and more text"])
    monkeypatch.setattr(language, "TABLE_COSTS", 64)
    model = language.LanguageModel(samples)
    assert np.allclose(model.code_lengths([b"text 7 and more text"]), plain, rtol=1e-12) and model._costs.size <= 80


def test_looking_up_a_block_takes_little_more_than_its_costs():
    samples = {k: [s.encode() for s in v] for k, v in SENTENCES.items()}
    model = language.LanguageModel(samples, order=3)
    keys = language.windows(np.random.default_rng(3).integers(97, 123, 1 << 20, dtype=np.uint8).tobytes(), 3)
    expected = np.stack([tree.bits(keys) for tree in model.trees], axis=1)
    model.window_costs(keys[:1])  # makes the table
    tracemalloc.start()
    try:
        costs = model.window_costs(keys)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (costs == expected).all() and peak < 1.6 * costs.nbytes
