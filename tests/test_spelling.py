from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowferry.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def changed(word, choice, times):
    for _ in range(times):
        at = choice.randrange(len(word) + 1)
        word = choice.choice([word[:at] + word[at + 1 :], word[:at] + choice.choice("abé") + word[at:], word[:at] + choice.choice("abé") + word[at + 1 :]])
    return word


def near(spark, left, right, edits, **kwargs):
    a = spark.createDataFrame(left, "mapping_id bigint, left_name string, key int")
    b = spark.createDataFrame(right, "mapping_id bigint, right_name string, rows int")
    return sorted(tuple(r) for r in spelling.near_names(a, b, edits).collect())


def brute(left, right, edits):
    pairs = {(o, a, b) for o, a, _ in left for p, b, _ in right if o is not None and o == p and a and b}
    return sorted((o, a, b, d) for o, a, b in pairs if (d := distance(a, b)) <= edits)


@pytest.mark.parametrize("edits,long", [(0, 32), (1, 8), (2, 32), (2, 8), (3, 8)])
def test_against_all_pairs(spark, monkeypatch, edits, long):
    """Short names, long ones, and names around the length where the keys change."""
    monkeypatch.setattr(spelling, "LONG", long)
    choice = random.Random(edits * 100 + long)
    words = ["".join(choice.choice("abé") for _ in range(choice.choice([1, 2, 3, 6, 7, 8, 9, 10, 14, 33]))) for _ in range(60)]
    left = [(choice.randrange(2), changed(w, choice, choice.randint(0, 3)), 1) for w in words for _ in range(2)]
    right = [(choice.randrange(2), changed(w, choice, choice.randint(0, 3)), 1) for w in words for _ in range(2)]
    odd = [(None, "ab", 1), (0, None, 1), (0, "", 1), (1, "ab", 1), (1, "ab", 1)]
    found = near(spark, left + odd, right + odd, edits)
    assert found == brute(left + odd, right + odd, edits) and len(found) > 15


def test_hot_keys_are_cut(spark, monkeypatch):
    """All names share a key: nothing is lost by the cells, and no cell holds all."""
    monkeypatch.setattr(spelling, "CELL", 7)
    names = [(1, f"n{a}{b}", 0) for a in "abcdefgh" for b in "abcdefgh"]
    assert near(spark, names, names[::-1], 2) == brute(names, names, 2)


def test_plan_has_no_cross_join(spark):
    a = spark.createDataFrame([(1, "ab")], "mapping_id bigint, left_name string")
    plan = spelling.near_names(a, a.withColumnRenamed("left_name", "right_name"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_column_per_field(spark):
    source = spark.createDataFrame([(1, "emial", 2), (1, "Email", 3), (1, "EMAIL", 1), (1, "phone", 4), (2, "x", 1)], "mapping_id bigint, source_field string, pos bigint")
    fields = spark.createDataFrame([(1, "E_MAIL"), (1, "Fone"), (1, "nothing"), (2, "y"), (2, None)], "mapping_id bigint, destination_field string")
    found = {r["destination_field"]: (r["source_field"], r["distance"], round(r["confidence"], 4)) for r in spelling.suggest_by_edit(source, fields).collect()}
    assert found == {"E_MAIL": ("EMAIL", 1, 0.8333), "Fone": ("phone", 2, 0.6), "y": ("x", 1, 0.0)}
    none = spelling.suggest_by_edit(source.where(F.lit(False)), fields)
    assert none.count() == 0
