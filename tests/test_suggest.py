from __future__ import annotations

import json
import random

import pytest

from rowferry.operators.replies import parse_pairs
from rowferry.operators.suggest import pairs_to_apply, suggest_by_name, validate_pairs

SOURCE, TARGET = ["email", "phone"], ["EMAIL", "PHONE"]


def sides(spark, source=SOURCE, target=TARGET):
    s = spark.createDataFrame([(1, n, i) for i, n in enumerate(source)], "mapping_id int, source_field string, pos int")
    d = spark.createDataFrame([(1, n, i) for i, n in enumerate(target)], "mapping_id int, destination_field string, pos int")
    return s, d


def validated(spark, reply):
    text = reply if isinstance(reply, str) else json.dumps(reply)
    pairs = parse_pairs(spark.createDataFrame([(1, text)], "mapping_id int, reply string"))
    rows = validate_pairs(pairs, *sides(spark)).orderBy("pos").collect()
    return [(r.source_field, r.destination_field, r.confidence) for r in rows]


def pair(source, target, **more):
    return {"source_field": source, "destination_field": target, **more}


def test_two_valid_pairs(spark):
    reply = {"pairs": [pair("email", "EMAIL", confidence=0.9), pair("phone", "PHONE", confidence=0.8)]}
    assert validated(spark, reply) == [("email", "EMAIL", 0.9), ("phone", "PHONE", 0.8)]


def test_unknown_names_and_second_use(spark):
    reply = {"pairs": [pair("nope", "EMAIL"), pair("email", "NOPE"), pair("email", "EMAIL"), pair("phone", "EMAIL", confidence=1)]}
    assert validated(spark, reply) == [("email", "EMAIL", 0.5)]


@pytest.mark.parametrize("value, expected", [(5.0, 1.0), (-1, 0.0), ("0.25", 0.25), ("high", 0.5), (None, 0.5), (True, 1.0)])
def test_confidence(spark, value, expected):
    assert validated(spark, {"pairs": [pair("email", "EMAIL", confidence=value)]}) == [("email", "EMAIL", expected)]


@pytest.mark.parametrize("reply", ["no json", [pair("email", "EMAIL")], {"pairs": [3, None, "x"]}, {"pairs": {}}, {}])
def test_unusable(spark, reply):
    assert validated(spark, reply) == []


def test_a_source_may_fill_two_destinations(spark):
    reply = {"pairs": [pair("email", "EMAIL"), pair("email", "PHONE")]}
    assert len(validated(spark, reply)) == 2


def test_apply(spark):
    pairs = spark.createDataFrame(
        [(1, "a", "A", 0.5), (1, "b", "B", 0.49), (1, "c", "C", 0.9)],
        "mapping_id int, source_field string, destination_field string, confidence double",
    )
    current = spark.createDataFrame([(1, "c", "C"), (1, "a", "X")], "mapping_id int, source_field string, destination_field string")
    assert [r.source_field for r in pairs_to_apply(pairs, current).collect()] == ["a"]


def test_names(spark):
    s, d = sides(spark, ["email", "customerName", "phone_number", "zip"], ["EMAIL", "Customer Name", "NUMBER-PHONE", "Work Phone", "Other"])
    rows = {r.destination_field: (r.source_field, round(r.confidence, 3)) for r in suggest_by_name(s, d).collect()}
    assert rows == {
        "EMAIL": ("email", 1.0),
        "Customer Name": ("customerName", 0.9),
        "NUMBER-PHONE": ("phone_number", 0.8),
        "Work Phone": ("phone_number", round(0.5 + 0.2 / 3, 3)),
    }


def test_names_against_all_pairs(spark):
    """A common word is in most names; the result is the one of comparing all pairs."""
    rnd = random.Random(3)
    words = ["id", "name", "mail", "phone", "city", "date", "sum"]
    make = lambda: "_".join(rnd.sample(words, rnd.randint(1, 3)) + (["id"] if rnd.random() < 0.5 else []))
    source, target = [make() for _ in range(40)], sorted({make().upper() for _ in range(40)})

    def best(t):
        found = []
        for i, s in enumerate(source):
            a, b = list(dict.fromkeys(s.split("_"))), list(dict.fromkeys(t.lower().split("_")))
            if s == t.lower():
                c = 1.0
            elif a == b:
                c = 0.9
            elif sorted(a) == sorted(b):
                c = 0.8
            elif set(a) & set(b):
                c = 0.5 + 0.2 * (1.0 / (len(a) + len(b) - 1))
            else:
                continue
            found.append((c, -i, s))
        return max(found) if found else None

    expected = {t: (b[2], b[0]) for t in target if (b := best(t))}
    s, d = sides(spark, source, target)
    assert {r.destination_field: (r.source_field, r.confidence) for r in suggest_by_name(s, d).collect()} == expected


def test_of_equally_good_columns_the_earlier_one_is_proposed(spark):
    columns = spark.createDataFrame([(1, "ab_c", 1), (1, "abc", 9)], "mapping_id int, source_field string, pos int")
    fields = spark.createDataFrame([(1, "A_BC", 1)], "mapping_id int, destination_field string, pos int")
    row = suggest_by_name(columns, fields).first()
    assert (row["source_field"], row["confidence"]) == ("ab_c", 0.9)
