"""Presets against the Python rules they follow."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.presets import apply_preset
from rowferry.functions.text import WHITESPACE
from rowferry.operators.mapping import apply_mapping, resolve
from rowferry.spec import FieldMap, field_maps

# Text and the number it spells; what spells none is kept as it is.
NUMBERS = {
    " 42 ": 42, "+5": 5, "-5": -5, "007": 7, "1_000": 1000, "3.": 3.0, ".5": 0.5, "1e3": 1000.0,
    "12345678901234567890": 12345678901234567890,
    "99999999999999999999999999999999999999": 99999999999999999999999999999999999999, "\t7\n": 7, "\xa08\xa0": 8,
    "3.14": 3.14, "1_0.5_0": 10.5,
}
NUMBERS_KEPT = [
    "1__000", "_1", "1_", ".", "1e", "5d", "5f", "5L", "0x10", "infinit", "1,000", "- 5", "", "twelve",
]
# Text and the moment it spells; what spells none is kept as it is.
DATES = {
    "2031-10-24": "2031-10-24T00:00:00", "24.10.2031": "2031-10-24T00:00:00", "2031-4-7": "2031-04-07T00:00:00",
    "2031-4-7 1:2:3": "2031-04-07T01:02:03", "2031-10-24  12:30:05": "2031-10-24T12:30:05",
    "7.4.2031": "2031-04-07T00:00:00", "24/10/2031": "2031-10-24T00:00:00", "2024-02-29": "2024-02-29T00:00:00",
    "2031-10-24t12:30:00": "2031-10-24T12:30:00", "  2031-10-24 ": "2031-10-24T00:00:00",
    "2031-04- 7": "2031-04-07T00:00:00", "2031-10-24\t12:30:05": "2031-10-24T12:30:05",
}
DATES_KEPT = [
    "024.10.2031", "10/24/2031", "2026-02-30", "2023-02-29", "31-10-24", "2031-10-24T12:30:00Z",
    "2031-10-24T12:30:00.123", "2031-10-24T24:00:00", "2031-10-24T12:30:60", "0000-01-01", "", "2031-04-  7",
    "2031-10- 24", "31.11.2026", "2026-13-01", "some day",
]


def run(spark, values, preset, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    out = apply_preset(F.col("v"), df.schema["v"].dataType, preset)
    return [r[0] for r in df.select(out.alias("o"), "i").orderBy("i").select("o").collect()]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_trim(spark):
    values = [f"{w}a{w}b{w}" for w in WHITESPACE] + ["", "  ", "x"]
    assert run(spark, values, "trim") == [v.strip() for v in values]


def test_case(spark):
    values = ["Ana.Lima@Post.example", "İstanbul", "straße", "ΟΔΟΣ", "Ǆ", ""]
    assert run(spark, values, "lowercase") == [v.lower() for v in values]
    assert run(spark, values, "uppercase") == [v.upper() for v in values]


def test_to_number(spark):
    expected = {**NUMBERS, **{text: text for text in NUMBERS_KEPT}}
    df = spark.createDataFrame([(v,) for v in expected], "v string")
    number = apply_preset(F.col("v"), T.StringType(), "to_number")
    for row in df.select("v", F.to_json(F.struct(number.alias("x"))).alias("j")).collect():
        found = json.loads(row.j)["x"]
        assert (type(found), found) == (type(expected[row.v]), expected[row.v]), row.v


@pytest.mark.parametrize("text", ["nan", "-nan", "inf", "-Infinity", "1e400"])
def test_to_number_not_finite(spark, text):
    df = spark.createDataFrame([(text,)], "v string")
    number = apply_preset(F.col("v"), T.StringType(), "to_number")
    found = df.select(F.try_variant_get(number, "$", "double")).first()[0]
    assert str(found) == str(float(text))


def test_to_number_keeps_typed_numbers(spark):
    df = spark.sql("select 7 i, 1.5D d, true b, cast(5 as decimal(10,0)) w, cast(5.00 as decimal(10,2)) f")
    out = apply_mapping(df, [FieldMap(c, c, "to_number") for c in df.columns])
    assert tuple(out.first()) == (7, 1.5, True, 5, 5.0)
    assert out.schema["f"].dataType == T.DoubleType()


def test_parse_date(spark):
    assert run(spark, list(DATES), "parse_date") == list(DATES.values())
    assert run(spark, DATES_KEPT, "parse_date") == DATES_KEPT


def test_parse_date_of_any_moment(spark):
    # A moment written in a known layout comes back; with a letter in it, the text stays.
    rnd, whole_days = random.Random(7), ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y")
    texts, expected = [], []
    for _ in range(400):
        moment = datetime(1000, 1, 1) + timedelta(seconds=rnd.randrange(0, 3_600 * 24 * 365 * 8000))
        layout = rnd.choice((*whole_days, "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"))
        if layout in whole_days:
            moment = moment.replace(hour=0, minute=0, second=0)
        texts.append(moment.strftime(layout))
        expected.append(moment.isoformat())
    assert run(spark, texts, "parse_date") == expected
    spoiled = [text[: i % len(text)] + "x" + text[i % len(text) :] for i, text in enumerate(texts)]
    assert run(spark, spoiled, "parse_date") == spoiled



def test_parse_date_of_typed_columns(spark):
    df = spark.sql(
        "select timestamp_ntz'2031-10-24 12:30:00' a, timestamp_ntz'2031-10-24 12:30:00.1' b, "
        "timestamp'2031-10-24 12:30:00' c, date'2031-10-24' d, 20260819 e"
    )
    out = apply_mapping(df, [FieldMap(c, c, "parse_date") for c in df.columns]).first()
    assert tuple(out) == (
        "2031-10-24T12:30:00", "2031-10-24T12:30:00.100000", "2031-10-24T12:30:00+00:00", "2031-10-24T00:00:00", 20260819,
    )


def test_to_string(spark):
    doubles = [0.0, -0.0, 1e7, 1e16, 1e-3, 1e-4, 1e-5, 123456789.25, -1.5e-7, 1e22, 1e100, -12345678.9, 12345678.0, 0.1]
    assert run(spark, doubles, "to_string", "double") == [str(v) for v in doubles]
    odd = [float("nan"), float("inf"), -float("inf")]
    assert run(spark, odd, "to_string", "double") == ["nan", "inf", "-inf"]
    assert run(spark, [True, False, None], "to_string", "boolean") == ["True", "False", None]
    assert run(spark, [date(2031, 10, 24)], "to_string", "date") == ["2031-10-24"]
    moments = [datetime(2031, 10, 24, 12, 30), datetime(2031, 10, 24, 12, 30, 0, 100000)]
    assert run(spark, moments, "to_string", "timestamp_ntz") == [str(m) for m in moments]


@pytest.mark.parametrize("preset", ["lowercase", "uppercase", "trim", "to_string", "to_number", "parse_date"])
def test_null_stays_null(spark, preset):
    assert run(spark, [None], preset) == [None]


@pytest.mark.parametrize("preset", ["", None, "reverse", "split_name(1)"])
def test_no_preset(spark, preset):
    assert run(spark, ["Good day"], preset) == ["Good day"]


def test_mapping_two_presets(spark):
    df = spark.createDataFrame([("Ana.Lima@Post.example", "42")], "email string, age string")
    out = apply_mapping(df, [FieldMap("email", "EMAIL", "lowercase"), FieldMap("age", "AGE", "to_number")])
    assert out.select("EMAIL", F.to_json(F.struct("AGE"))).first()[:] == ("ana.lima@post.example", '{"AGE":42}')


def test_stored_items():
    items = [{"source_field": "a", "destination_field": "A"}, {"source_field": "b", "destination_field": "B", "transformation": "trim"}]
    assert field_maps(items) == (FieldMap("a", "A"), FieldMap("b", "B", "trim"))
    for wrong in ({"source_field": "a"}, {"destination_field": "A"}, {"source_field": "", "destination_field": "A"}):
        with pytest.raises(ValueError):
            field_maps([wrong])


def test_mapping_missing_column_and_case(spark):
    df = spark.createDataFrame([("a",)], "email string")
    out = apply_mapping(df, [FieldMap("email", "EMAIL"), FieldMap("phone", "PHONE"), FieldMap("Email", "OTHER")])
    assert out.columns == ["EMAIL"]


def test_mapping_empty(spark):
    assert apply_mapping(spark.range(2), []).columns == []


def test_mapping_last_wins_at_first_place(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = apply_mapping(df, [FieldMap("a", "X"), FieldMap("a", "Y"), FieldMap("b", "X")])
    assert out.columns == ["X", "Y"] and tuple(out.first()) == (2, 1)


def test_mapping_names_with_dots_and_both_spellings_of_id(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c`d"])
    record = resolve(df, [FieldMap("a.b", "ID"), FieldMap("c`d", "id")])
    assert list(record.fields) == ["ID", "id"]
    assert df.select(record.column("ID"), record.column("id")).first()[:] == (1, 2)
