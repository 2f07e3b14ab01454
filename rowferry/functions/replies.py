"""Reading values out of JSON text the way a dynamic language would.

All of it works on VARIANT, so one odd item does not spoil its neighbours as
it would under a fixed ``from_json`` schema. A value is looked at once: ``opened``
puts it beside the name of its kind, and the readers below take that pair.
Column expressions have no local variables, so pairs are made in one projection
(or one step of a ``transform``) and read in the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import integer_of, real_of
from .text import double_text, strip

_JSON_SPACE = " \t\r\n"


# Fixed pattern: how any JSON text starts.
_JSON_START = r'^[ \t\r\n]*[{\["0-9tfn-]'


def parse(text: Column) -> Column:
    """JSON text to VARIANT, null if it is none.

    What cannot be JSON from its first character on (an empty body, an HTML
    page) is not handed to the parser: an exception per row is its slow path.
    """
    return F.when(text.rlike(_JSON_START), F.try_parse_json(text))


def decode(text: Column) -> Column:
    """JSON text to VARIANT, once more if it holds a quoted JSON text; null if invalid."""
    quoted = F.ltrim(text, F.lit(_JSON_SPACE)).startswith('"')
    inner = parse(F.try_variant_get(F.try_parse_json(text), "$", "string"))
    return F.when(quoted, inner).otherwise(parse(text))


def _shape(names: tuple[str, ...]) -> str:
    return f"struct<{','.join(f'{n}:variant' for n in names)}>"


def members(v: Column, *names: str) -> Column:
    """The named members of an object as a struct of VARIANT; null if it is no object.

    An absent member is null, a JSON null is a VARIANT of kind VOID.
    """
    return F.try_variant_get(v, "$", _shape(names))


def objects(v: Column, path: str, *names: str) -> Column:
    """The members of each element of an array of objects; null if it is no array.
    Elements that are no objects are null."""
    return F.coalesce(
        F.try_variant_get(v, path, f"array<{_shape(names)}>"), F.array().cast(f"array<{_shape(names)}>")
    )


def elements(v: Column) -> Column:
    """The elements of a JSON array, else an empty array."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def opened(v: Column) -> Column:
    """(v, k): the value and its kind, one of STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN,
    VOID, OBJECT<..>, ARRAY<..>; the kind is null where there is no value."""
    return F.struct(v.alias("v"), F.schema_of_variant(v).alias("k"))


def _string(o: Column) -> Column:
    return F.try_variant_get(o["v"], "$", "string")


def _double(o: Column) -> Column:
    return F.try_variant_get(o["v"], "$", "double")


def missing(o: Column) -> Column:
    """No such member, or JSON null."""
    return o["k"].isNull() | (o["k"] == "VOID")


def text_only(o: Column) -> Column:
    """The value of a JSON string, else null."""
    return F.when(o["k"] == "STRING", _string(o))


def as_integer(o: Column) -> Column:
    """``int(v)``: numbers and booleans are cut, text must spell an integer."""
    return F.when(o["k"] == "STRING", integer_of(_string(o)).try_cast("bigint")).otherwise(
        F.try_variant_get(o["v"], "$", "bigint")
    )


def as_real(o: Column) -> Column:
    """``float(v)``, null where that fails."""
    return F.when(o["k"] == "STRING", real_of(_string(o))).otherwise(_double(o))


def as_text(o: Column) -> Column:
    """``str(v)``; arrays and objects give their JSON text."""
    k = o["k"]
    return (
        F.when(k.isin("STRING", "BIGINT"), _string(o))
        .when(missing(o), F.lit("None"))
        .when(k == "BOOLEAN", F.initcap(_string(o)))
        .when((k == "DOUBLE") | k.startswith("DECIMAL"), double_text(_double(o)))
        .otherwise(F.to_json(o["v"]))
    )


def as_words(o: Column) -> Column:
    """``str(v or "")`` without white space at the ends."""
    k, json = o["k"], F.to_json(o["v"])
    return (
        F.when(k == "STRING", strip(_string(o)))
        .when(missing(o), F.lit(""))
        .when(k.startswith("OBJECT") | k.startswith("ARRAY"), F.when(json.isin("{}", "[]"), F.lit("")).otherwise(json))
        .when(_double(o) == 0, F.lit(""))
        .otherwise(as_text(o))
    )


def unit_interval(c: Column) -> Column:
    """Clamped to 0..1; NaN counts as 1, as it does where the bound is compared first."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
