"""The number preset: integer, else double, else the value as it was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

# Fixed patterns: the literals Python's int() and float() accept.
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
REAL = (
    r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
SHORT_INTEGER = r"^[+-]?[0-9]{1,18}$"
INFINITE = r"(?i)^[+-]?(inf|infinity)$"
NOT_A_NUMBER = r"(?i)^[+-]?nan$"


def _digits(t: Column) -> Column:
    return F.replace(t, F.lit("_"), F.lit(""))


def integer_of(text: Column) -> Column:
    """The integer a text spells, as decimal(38,0), else null."""
    t = strip(text)
    return F.when(t.rlike(INTEGER), _digits(t).try_cast("decimal(38,0)"))


def real_of(text: Column) -> Column:
    """The double a text spells, else null.

    Spark alone would also take ``5d`` and refuse ``1_000``; the patterns
    decide, the cast only converts.
    """
    t = strip(text)
    return F.when(t.rlike(REAL) | t.rlike(INFINITE), _digits(t).try_cast("double")).when(
        t.rlike(NOT_A_NUMBER), F.lit(float("nan"))
    )


def number_parts(text: Column) -> tuple[Column, Column, Column]:
    """(integer, double, leftover text): at most one of them is not null."""
    whole = integer_of(text)
    # An integer of 39 digits or more does not fit a decimal and stays text.
    real = F.when(~strip(text).rlike(INTEGER), real_of(text))
    leftover = F.when(whole.isNull() & real.isNull(), text)
    return whole, real, leftover


def _narrow(digits: Column) -> Column:
    """An integer as VARIANT: bigint where it fits, else decimal(38,0), else null."""
    return F.coalesce(digits.try_cast("bigint").cast("variant"), digits.try_cast("decimal(38,0)").cast("variant"))


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Text becomes VARIANT (integer, double or text per row). Numbers keep
    their type; a decimal becomes an integer or a double by its scale."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        # One chain, most frequent spelling first: a row tries no pattern twice.
        t = strip(c)
        original = c.cast("variant")
        return (
            F.when(t.rlike(SHORT_INTEGER), t.try_cast("bigint").cast("variant"))
            .when(t.rlike(INTEGER), F.coalesce(_narrow(_digits(t)), original))
            .when(t.rlike(REAL) | t.rlike(INFINITE), _digits(t).try_cast("double").cast("variant"))
            .when(t.rlike(NOT_A_NUMBER), F.lit(float("nan")).cast("variant"))
            .otherwise(original)
        )
    if isinstance(dtype, T.DecimalType):
        return c.cast(T.DecimalType(dtype.precision, 0)) if dtype.scale == 0 else c.cast("double")
    return c
