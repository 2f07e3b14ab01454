"""Text of a value, and white space, as Python defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Both ends without white space of any kind (``trim`` only knows U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def double_text(c: Column) -> Column:
    """A double as Python prints it.

    Spark writes ``d.dddE±n`` outside 1e-3..1e7, Python outside 1e-4..1e16, so
    only the position of the point moves; the digits are Spark's.
    """
    raw = c.cast("string")
    sign = F.when(raw.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    unsigned = F.ltrim(raw, F.lit("-"))
    mantissa = F.substring_index(unsigned, "E", 1)
    exponent = F.substring_index(unsigned, "E", -1).try_cast("int")
    fraction = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(F.substring_index(mantissa, ".", 1), fraction)
    whole = F.rpad(digits, exponent + 1, "0")
    rest = F.substring(digits, exponent + 2, F.length(digits))
    plain_large = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    plain_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    moved = (
        F.when((exponent < -4) | (exponent >= 16), scientific)
        .when(exponent < 0, plain_small)
        .otherwise(plain_large)
    )
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(raw == "Infinity", F.lit("inf"))
        .when(raw == "-Infinity", F.lit("-inf"))
        .when(raw.contains("E"), F.concat(sign, moved))
        .otherwise(raw)
    )


def timestamp_text(c: Column, dtype: T.DataType, separator: str) -> Column:
    """A timestamp with microseconds only where there are some, and the offset
    only where the type carries a zone."""
    # The cast drops trailing zeros of the fraction: 19 characters or up to 26.
    raw = c.cast("string")
    text = F.when(F.length(raw) > 19, F.rpad(raw, 26, "0")).otherwise(raw)
    if separator != " ":
        text = F.translate(text, " ", separator)
    return F.concat(text, F.date_format(c, "xxx")) if isinstance(dtype, T.TimestampType) else text


def as_text(c: Column, dtype: T.DataType) -> Column:
    """``str(value)`` for a column of the given type; null stays null."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return double_text(c.cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c, dtype, " ")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")
