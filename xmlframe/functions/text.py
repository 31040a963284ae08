"""Text forms of scalars, and measures of text, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.names import SPACE, ranges


def js_trim(col: Column) -> Column:
    """Without white space of any kind at the ends."""
    space = ranges(SPACE, java=True)
    return F.regexp_replace(col, rf"\A[{space}]+|[{space}]+\z", "")


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(col) + F.regexp_count(col, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def number_text(col: Column) -> Column:
    """A floating number as ECMAScript writes it: 412, 0.5, 1e-7, 1e+21."""
    java = F.abs(col).cast("string")
    mantissa, power = F.substring_index(java, "E", 1), F.substring_index(java, "E", -1).cast("int")
    whole = F.replace(mantissa, F.lit("."), F.lit(""))
    digits = F.regexp_replace(whole, r"0+\z", "")
    n, point = F.length(digits), power + 1
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(""), F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    long = (
        F.when((point > 0) & (point <= 21), F.when(n <= point, F.rpad(digits, point, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(400)))))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(scientific)
    )
    plain = F.regexp_replace(java, r"\.0\z", "")
    text = F.when(java.contains("E"), long).otherwise(plain)
    return F.when(F.isnan(col), "NaN").when(col == 0, "0").when(col < 0, F.concat(F.lit("-"), text)).otherwise(text)


def scalar_text(col: Column, kind: T.DataType) -> Column:
    """The text that a scalar has in a document; null stays null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text(col)
    if isinstance(kind, T.BinaryType):
        return F.base64(col)
    return col.cast("string")
