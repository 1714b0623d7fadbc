"""Number parsing, rounding and order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["first_digit", "is_numeric_type", "js_number", "loses_precision", "parse_float", "rounded", "zscore"]

PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def is_numeric_type(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def parse_float(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """the number that a cell begins with, as a finite double; null if none.
    ``12abc`` is 12 and an ISO date is its year."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype is not None and is_numeric_type(dtype):
        d = c.cast("double")
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)
    d = F.regexp_extract(c.cast("string"), PREFIX, 1).try_cast("double")
    return F.when(F.abs(d) == float("inf"), None).otherwise(d)


def js_number(c: Column) -> Column:
    """Whole text as a number: blank is 0, hexadecimal allowed, null if none."""
    text = F.trim(c.cast("string"))
    hexed = F.conv(F.regexp_extract(text, "^0[xX]([0-9a-fA-F]{1,15})$", 1), 16, 10).try_cast("double")
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(text == "", 0.0).when(text.rlike("^0[xX][0-9a-fA-F]+$"), hexed).otherwise(plain)


def rounded(c: Column, digits: int = 0) -> Column:
    """Half up, alike in every engine: floor(x * 10^k + 0.5) / 10^k."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """distance from the mean in standard deviations; null if there are none."""
    return F.when(std > 0, (value - mean) / std)


def first_digit(c: Column) -> Column:
    """The first digit character of a cell's text; 0 and none give null."""
    d = F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 1)
    return F.when(d.between("1", "9"), d.try_cast("int"))


def loses_precision(c: Column) -> Column:
    """text of more than 15 digits that a double can't hold."""
    text = F.trim(c.cast("string"))
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    return text.rlike(r"^-?\d+(\.\d+)?$") & (digits > 15) & (text.try_cast("double").try_cast("decimal(38,0)").cast("string") != text)
