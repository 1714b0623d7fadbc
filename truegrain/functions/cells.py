"""Missing values and the canonical text of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["is_blank", "is_missing", "js_string", "safe_number", "safe_value", "signature", "truncate"]


def is_missing(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Null or the empty string.  Columns that can't hold text are only null."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype is not None and not isinstance(dtype, T.StringType):
        return c.isNull()
    return c.isNull() | (c.cast("string") == "")


def is_blank(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Missing, white space only, or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def js_string(c: Column | str, dtype: T.DataType) -> Column:
    """Canonical text of a cell: whole doubles without a point, other doubles
    in plain decimals, timestamps in ISO form.  Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        short = c.cast("string")  # plain decimals between these sizes, and no more than 12 of them
        plain = F.when((F.abs(c) >= 0.001) & (F.abs(c) < 1e7) & (F.length(short) <= 13), short).otherwise(F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
        return F.when(F.isnan(c), "NaN").when((F.floor(c) == c) & (F.abs(c) < 1e15), c.cast("long").cast("string")).when(F.abs(c) < 1e15, plain).otherwise(c.cast("string"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def truncate(c: Column, n: int) -> Column:
    """the first ``n`` characters."""
    return F.substring(c, 1, n)


def signature(columns: list[Column]) -> Column:
    """canonical texts joined by ``|``; missing cells are empty."""
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in columns])


def safe_value(c: Column, kind: str) -> Column:
    """struct of ``value``, ``is_null`` and ``parse_error`` for text read as
    number, integer, boolean or date."""
    from .dates import parse_date
    from .numbers import js_number

    text = F.trim(c.cast("string"))
    empty = c.isNull() | (text == "")
    if kind in ("number", "integer"):
        value = js_number(text)
        value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
        value = F.when(value == F.floor(value), value).cast("long") if kind == "integer" else value
    elif kind == "boolean":
        low = F.lower(text)
        value = F.when(low.isin("true", "yes", "1", "y"), True).when(low.isin("false", "no", "0", "n"), False)
    elif kind == "date":
        value = parse_date(text)
    else:
        value = c.cast("string")
    return F.struct(F.when(~empty, value).alias("value"), empty.alias("is_null"), (~empty & value.isNull()).alias("parse_error"))


def safe_number(c: Column, fallback: float = 0.0) -> Column:
    """a finite number, else ``fallback``."""
    value = c.cast("string").try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(fallback)).otherwise(value)
