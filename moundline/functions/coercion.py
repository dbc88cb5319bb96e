"""Casts of untyped columns to the declared types, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a CSV field says when it is missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|Inf|Infinity|INF|INFINITY)$"


def nullified(name: str, kind: T.DataType) -> Column:
    """NaN of a double and missing tokens of a string become NULL."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return F.when(~F.trim(c).isin(NA_TOKENS), c) if isinstance(kind, T.StringType) else c


def number(name: str, kind: T.DataType) -> Column:
    """A double; text that is no number becomes NULL. The pattern keeps out suffixes that Spark would accept."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        plain = F.trim(c)
        return F.when(plain.rlike(NUMBER), F.regexp_replace(plain, r"(?i)inf(inity)?$", "Infinity").try_cast("double"))
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def coerced(name: str, kind: T.DataType, to: T.DataType) -> Column:
    """Integers round half to even and fail beyond their range or on infinity; other text that doesn't fit becomes NULL."""
    if isinstance(to, (T.IntegerType, T.LongType)):
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            return F.col(f"`{name}`").cast(to)
        return F.bround(number(name, kind), 0).cast(to)
    if isinstance(to, T.DoubleType):
        return number(name, kind)
    if isinstance(to, T.DateType):
        if isinstance(kind, T.StringType):
            return F.coalesce(F.try_to_date(F.col(f"`{name}`"), "yyyy-MM-dd"), F.try_to_timestamp(F.col(f"`{name}`")).cast("date"))
        return F.col(f"`{name}`").cast("date")
    return nullified(name, kind) if isinstance(kind, T.StringType) else F.col(f"`{name}`").cast("string")


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Casts the columns of ``schema`` that ``df`` has; the others stay. One projection."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({f.name: coerced(f.name, kinds[f.name], f.dataType) for f in schema if f.name in kinds})
