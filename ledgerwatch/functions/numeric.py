"""Numeric and time coercion that never fails a job on a bad value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col: Column) -> Column:
    """Text or number to double; a bad value becomes null, infinity survives."""
    return col.try_cast("double")


def num(col: Column) -> Column:
    """``as_double`` with NaN turned to null, so that min, max and avg skip it."""
    value = as_double(col)
    return F.when(~F.isnan(value), value)


def is_positive(col: Column) -> Column:
    """True for numbers above zero. Spark orders NaN above every number, so test it."""
    value = as_double(col)
    return F.coalesce(~F.isnan(value) & (value > 0), F.lit(False))


def unix_timestamp(col: Column) -> Column:
    """Unix seconds to timestamp, null when the text is not a number."""
    return F.timestamp_seconds(as_double(col))


def seconds_of(col: Column) -> Column:
    """Timestamp to fractional Unix seconds."""
    return F.unix_micros(col.cast("timestamp")) / F.lit(1e6)


def safe_divide(top: Column, bottom: Column, default: float = 0.0) -> Column:
    """``top / bottom``, or the default when the divisor is zero or null."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(default))


def rounded(col: Column, digits: int = 6) -> Column:
    """Round and drop the sign of a negative zero."""
    return F.round(col, digits) + F.lit(0.0)
