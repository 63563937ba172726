"""Cleaning: duplicates, missing values, invalid transactions, timestamps, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ledgerwatch.functions.numeric import as_double, is_positive, num, unix_timestamp
from ledgerwatch.session import require_columns


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates. The partial aggregate removes most copies before the shuffle,
    so one row repeated a billion times costs one row per task."""
    return df.dropDuplicates()


def fill_missing(df: DataFrame, value: float = 0, fill_strings: bool = False) -> DataFrame:
    """Null and NaN in numeric columns become ``value``; text columns get its text form
    only on request. Timestamps are never filled."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    filled = df.fillna(value, subset=numeric) if numeric else df
    if fill_strings:
        text = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
        if text:
            filled = filled.fillna(str(value), subset=text)
    return filled


def keep_valid(df: DataFrame, column: str = "value") -> DataFrame:
    """Coerce the column to double and keep the rows above zero."""
    require_columns(df, column)
    return df.withColumn(column, as_double(F.col(column))).where(is_positive(F.col(column)))


def clean(df: DataFrame, fill_value: float = 0, fill_strings: bool = False) -> DataFrame:
    """Duplicates, then missing values, then invalid rows; the order decides the result."""
    require_columns(df, "value")
    return keep_valid(fill_missing(drop_duplicate_rows(df), fill_value, fill_strings))


class CleaningCounts:
    """Row counts of the cleaning steps, filled by the first action on the result."""

    def __init__(self) -> None:
        self._seen = {step: Observation(f"clean_{step}") for step in ("read", "unique", "valid")}

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        return df.observe(self._seen[step], F.count(F.lit(1)).alias("n"))

    @property
    def result(self) -> dict[str, int]:
        counts = {step: seen.get["n"] for step, seen in self._seen.items()}
        counts["duplicates"] = counts["read"] - counts["unique"]
        counts["invalid"] = counts["unique"] - counts["valid"]
        return counts


def clean_with_counts(df: DataFrame, fill_value: float = 0) -> tuple[DataFrame, CleaningCounts]:
    """``clean`` plus counts per step, gathered during the same job."""
    require_columns(df, "value")
    counts = CleaningCounts()
    unique = counts.watch(drop_duplicate_rows(counts.watch(df, "read")), "unique")
    return counts.watch(keep_valid(fill_missing(unique, fill_value)), "valid"), counts


def convert_timestamp(df: DataFrame, column: str = "timeStamp") -> DataFrame:
    """Unix seconds to timestamp; what is not a number becomes null."""
    require_columns(df, column)
    return df.withColumn(column, unix_timestamp(F.col(column)))


def failed_timestamps(df: DataFrame, column: str = "timeStamp") -> DataFrame:
    """How many values ``convert_timestamp`` turns to null."""
    require_columns(df, column)
    bad = unix_timestamp(F.col(column)).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).cast("bigint").alias("failed"),
    )


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale columns to [0, 1] with one aggregate over the table.

    All bounds come back as one struct in one scalar subquery, which Spark runs once and
    puts into the projection as a constant. A constant column becomes 0 everywhere; a
    column without any number raises an error when the result is computed.
    """
    if not columns or not all(columns):
        raise ValueError("column name cannot be empty")
    require_columns(df, *columns)
    bounds = df.agg(F.struct(*[
        part
        for name in columns
        for part in (
            F.min(num(F.col(name))).alias(f"{name}_lo"),
            F.max(num(F.col(name))).alias(f"{name}_hi"),
        )
    ]).alias("bounds")).scalar()

    def scaled(name: str):
        low, high = bounds.getField(f"{name}_lo"), bounds.getField(f"{name}_hi")
        empty = F.raise_error(F.lit(f"column '{name}' contains no numeric data")).cast("double")
        return (
            F.when(low.isNull(), empty)
            .when(low == high, F.lit(0.0))
            .otherwise((num(F.col(name)) - low) / (high - low))
        )

    return df.withColumns({name: scaled(name) for name in columns})


def transform(df: DataFrame, ts: str = "timeStamp") -> DataFrame:
    """Timestamps converted and, where there is a value column, values scaled."""
    converted = convert_timestamp(df, ts)
    return min_max_scale(converted, ["value"]) if "value" in df.columns else converted
