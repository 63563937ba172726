"""Model features derived from one transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.session import require_columns

BASE_FEATURES = ("value", "gas", "gas_price")
MODEL_FEATURES = (*BASE_FEATURES, "value_per_gas", "hour_of_day", "day_of_week")

_EPSILON = 1e-10


def value_per_gas(value: Column, gas: Column) -> Column:
    return value / (gas + F.lit(_EPSILON))


def with_model_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add the ratio and the calendar features; Monday is day 0."""
    require_columns(df, "value", "gas", ts)
    return df.withColumns({
        "value_per_gas": value_per_gas(F.col("value"), F.col("gas")),
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
    })


def with_extended_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Ratios, weekend flag, logarithms and products."""
    require_columns(df, *BASE_FEATURES, ts)
    value, gas, price = (F.col(c) for c in BASE_FEATURES)
    return df.withColumns({
        "gas_price_per_unit": price / (gas + 1),
        "value_per_gas": value / (gas + 1),
        "gas_efficiency": value / (price + 1),
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "is_weekend": F.weekday(ts).isin(5, 6).cast("int"),
        "value_log": F.log1p(value),
        "gas_log": F.log1p(gas),
        "gas_price_log": F.log1p(price),
        "value_gas_interaction": value * gas,
        "gas_price_interaction": gas * price,
    })
