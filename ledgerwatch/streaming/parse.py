"""Parsing and validating transaction records; the same code serves batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.numeric import as_double
from ledgerwatch.schemas import STREAM_MESSAGE

REQUIRED = ("hash", "value", "gas", "gasPrice")
NUMERIC = ("value", "gas", "gasPrice")


def from_json_text(messages: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object per row to one text column per known key.

    The text itself is kept as ``raw`` so that rejected records can be looked at.
    """
    raw = F.col(column).cast("string")
    carried = [c for c in messages.columns if c not in (column, *STREAM_MESSAGE.names)]
    parsed = messages.select(
        *carried, raw.alias("raw"),
        F.from_json(raw, STREAM_MESSAGE, {"mode": "PERMISSIVE"}).alias("_m"),
    )
    return parsed.select(*carried, "raw", "_m.*")


def _reason(columns: list[str]) -> Column:
    missing = [
        F.when(F.col(c).isNull(), F.lit(f"missing {c}")) if c in columns else F.lit(f"missing {c}")
        for c in REQUIRED
    ]
    invalid = [
        F.when(as_double(F.col(c)).isNull(), F.lit(f"invalid {c}")) for c in NUMERIC if c in columns
    ]
    return F.coalesce(*missing, *invalid)


def validate(records: DataFrame, arrived: Column | None = None) -> DataFrame:
    """Typed records with a ``reason`` column that is null for the good ones.

    Required are hash, value, gas and gasPrice, the last three as numbers. Absent optional
    fields get their defaults: empty addresses, block 0, and the arrival time.
    """
    have = records.columns
    now = F.current_timestamp() if arrived is None else arrived

    def optional(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    typed = {
        "hash": F.col("hash") if "hash" in have else F.lit(None).cast("string"),
        **{
            c: as_double(F.col(c)) if c in have else F.lit(None).cast("double") for c in NUMERIC
        },
        "from": optional("from", F.lit("")),
        "to": optional("to", F.lit("")),
        "timestamp": F.coalesce(
            F.col("timestamp").try_cast("timestamp") if "timestamp" in have
            else F.lit(None).cast("timestamp"),
            now.cast("timestamp"),
        ),
        "blockNumber": F.coalesce(
            F.col("blockNumber").try_cast("bigint") if "blockNumber" in have
            else F.lit(None).cast("bigint"),
            F.lit(0).cast("bigint"),
        ),
    }
    extra = [c for c in have if c not in typed]
    return records.select(
        *extra, *[col.alias(name) for name, col in typed.items()], _reason(have).alias("reason")
    )


def good_records(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNull()).drop("reason", "raw")


def rejected_records(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull())
