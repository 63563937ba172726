"""The newest live entries of an anomaly table: bounded size, bounded age."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.ordered import newest_per_group
from ledgerwatch.operators.stats import BUFFER_SIZE, BUFFER_TTL_SECONDS


def _live(entries: DataFrame, as_of: datetime, ttl_seconds: int, inserted_at: str) -> DataFrame:
    """Entries not older than the TTL; one exactly that old still counts."""
    ts = F.col(inserted_at)
    now = F.lit(as_of).cast("timestamp")
    return entries.where((ts <= now) & (ts >= now - F.expr(f"interval {int(ttl_seconds)} seconds")))


def live_entries(
    entries: DataFrame, as_of: datetime, max_size: int = BUFFER_SIZE,
    ttl_seconds: int = BUFFER_TTL_SECONDS, severity: str | None = None, limit: int | None = None,
    key: str = "tx_hash", inserted_at: str = "detected_at",
) -> DataFrame:
    """Newest first. The size bound applies before the severity filter, as in a buffer that
    holds all severities together."""
    newest = (
        _live(entries, as_of, ttl_seconds, inserted_at)
        .orderBy(F.desc(inserted_at), F.asc(key)).limit(max_size)
    )
    if severity is not None:
        newest = newest.where(F.col("severity") == severity)
    return newest if limit is None else newest.orderBy(F.desc(inserted_at), F.asc(key)).limit(limit)


def live_by_severity(
    entries: DataFrame, as_of: datetime, max_size: int = BUFFER_SIZE,
    ttl_seconds: int = BUFFER_TTL_SECONDS, key: str = "tx_hash", inserted_at: str = "detected_at",
) -> DataFrame:
    """One bounded view per severity, so that many minor ones cannot evict the critical."""
    return newest_per_group(
        _live(entries, as_of, ttl_seconds, inserted_at), ["severity"],
        [F.desc(inserted_at), F.asc(key)], max_size, F.col(key),
    )
