"""Joins between transactions, anomalies and predictions.

No broadcast hints: both sides may grow with the data, so adaptive execution decides from
measured sizes and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.numeric import safe_divide
from ledgerwatch.session import require_columns

PREDICTION_TTL_SECONDS = 7200


def with_transaction(anomalies: DataFrame, tx: DataFrame) -> DataFrame:
    """Each anomaly with its transaction, where there is one."""
    side = tx.select(
        F.col("hash").alias("tx_hash"), "block_number", "timestamp", "from_address",
        "to_address", "value", "gas", "gas_price",
    )
    return anomalies.join(side, "tx_hash", "left")


def label_by_anomaly(tx: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Every transaction with a flag and, if flagged, its latest severity and score."""
    latest = anomalies.groupBy(F.col("tx_hash").alias("hash")).agg(
        F.max(F.struct("detected_at", "model_version_id", "severity", "anomaly_score")).alias("_a")
    )
    return tx.join(latest, "hash", "left").withColumns({
        "is_anomaly": F.col("_a").isNotNull(),
        "severity": F.col("_a.severity"),
        "anomaly_score": F.col("_a.anomaly_score"),
    }).drop("_a")


def live_predictions(
    predictions: DataFrame, as_of: datetime, ttl_seconds: int = PREDICTION_TTL_SECONDS,
) -> DataFrame:
    """The newest prediction per hash that has not expired at ``as_of``."""
    require_columns(predictions, "hash", "created_at")
    since = F.lit(as_of) - F.expr(f"interval {int(ttl_seconds)} seconds")
    others = [c for c in predictions.columns if c not in ("hash", "created_at")]
    kept = predictions.where((F.col("created_at") > since) & (F.col("created_at") <= F.lit(as_of)))
    return kept.groupBy("hash").agg(
        F.max(F.struct("created_at", *others)).alias("_p")
    ).select("hash", "_p.*")


def split_by_cache(
    tx: DataFrame, predictions: DataFrame, as_of: datetime,
    ttl_seconds: int = PREDICTION_TTL_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """(requests answered by a live prediction, requests still to be scored)."""
    live = live_predictions(predictions, as_of, ttl_seconds)
    return tx.select("hash").join(live, "hash"), tx.join(live.select("hash"), "hash", "left_anti")


def predict_missing(
    tx: DataFrame, predictions: DataFrame, as_of: datetime,
    score_fn: Callable[[DataFrame], DataFrame], ttl_seconds: int = PREDICTION_TTL_SECONDS,
) -> DataFrame:
    """Live predictions together with freshly scored rows, each tagged by origin."""
    cached, missing = split_by_cache(tx, predictions, as_of, ttl_seconds)
    columns = ["hash", "is_anomaly", "confidence", "anomaly_score"]
    return cached.select(*columns, F.lit(True).alias("from_cache")).unionByName(
        score_fn(missing).select(*columns, F.lit(False).alias("from_cache"))
    )


def compare_metrics(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Difference and percent change of the metrics that two one-row tables share."""
    shared = [n for n in names if n in left.columns and n in right.columns]
    if not shared:
        raise ValueError("the two metric sets share no name")

    def long(df: DataFrame, value: str) -> DataFrame:
        values = df.select(*[F.col(n).cast("double").alias(n) for n in shared])
        return values.unpivot([], shared, "metric", value)

    both = long(left, "model1").join(long(right, "model2"), "metric")
    change = F.col("model2") - F.col("model1")
    return both.select(
        "metric", "model1", "model2", change.alias("difference"),
        safe_divide(change * 100, F.col("model1")).alias("percent_change"),
    )
