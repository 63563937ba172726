"""The flagship flows: clean, derive features, score, grade; and the whole batch pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.classify import transaction_severity
from ledgerwatch.functions.features import BASE_FEATURES, MODEL_FEATURES, with_model_features
from ledgerwatch.operators import forest, series
from ledgerwatch.operators.clean import clean, transform
from ledgerwatch.session import materialise, spread
from ledgerwatch.sources.views import Views


def severity_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions by severity and label: counts, value and mean score."""
    tx = with_model_features(clean(Views(spark, folder).tx))
    rows = spread(tx.select("hash", *dict.fromkeys([*MODEL_FEATURES, "value", "gas_price"])), "hash")
    _, detected = forest.fit_detect(rows, MODEL_FEATURES)
    graded = detected.withColumn("severity", transaction_severity(F.col("value"), F.col("gas_price")))
    return graded.groupBy("severity", "anomaly").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"),
        F.avg("anomaly_score").alias("avg_score"),
    )


@dataclass(frozen=True)
class BatchResult:
    """What one run of the batch pipeline leaves."""

    model: forest.Forest
    labelled: DataFrame
    forecast: DataFrame
    plot: DataFrame


def batch_pipeline(
    raw: DataFrame, ts: str = "time_stamp", contamination: float = 0.01, steps: int = 10, seed: int = 42,
) -> BatchResult:
    """Raw records to labels, forecast and plot data: clean, transform, detect, forecast.

    ``raw`` has a hash, the time as Unix seconds and the model's features as numbers. Values
    are scaled before detection and forecast; the plot has the dense daily series with the
    number of anomalies of each day.
    """
    done = transform(clean(raw), ts)
    scaled = materialise(spread(done, "hash"), "pipeline")
    model, labelled = forest.fit_detect(scaled, BASE_FEATURES, contamination, seed)
    daily = series.daily_series(scaled, ts=ts)
    marked = labelled.where("anomaly = 'anomaly'").groupBy(F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("anomalies"))
    plot = daily.join(marked, "day", "left").withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))
    return BatchResult(model, labelled, series.forecast(daily, steps=steps), plot)
