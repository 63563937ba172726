"""Retraining: rows of a period, features, search, fit, evaluation, a new version."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.features import BASE_FEATURES, MODEL_FEATURES, with_model_features
from ledgerwatch.operators import forest
from ledgerwatch.operators.clean import min_max_scale
from ledgerwatch.operators.evaluate import anomaly_evaluation
from ledgerwatch.operators.prefix import exact_quantile
from ledgerwatch.session import materialise, spread

MIN_TRAINING_ROWS = 1000


def training_features(tx: DataFrame) -> DataFrame:
    """Scaled base features first, then the ratio of the scaled ones and the calendar."""
    return with_model_features(min_max_scale(tx, BASE_FEATURES)).select("hash", *MODEL_FEATURES)


def next_version(versions: DataFrame, model_id: int) -> str:
    count = versions.where(F.col("model_id") == model_id).count()
    return f"1.0.{count}"


def retrain(
    tx: DataFrame, versions: DataFrame, model_id: int, path: str,
    start: datetime, end: datetime, tune: bool = True, trials: int = 20,
    contamination: float = 0.01, seed: int = 42,
) -> tuple[forest.Forest, DataFrame]:
    """(the fitted forest, its row for the table of versions).

    The features are written once to the shared folder, in even parts: search, fit and
    evaluation each read them, and a lost executor costs no recomputation of the scaling.
    """
    period = tx.where(F.col("timestamp").between(F.lit(start), F.lit(end)))
    rows = materialise(spread(training_features(period), "hash"), "training")
    total = rows.count()
    if total < MIN_TRAINING_ROWS:
        raise ValueError(f"insufficient training data: {total} rows, {MIN_TRAINING_ROWS} needed")
    if tune:
        _, model = forest.tune(rows, MODEL_FEATURES, trials, seed, contamination=contamination)
    else:
        model = forest.fit(rows, MODEL_FEATURES, contamination, seed, threshold="none")
    scored = materialise(forest.score(rows, model), "training-scores")
    model.threshold = exact_quantile(scored, "anomaly_score", contamination)
    checksum = forest.save(tx.sparkSession, model, path)
    quality = anomaly_evaluation(
        forest.labelled(scored, model), F.col("anomaly") == "anomaly", "anomaly_score"
    )
    names = [c for c in quality.columns if c != "num_samples"]
    metrics = F.map_from_arrays(
        F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("double") for c in names])
    )
    parameters = F.create_map(
        F.lit("contamination"), F.lit(contamination),
        F.lit("n_estimators"), F.lit(float(model.trees)), F.lit("max_samples"), F.lit(float(model.rows)),
    )
    row = quality.select(
        F.lit(model_id).alias("model_id"), F.lit(next_version(versions, model_id)).alias("version"),
        F.lit(path).alias("storage_path"), F.lit(checksum).alias("checksum"),
        F.col("num_samples").alias("training_dataset_size"),
        parameters.alias("hyperparameters"), metrics.alias("metrics"),
        F.lit(False).alias("is_deployed"), F.lit(0.0).alias("traffic_percentage"),
    )
    return model, row
