"""Evaluation of anomaly labels, classes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.numeric import safe_divide
from ledgerwatch.operators.prefix import running_sums


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def anomaly_evaluation(scored: DataFrame, is_anomaly: Column, score: str = "score") -> DataFrame:
    """Counts, rate and the distribution of scores (population deviation)."""
    flagged = _n(is_anomaly)
    return scored.agg(
        F.count(F.lit(1)).alias("num_samples"),
        flagged.alias("num_anomalies_detected"),
        (F.count(F.lit(1)) - flagged).alias("num_normal_detected"),
        safe_divide(flagged, F.count(F.lit(1))).alias("anomaly_rate"),
        F.avg(score).alias("mean_anomaly_score"),
        F.stddev_pop(score).alias("std_anomaly_score"),
        F.min(score).alias("min_anomaly_score"),
        F.max(score).alias("max_anomaly_score"),
        (F.max(score) - F.min(score)).alias("score_range"),
    )


def binary_evaluation(labelled: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Confusion counts and precision, recall, F1 for boolean columns; 0 where undefined."""
    tp, fp = _n(truth & predicted), _n(~truth & predicted)
    tn, fn = _n(~truth & ~predicted), _n(truth & ~predicted)
    return labelled.agg(
        tp.alias("true_positives"), fp.alias("false_positives"),
        tn.alias("true_negatives"), fn.alias("false_negatives"),
        safe_divide(tp, tp + fp).alias("precision"),
        safe_divide(tp, tp + fn).alias("recall"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def confusion_matrix(labelled: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    return labelled.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_evaluation(labelled: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Precision, recall and F1 averaged over classes by their support.

    Everything after the confusion counts works on at most classes x classes rows.
    """
    cells = confusion_matrix(labelled, truth, predicted)
    as_true = cells.select(
        F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
        F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hits"),
    )
    as_predicted = cells.select(
        F.col(predicted).alias("label"), F.lit(0).alias("support"),
        F.col("n").alias("predicted"), F.lit(0).alias("hits"),
    )
    per_class = as_true.unionByName(as_predicted).groupBy("label").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("support", "predicted", "hits")]
    )
    total = F.sum("support")

    def weighted(score: Column) -> Column:
        return safe_divide(F.sum(score * F.col("support")), total)

    hits, support, guessed = F.col("hits"), F.col("support"), F.col("predicted")
    return per_class.agg(
        weighted(safe_divide(hits, guessed)).alias("precision"),
        weighted(safe_divide(hits, support)).alias("recall"),
        weighted(safe_divide(2 * hits, support + guessed)).alias("f1_score"),
        total.alias("n"),
    )


def roc_auc(labelled: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the ROC curve when there are exactly two classes, else null.

    Equal scores share one rank. The larger label is the positive class. The count of
    negatives below each score comes from running sums over score ranges.
    """
    classes = labelled.select(truth).where(F.col(truth).isNotNull()).distinct()
    two = classes.agg(F.struct(
        F.max(truth).alias("positive"), F.count(F.lit(1)).alias("n")
    ).alias("c")).scalar()
    marked = labelled.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(
        F.col(score).cast("double").alias("x"),
        (F.col(truth) == two.getField("positive")).cast("bigint").alias("pos"),
        (F.col(truth) != two.getField("positive")).cast("bigint").alias("neg"),
    )
    sums = running_sums(marked, [], "x", ["pos", "neg"])
    below = F.col("neg_upto") - F.col("neg") + F.col("neg") / F.lit(2.0)
    area = safe_divide(
        F.sum(F.col("pos") * below),
        (F.max("pos_total") * F.max("neg_total")).cast("double"),
    )
    return sums.agg(
        F.when(two.getField("n") == 2, area).alias("roc_auc")
    )
