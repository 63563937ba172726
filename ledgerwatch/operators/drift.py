"""Feature, concept and performance drift between a reference and a detection window.

Both windows come from one scan: each row carries a 0/1 weight per window, so a row on the
boundary counts in both without being duplicated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.classify import SEVERITIES
from ledgerwatch.functions.features import BASE_FEATURES
from ledgerwatch.functions.numeric import num, rounded, safe_divide
from ledgerwatch.operators.prefix import running_sums, value_counts
from ledgerwatch.operators.stats import bin_index
from ledgerwatch.session import materialise

# Levels above which a change counts as drift, and the number of bins.
KS_LEVEL = 0.05
PSI_LIMIT = 0.2
PSI_BINS = 10
_SMALL = 1e-10


@dataclass(frozen=True)
class Periods:
    """Reference window before the detection window; all four ends belong to them."""

    as_of: datetime
    reference_days: int = 30
    detection_days: int = 7

    @property
    def detection_start(self) -> datetime:
        return self.as_of - timedelta(days=self.detection_days)

    @property
    def reference_start(self) -> datetime:
        return self.detection_start - timedelta(days=self.reference_days)

    def in_reference(self, ts: Column) -> Column:
        return ts.between(F.lit(self.reference_start), F.lit(self.detection_start))

    def in_detection(self, ts: Column) -> Column:
        return ts.between(F.lit(self.detection_start), F.lit(self.as_of))

    def within(self, ts: Column) -> Column:
        return ts.between(F.lit(self.reference_start), F.lit(self.as_of))


def tagged(tx: DataFrame, periods: Periods, ts: str = "timestamp") -> DataFrame:
    """The rows of both windows with the weights ``ref`` and ``det``."""
    col = F.col(ts)
    return tx.where(periods.within(col)).withColumns({
        "ref": periods.in_reference(col).cast("bigint"),
        "det": periods.in_detection(col).cast("bigint"),
    })


def window_counts(tagged_rows: DataFrame) -> DataFrame:
    counts = tagged_rows.agg(
        F.coalesce(F.sum("ref"), F.lit(0)).cast("bigint").alias("reference_count"),
        F.coalesce(F.sum("det"), F.lit(0)).cast("bigint").alias("detection_count"),
    )
    short = (F.col("reference_count") == 0) | (F.col("detection_count") == 0)
    return counts.withColumn("sufficient", ~short)


def by_feature(tagged_rows: DataFrame, features: Sequence[str] = BASE_FEATURES) -> DataFrame:
    """Long form (feature, x, ref, det) without missing values."""
    present = [f for f in features if f in tagged_rows.columns]
    wide = tagged_rows.select("ref", "det", *[num(F.col(f)).alias(f) for f in present])
    return wide.unpivot(["ref", "det"], present, "feature", "x").where(F.col("x").isNotNull())


def ks_statistic(long_rows: DataFrame) -> DataFrame:
    """Largest distance of the two empirical distribution functions, per feature."""
    sums = running_sums(long_rows, ["feature"], "x", ["ref", "det"])
    distance = F.abs(
        F.col("ref_upto") / F.col("ref_total") - F.col("det_upto") / F.col("det_total")
    )
    return sums.where((F.col("ref_total") > 0) & (F.col("det_total") > 0)).groupBy("feature").agg(
        F.max(distance).alias("ks_statistic"),
        F.max("ref_total").alias("n_reference"), F.max("det_total").alias("n_detection"),
    )


def ks_pvalue(statistic: Column, n_reference: Column, n_detection: Column) -> Column:
    """Asymptotic two-sided p-value, the Kolmogorov series.

    Below 0.2 the series converges slowly while the value is 1 to twelve digits.
    """
    n = n_reference.cast("double") * n_detection / (n_reference + n_detection)
    x = F.sqrt(n) * statistic

    def term(total: Column, k: Column) -> Column:
        size = F.exp(F.lit(-2.0) * k * k * x * x)
        return total + F.when(k % 2 == 1, size).otherwise(-size)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    p = F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(p)


#: Rows a side up to which the exact law is counted.
EXACT_ROWS = 10_000


def outside_probability(m: int, n: int, distance: int) -> float:
    """Share of the orders of m and n values in which i n - j m reaches ``distance`` in size somewhere.

    A path over the lattice takes i of m and j of n values; coming from its end, the last step was
    one of the first kind with probability i / (i + j). So each lattice point has the chance
    that a random path to it has been outside, and that of the end is the p-value: sums of
    positive terms, exact also where it is small. One diagonal at a time.
    """
    if distance <= 0:
        return 1.0
    i = np.arange(m + 1)
    chance = np.zeros(m + 1)  # of the points (i, k - i) of diagonal k
    for k in range(1, m + n + 1):
        lo, hi = max(0, k - n), min(m, k)
        here = i[lo : hi + 1]
        left = np.zeros(len(here))
        left[here > 0] = chance[here[here > 0] - 1]
        stay = np.where(k - here > 0, chance[lo : hi + 1], 0.0)
        value = (left * here + stay * (k - here)) / k
        value[np.abs(here * n - (k - here) * m) >= distance] = 1.0
        chance[lo : hi + 1] = value
    return float(chance[m])


def ks_pvalue_exact(ks: DataFrame, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Add ``ks_pvalue`` to statistics: the exact two-sample law where neither side has more than
    ``exact_rows`` rows, else the asymptotic series.

    The exact law holds without ties between the samples; with ties it is an upper bound, as the
    asymptotic one is. A row of statistics is worked on by itself, at m times n additions.
    """
    small = (F.col("n_reference") <= exact_rows) & (F.col("n_detection") <= exact_rows)

    @F.pandas_udf("double")
    def law(statistic: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([
            outside_probability(int(a), int(b), round(d * a * b)) if a <= exact_rows and b <= exact_rows else None
            for d, a, b in zip(statistic, m, n)], dtype="float64")

    series = ks_pvalue(F.col("ks_statistic"), F.col("n_reference"), F.col("n_detection"))
    exact = law(F.col("ks_statistic"), F.col("n_reference").cast("long"), F.col("n_detection").cast("long"))
    return ks.withColumn("_exact", exact).withColumn("ks_pvalue", F.when(small, F.col("_exact")).otherwise(series)).drop("_exact")


def psi(long_rows: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per feature over equal-width bins of the reference.

    Detection values outside the reference range are in no bin but stay in the divisor. A
    constant reference gets bins half a unit to each side.
    """
    in_ref = F.when(F.col("ref") > 0, F.col("x"))
    bounds = long_rows.groupBy("feature").agg(
        F.min(in_ref).alias("lo"), F.max(in_ref).alias("hi"),
        F.sum("ref").alias("ref_total"), F.sum("det").alias("det_total"),
    ).where("ref_total > 0 and det_total > 0")
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.select(
        "feature", "ref_total", "det_total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    # The bounds are one row per feature, and features are a list in the code.
    placed = long_rows.join(F.broadcast(bounds), "feature").where("x between lo and hi")
    counts = placed.groupBy(
        "feature", bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")
    ).agg(F.sum("ref").alias("ref"), F.sum("det").alias("det"))
    spine = bounds.select(
        "feature", "ref_total", "det_total",
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    ref_share = F.coalesce("ref", F.lit(0)) / F.col("ref_total") + _SMALL
    det_share = F.coalesce("det", F.lit(0)) / F.col("det_total") + _SMALL
    return spine.join(counts, ["feature", "bin"], "left").groupBy("feature").agg(
        F.abs(F.sum((det_share - ref_share) * F.ln(det_share / ref_share))).alias("psi")
    )


def feature_means(long_rows: DataFrame) -> DataFrame:
    def mean(weight: str) -> Column:
        return F.try_divide(F.sum(F.col("x") * F.col(weight)), F.sum(weight))

    return long_rows.groupBy("feature").agg(
        mean("ref").alias("reference_mean"), mean("det").alias("detection_mean"),
    )


def feature_drift(
    tagged_rows: DataFrame, threshold: float = 0.1, features: Sequence[str] = BASE_FEATURES,
) -> DataFrame:
    """One row per feature that has values in both windows.

    Statistic, index and means all read one stored table of distinct values with their
    counts, so the windows are scanned and shuffled once.
    """
    counted = value_counts(by_feature(tagged_rows, features), ["feature", "x"], ["ref", "det"])
    rows = materialise(counted, "drift-values")
    joined = (
        ks_statistic(rows).join(psi(rows), "feature")
        .join(feature_means(rows), "feature")
        .withColumn("_p", ks_pvalue(F.col("ks_statistic"), F.col("n_reference"), F.col("n_detection")))
        .withColumn("_change", F.abs(F.col("detection_mean") - F.col("reference_mean")) / (
            F.col("reference_mean") + _SMALL
        ))
        .withColumn("drift_detected", (F.col("_p") < KS_LEVEL) | (F.col("psi") > PSI_LIMIT)
                    | (F.col("_change") > threshold))
    )
    return joined.select(
        "feature",
        rounded(F.col("ks_statistic"), 4).alias("ks_statistic"),
        rounded(F.col("_p"), 4).alias("ks_pvalue"),
        rounded(F.col("psi"), 4).alias("psi"),
        rounded(F.col("reference_mean"), 4).alias("reference_mean"),
        rounded(F.col("detection_mean"), 4).alias("detection_mean"),
        rounded(F.col("_change") * 100, 2).alias("mean_change_pct"),
        "drift_detected",
    )


def drift_severity(per_feature: DataFrame) -> DataFrame:
    """One row: how many features drifted and how bad that is."""
    drifted = F.count_if("drift_detected")
    share = safe_divide(drifted, F.count(F.lit(1)))
    worst = F.coalesce(F.max("psi"), F.lit(0.0))
    severity = (
        F.when(F.coalesce(drifted, F.lit(0)) == 0, "none")
        .when((share >= 0.75) | (worst > 0.5), "critical")
        .when((share >= 0.5) | (worst > 0.3), "high")
        .when((share >= 0.25) | (worst > 0.2), "moderate")
        .otherwise("low")
    )
    return per_feature.agg(
        F.count(F.lit(1)).alias("features"), drifted.cast("bigint").alias("drifted_features"),
        rounded(worst, 4).alias("max_psi"), severity.alias("drift_severity"),
    )


def concept_drift(
    anomalies: DataFrame, periods: Periods, threshold: float = 0.1, ts: str = "detected_at",
) -> DataFrame:
    """Change of the daily anomaly rate and of the confidence, all versions in one pass."""
    rows = anomalies.where(periods.within(F.col(ts))).withColumns({
        "ref": periods.in_reference(F.col(ts)), "det": periods.in_detection(F.col(ts)),
    })

    def per_window(name: str) -> list[Column]:
        return [
            F.count_if(F.col(name)).alias(f"{name}_n"),
            F.coalesce(F.avg(F.when(F.col(name), F.col("confidence"))), F.lit(0.0)).alias(f"{name}_conf"),
            *[
                F.count_if(F.col(name) & (F.col("severity") == s)).alias(f"{name}_{s}")
                for s in SEVERITIES
            ],
        ]

    wide = rows.groupBy("model_version_id").agg(*per_window("ref"), *per_window("det"))
    ref_rate = F.col("ref_n") / F.lit(float(max(periods.reference_days, 1)))
    det_rate = F.col("det_n") / F.lit(float(max(periods.detection_days, 1)))
    rate_change = F.abs(det_rate - ref_rate) / (ref_rate + _SMALL)
    conf_change = F.abs(F.col("det_conf") - F.col("ref_conf"))
    known = F.col("ref_n") > 0

    def if_known(col: Column) -> Column:
        return F.when(known, col)

    return wide.select(
        "model_version_id",
        (known & ((rate_change > threshold) | (conf_change > threshold))).alias("drift_detected"),
        if_known(rounded(rate_change * 100, 2)).alias("anomaly_rate_change_pct"),
        if_known(rounded(ref_rate, 4)).alias("reference_anomaly_rate"),
        if_known(rounded(det_rate, 4)).alias("detection_anomaly_rate"),
        if_known(rounded(conf_change, 4)).alias("confidence_change"),
        if_known(rounded(F.col("ref_conf"), 4)).alias("reference_confidence"),
        if_known(rounded(F.col("det_conf"), 4)).alias("detection_confidence"),
        *[F.col(f"ref_{s}").cast("bigint").alias(f"reference_{s}") for s in SEVERITIES],
        *[F.col(f"det_{s}").cast("bigint").alias(f"detection_{s}") for s in SEVERITIES],
    )


def performance_drift(
    anomalies: DataFrame, periods: Periods, threshold: float = 0.1, ts: str = "detected_at",
) -> DataFrame:
    """Change of the precision on reviewed anomalies, all versions in one pass."""
    rows = anomalies.where(periods.within(F.col(ts)) & F.col("reviewed")).withColumns({
        "ref": periods.in_reference(F.col(ts)), "det": periods.in_detection(F.col(ts)),
        "good": ~F.coalesce(F.col("false_positive"), F.lit(False)),
    })
    wide = rows.groupBy("model_version_id").agg(
        F.count_if("ref").alias("ref_n"), F.count_if("det").alias("det_n"),
        safe_divide(F.count_if(F.col("ref") & F.col("good")), F.count_if("ref")).alias("ref_p"),
        safe_divide(F.count_if(F.col("det") & F.col("good")), F.count_if("det")).alias("det_p"),
    )
    known = F.col("ref_n") > 0
    change = F.abs(F.col("det_p") - F.col("ref_p"))
    return wide.select(
        "model_version_id",
        (known & (change > threshold)).alias("drift_detected"),
        F.when(known, rounded(F.col("ref_p"), 4)).alias("reference_precision"),
        F.when(known, rounded(F.col("det_p"), 4)).alias("detection_precision"),
        F.when(known, rounded(change, 4)).alias("precision_change"),
        F.col("ref_n").cast("bigint").alias("reference_reviewed_count"),
        F.col("det_n").cast("bigint").alias("detection_reviewed_count"),
    )


# Outcomes in the order in which they are tried: code, level, advice.
RECOMMENDATIONS = (
    ("performance", "critical", "Precision fell: retrain now on recent rows."),
    ("feature_critical", "critical", "Inputs changed strongly: retrain on recent rows."),
    ("feature_and_concept", "high", "Inputs and outcomes changed: plan a retraining."),
    ("feature_high", "high", "Inputs changed clearly: watch closely and schedule a retraining."),
    ("concept", "moderate", "Outcomes changed: check what the model flags."),
    ("feature_moderate", "moderate", "Inputs changed somewhat: keep watching."),
    ("feature_low", "low", "Inputs changed slightly: nothing to do."),
    ("none", "none", "No drift found."),
)


def recommendation(
    feature: Column, concept: Column, performance: Column, severity: Column,
) -> Column:
    """Code of the first outcome whose condition holds."""
    return (
        F.when(performance, "performance")
        .when(severity == "critical", "feature_critical")
        .when(feature & concept, "feature_and_concept")
        .when(severity == "high", "feature_high")
        .when(concept, "concept")
        .when(severity == "moderate", "feature_moderate")
        .when(feature, "feature_low")
        .otherwise("none")
    )


def advice(code: Column) -> Column:
    """The outcome's level and advice; too few rows for a verdict say so."""
    text = F.when(code == "insufficient_data", "NONE: Too few rows in a window to judge.")
    for name, level, words in RECOMMENDATIONS:
        text = F.when(code == name, F.lit(f"{level.upper()}: {words}")).otherwise(text)
    return text


def drift_report(
    tx: DataFrame, anomalies: DataFrame, periods: Periods, threshold: float = 0.1,
    versions: DataFrame | None = None,
) -> DataFrame:
    """One row per model version with all three kinds of drift and the advice.

    Feature drift does not depend on the version; it enters as one constant struct. The rows of
    the two windows are stored once, with the features' columns only.
    """
    rows = tagged(tx, periods)
    present = [c for c in BASE_FEATURES if c in rows.columns]
    rows = materialise(rows.select("ref", "det", *present), "drift-rows")
    counts = window_counts(rows).select(F.struct("*").alias("c")).scalar()
    feature = drift_severity(feature_drift(rows, threshold)).select(F.struct("*").alias("f")).scalar()
    ids = (anomalies if versions is None else versions).select("model_version_id").distinct()
    concept = concept_drift(anomalies, periods, threshold).select(
        "model_version_id", F.col("drift_detected").alias("concept"),
        "anomaly_rate_change_pct", "confidence_change",
    )
    performance = performance_drift(anomalies, periods, threshold).select(
        "model_version_id", F.col("drift_detected").alias("performance"), "precision_change",
    )
    joined = (
        ids.join(concept, "model_version_id", "left")
        .join(performance, "model_version_id", "left")
        .withColumn("_c", counts).withColumn("_f", feature)
    )
    enough = F.col("_c.sufficient")

    def flag(col: Column) -> Column:
        return enough & F.coalesce(col, F.lit(False))

    feature_flag = flag(F.col("_f.drifted_features") > 0)
    concept_flag, performance_flag = flag(F.col("concept")), flag(F.col("performance"))
    severity = F.when(enough, F.col("_f.drift_severity")).otherwise("none")
    flagged = joined.select(
        "model_version_id", F.col("_c.reference_count").alias("reference_count"),
        F.col("_c.detection_count").alias("detection_count"),
        (~enough).alias("insufficient_data"),
        feature_flag.alias("feature_drift"), concept_flag.alias("concept_drift"),
        performance_flag.alias("performance_drift"), severity.alias("drift_severity"),
        F.when(enough, F.col("anomaly_rate_change_pct")).alias("anomaly_rate_change_pct"),
        F.when(enough, F.col("confidence_change")).alias("confidence_change"),
        F.when(enough, F.col("precision_change")).alias("precision_change"),
    )
    code = F.when(F.col("insufficient_data"), "insufficient_data").otherwise(recommendation(
        F.col("feature_drift"), F.col("concept_drift"), F.col("performance_drift"),
        F.col("drift_severity"),
    ))
    return flagged.withColumn(
        "drift_detected",
        F.col("feature_drift") | F.col("concept_drift") | F.col("performance_drift"),
    ).withColumn("recommendation", code).withColumn("advice", advice(F.col("recommendation")))
