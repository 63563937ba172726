"""Aggregates over transactions, anomalies, audit rows, predictions and plots.

All are partial/final hash aggregates: a group of any size shrinks to one row per task
before the shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.classify import SEVERITIES
from ledgerwatch.functions.numeric import rounded, safe_divide

BUFFER_SIZE = 10_000
BUFFER_TTL_SECONDS = 3600
BYTES_PER_ENTRY = 1024


def _count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def transaction_statistics(tx: DataFrame, start: datetime | None = None) -> DataFrame:
    if start is not None:
        tx = tx.where(F.col("timestamp") >= F.lit(start))

    def zero(col: Column) -> Column:
        return F.coalesce(col.cast("double"), F.lit(0.0))

    return tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        zero(F.sum("value")).alias("total_value"),
        zero(F.avg("value")).alias("avg_value"),
        zero(F.max("value")).alias("max_value"),
        zero(F.min("value")).alias("min_value"),
        zero(F.avg("gas_price")).alias("avg_gas_price"),
    )


def false_positive_rate(anomalies: DataFrame, start: datetime | None = None) -> DataFrame:
    """Share of reviewed anomalies marked false; an unmarked one counts as not false."""
    if start is not None:
        anomalies = anomalies.where(F.col("detected_at") >= F.lit(start))
    reviewed = _count_if(F.col("reviewed"))
    false_ones = _count_if(F.col("reviewed") & F.col("false_positive"))
    return anomalies.agg(
        reviewed.alias("reviewed"), false_ones.alias("false_positives"),
        safe_divide(false_ones, reviewed).alias("false_positive_rate"),
    )


def precision_of(reviewed: Column, false_positive: Column) -> Column:
    """Aggregate: reviewed rows not marked false, over reviewed rows; 0 without any."""
    good = F.count_if(reviewed & ~F.coalesce(false_positive, F.lit(False)))
    return safe_divide(good, F.count_if(reviewed))


def review_precision(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("model_version_id").agg(
        _count_if(F.col("reviewed")).alias("reviewed"),
        precision_of(F.col("reviewed"), F.col("false_positive")).alias("precision"),
    )


def severity_distribution(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def severity_counts(condition: Column | None = None) -> list[Column]:
    """One count per severity, in one pass; the wide form of the distribution."""
    extra = F.lit(True) if condition is None else condition
    return [
        _count_if(extra & (F.col("severity") == name)).alias(f"n_{name}") for name in SEVERITIES
    ]


def model_metrics(anomalies: DataFrame) -> DataFrame:
    """Counts, averages (3 digits) and severities of every model version at once."""
    return anomalies.groupBy("model_version_id").agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        rounded(F.avg("confidence"), 3).alias("avg_confidence"),
        rounded(F.avg("anomaly_score"), 3).alias("avg_anomaly_score"),
        *severity_counts(),
    )


def audit_statistics(logs: DataFrame) -> DataFrame:
    """Totals, counts by type and counts by severity in one scan."""
    kind = (
        F.when(F.grouping("event_type") == 0, "event_type")
        .when(F.grouping("severity") == 0, "severity")
        .otherwise("total")
    )
    name = (
        F.when(F.grouping("event_type") == 0, F.col("event_type"))
        .when(F.grouping("severity") == 0, F.col("severity"))
        .otherwise("all")
    )
    grouped = logs.groupingSets(
        [[], [F.col("event_type")], [F.col("severity")]], F.col("event_type"), F.col("severity"),
    )
    return grouped.agg(
        kind.alias("kind"), name.alias("name"),
        F.count(F.lit(1)).alias("n"),
        _count_if(F.col("status") == "failure").alias("failures"),
        F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"),
    ).drop("event_type", "severity")


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals of a prediction batch (columns ``is_anomaly`` and ``from_cache``)."""
    return results.agg(
        F.count(F.lit(1)).alias("total_processed"),
        _count_if(F.col("is_anomaly")).alias("total_anomalies"),
        _count_if(F.col("from_cache")).alias("from_cache"),
        _count_if(~F.col("from_cache")).alias("computed"),
    )


def hit_rates(access: DataFrame, kind: str, hit: Column) -> DataFrame:
    """Percent of hits per kind of access, two digits."""
    hits, misses = _count_if(hit), _count_if(~hit)
    return access.groupBy(F.col(kind).alias("kind")).agg(
        hits.alias("hits"), misses.alias("misses"),
        rounded(safe_divide(hits * 100, hits + misses), 2).alias("hit_rate"),
    )


def buffer_statistics(
    anomalies: DataFrame, as_of: datetime, max_size: int = BUFFER_SIZE,
    ttl_seconds: int = BUFFER_TTL_SECONDS, inserted_at: str = "detected_at",
) -> DataFrame:
    """State of the newest-N-with-TTL view at a moment.

    An entry exactly as old as the TTL is still alive. What the size bound evicts are the
    oldest live entries, so the newest N bound the reported ages.
    """
    ts = F.col(inserted_at)
    now = F.lit(as_of).cast("timestamp")
    live = ts >= now - F.expr(f"interval {int(ttl_seconds)} seconds")
    newest = (
        anomalies.where((ts <= now) & live).select(ts.alias("t")).orderBy(F.desc("t")).limit(max_size)
    )
    kept = newest.agg(
        F.count(F.lit(1)).alias("current_size"), F.min("t").alias("oldest"), F.max("t").alias("newest"),
    )
    inserted = anomalies.where(ts <= now).agg(F.count(F.lit(1))).scalar()

    def age(col: Column) -> Column:
        micros = F.unix_micros(now) - F.unix_micros(col.cast("timestamp"))
        return F.coalesce(micros / F.lit(1e6), F.lit(0.0))

    size = F.col("current_size")
    return kept.select(
        size, F.lit(max_size).cast("bigint").alias("max_size"),
        F.lit(ttl_seconds).cast("bigint").alias("ttl_seconds"),
        inserted.alias("total_inserted"),
        (inserted - size).alias("total_evicted"),
        (size / F.lit(float(max_size))).alias("utilization"),
        age(F.col("oldest")).alias("oldest_age_seconds"),
        age(F.col("newest")).alias("newest_age_seconds"),
        (size * BYTES_PER_ENTRY).alias("current_bytes"),
        rounded(size * BYTES_PER_ENTRY / F.lit(1048576.0), 2).alias("current_mb"),
        F.lit(max_size * BYTES_PER_ENTRY).cast("bigint").alias("max_bytes"),
        F.lit(round(max_size * BYTES_PER_ENTRY / 1048576.0, 2)).alias("max_mb"),
    )


def traffic_allocation(versions: DataFrame) -> DataFrame:
    """Deployed versions with the totals of their model, one row per version.

    The list per model is a join with per-model totals, not a collected array.
    """
    deployed = versions.where("is_deployed")
    totals = deployed.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_versions"),
        F.sum("traffic_percentage").alias("traffic_allocated"),
    )
    return deployed.select(
        "model_id", F.col("id").alias("version_id"), "version", "traffic_percentage",
    ).join(totals, "model_id")


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Lag per (topic, partition) from positions and end offsets, and the topic total."""
    lag = F.greatest(F.max("end_offset") - F.max("position"), F.lit(0)).cast("bigint")
    per_partition = offsets.groupBy("topic", "partition").agg(lag.alias("lag"))
    per_topic = per_partition.groupBy("topic").agg(F.sum("lag").alias("lag"))
    return per_partition.unionByName(
        per_topic.withColumn("partition", F.lit(-1)), allowMissingColumns=True
    ).select("topic", F.col("partition").cast("int").alias("partition"), "lag")


# -- data behind plots -------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, empty bins included."""
    if not column or column not in df.columns:
        raise ValueError(f"column not found: {column!r}")
    if bins < 1:
        raise ValueError("bins must be positive")
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    bounds = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("b")).scalar()
    low, high = bounds.getField("lo"), bounds.getField("hi")
    counts = values.select(bin_index(F.col("x"), low, high, bins).alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return spine.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a value inside [low, high] against the edges ``low + i * step``.

    The quotient can miss an edge by one bin through rounding, so it is checked against the
    edges themselves. The last bin is closed.
    """
    step = (high - low) / bins
    guess = F.least(F.floor((x - low) / step), F.lit(bins - 1)).cast("int")
    below = x < low + guess * step
    above = (x >= low + (guess + 1) * step) & (guess < bins - 1)
    exact = F.when(below, guess - 1).when(above, guess + 1).otherwise(guess)
    return F.when(high == low, F.lit(0)).otherwise(exact)


def plot_series(
    tx: DataFrame, bucket: str = "day", ts: str = "timestamp", value: str = "value",
) -> DataFrame:
    """A line plot's data: min, mean and max per time bucket."""
    return tx.groupBy(F.date_trunc(bucket, F.col(ts)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"),
        F.avg(value).alias("mean"), F.max(value).alias("high"),
    )


def plot_labelled_series(
    labelled: DataFrame, label: str = "anomaly", bucket: str = "day", ts: str = "timestamp",
    value: str = "value",
) -> DataFrame:
    """The same per label: the normal line and the marked points."""
    return labelled.groupBy(F.date_trunc(bucket, F.col(ts)).alias("bucket"), label).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"),
        F.avg(value).alias("mean"), F.max(value).alias("high"),
    )
