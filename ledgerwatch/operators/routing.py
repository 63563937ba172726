"""Routing of requests to model versions, comparison of versions, deployment history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.hashing import unit_hash, user_bucket
from ledgerwatch.operators.ordered import row_numbers, running_total
from ledgerwatch.operators.stats import model_metrics
from ledgerwatch.session import require_columns

BUCKETS = 100
# Fixed value: a smaller difference of confidence decides nothing.
CONFIDENCE_GAP = 0.05

# Deployment strategy and its initial traffic in percent.
STRATEGY_TRAFFIC = {"shadow": 0.0, "canary": 10.0, "blue_green": 0.0, "full": 100.0}


def request_bucket(user_id: Column, request_key: Column, seed: int = 0) -> Column:
    """Bucket 0 to 99: stable per user, or from the request itself where there is none."""
    drawn = F.floor(unit_hash(request_key, F.lit(seed)) * BUCKETS).cast("int")
    return F.when(F.coalesce(user_id, F.lit("")) != "", user_bucket(user_id)).otherwise(drawn)


def uses_version(bucket: Column, deployed: Column, traffic: Column) -> Column:
    """Does a request of this bucket use a version with this traffic?"""
    return deployed & (traffic > 0) & ((traffic >= 100) | (bucket < traffic))


def with_version_decision(
    requests: DataFrame, versions: DataFrame, version_id: int, user: str = "user_id", key: str = "id",
) -> DataFrame:
    """Every request with the decision for one version; that version is one constant row."""
    wanted = versions.where(F.col("id") == version_id).agg(F.struct(
        F.max("is_deployed").alias("deployed"), F.max("traffic_percentage").alias("traffic"),
    ).alias("v")).scalar()
    rows = requests.withColumns({"bucket": request_bucket(F.col(user), F.col(key)), "_v": wanted})
    use = uses_version(F.col("bucket"), F.col("_v.deployed"), F.col("_v.traffic"))
    return rows.withColumn("use_version", F.coalesce(use, F.lit(False))).drop("_v")


def traffic_ranges(versions: DataFrame) -> DataFrame:
    """Deployed versions by falling traffic with their cumulative range of buckets.

    A model with very many versions is cut into slices, not put into one task.
    """
    deployed = versions.where("is_deployed").select(
        "model_id", F.col("id").alias("version_id"),
        F.col("traffic_percentage").cast("double").alias("traffic"),
        (-F.col("traffic_percentage")).alias("_down"),
    )
    summed = running_total(deployed, ["model_id"], ["_down", "version_id"], F.col("traffic"), "until")
    return summed.select(
        "model_id", "version_id", "traffic", (F.col("until") - F.col("traffic")).alias("from"), "until"
    )


def routing_table(versions: DataFrame, mode: str = "split") -> DataFrame:
    """(model_id, bucket, version_id): at most 100 rows per model, however many versions.

    ``split``: cumulative ranges over the buckets, largest traffic first; buckets beyond the
    allocated traffic have no version. ``reference``: every version tests the same bucket,
    largest first, and the largest is the fallback, so it always wins; a single version
    below 100 percent leaves the other buckets without one.
    """
    if mode == "split":
        ranges = traffic_ranges(versions).where(F.col("from") < BUCKETS)
        first = F.ceil("from").cast("int")
        last = (F.ceil(F.least(F.col("until"), F.lit(float(BUCKETS)))) - 1).cast("int")
        covered = ranges.where(first <= last)
        return covered.select("model_id", F.explode(F.sequence(first, last)).alias("bucket"), "version_id")
    if mode != "reference":
        raise ValueError("mode must be split or reference")
    top = versions.where("is_deployed").groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(
            F.col("traffic_percentage").cast("double").alias("traffic"), (-F.col("id")).alias("minus_id"),
        )).alias("top"),
    )
    buckets = top.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    chosen = (F.col("n") > 1) | uses_version(F.col("bucket"), F.lit(True), F.col("top.traffic"))
    return buckets.where(chosen).select(
        "model_id", "bucket", (-F.col("top.minus_id")).cast("int").alias("version_id")
    )


def route(
    requests: DataFrame, versions: DataFrame, mode: str = "split", model: str = "model_id",
    user: str = "user_id", key: str = "id",
) -> DataFrame:
    """Every request with its bucket and version (null where none applies)."""
    require_columns(requests, model, user, key)
    table = routing_table(versions, mode)
    if model != "model_id":
        table = table.withColumnRenamed("model_id", model)
    rows = requests.withColumn("bucket", request_bucket(F.col(user), F.col(key)))
    return rows.join(table, [model, "bucket"], "left")


def ranked_versions(versions: DataFrame) -> DataFrame:
    """Position and cumulative traffic of each deployed version within its model."""
    ranges = traffic_ranges(versions)
    placed = row_numbers(
        ranges.withColumn("_down", -F.col("traffic")), ["model_id"], ["_down", "version_id"], "rank")
    return placed.select("model_id", "version_id", "traffic", "rank", "until")


# -- comparison --------------------------------------------------------------------------


def winner(a: str, b: str) -> Column:
    """Which of two metric structs wins: confidence, then severe findings, then findings."""

    def of(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(0))

    def severe(side: str) -> Column:
        return of(side, "n_critical") + of(side, "n_high")

    def larger(left: Column, right: Column) -> Column:
        return F.when(left > right, "model_a").otherwise("model_b")

    conf_a, conf_b = of(a, "avg_confidence"), of(b, "avg_confidence")
    total_a, total_b = of(a, "total_anomalies"), of(b, "total_anomalies")
    return (
        F.when(F.abs(conf_a - conf_b) > CONFIDENCE_GAP, larger(conf_a, conf_b))
        .when(severe(a) != severe(b), larger(severe(a), severe(b)))
        .when(total_a == total_b, "tie")
        .otherwise(larger(total_a, total_b))
    )


def _recent(anomalies: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    since = as_of - timedelta(hours=hours)
    return anomalies.where(F.col("detected_at").between(F.lit(since), F.lit(as_of)))


def compare_versions(
    anomalies: DataFrame, version_a: int, version_b: int, as_of: datetime, hours: int = 24,
) -> DataFrame:
    """One row: the metrics of two versions over the last hours and the winner."""
    both = _recent(anomalies, as_of, hours).where(F.col("model_version_id").isin(version_a, version_b))
    rows = model_metrics(both).withColumn("m", F.struct("*"))

    def side(version: int) -> Column:
        return F.max(F.when(F.col("model_version_id") == version, F.col("m")))

    pair = rows.agg(side(version_a).alias("a"), side(version_b).alias("b"))
    return _shown(pair.withColumns({
        "version_a": F.lit(version_a), "version_b": F.lit(version_b), "winner": winner("a", "b"),
    }))


def compare_with_champion(
    anomalies: DataFrame, champions: DataFrame, as_of: datetime, hours: int = 24,
) -> DataFrame:
    """Every version against the champion of its model (``champions``: model_version_id,
    champion_id). One row per version; no pairs beyond these are formed."""
    metrics = model_metrics(_recent(anomalies, as_of, hours))
    wide = metrics.select("model_version_id", F.struct("*").alias("m"))
    a = wide.select(F.col("model_version_id").alias("champion_id"), F.col("m").alias("a"))
    b = wide.withColumnRenamed("m", "b")
    joined = champions.join(a, "champion_id", "left").join(b, "model_version_id", "left")
    return _shown(joined.select(
        F.col("champion_id").alias("version_a"), F.col("model_version_id").alias("version_b"),
        "a", "b", winner("a", "b").alias("winner"),
    ))


def _shown(pair: DataFrame) -> DataFrame:
    names = ("total_anomalies", "avg_confidence", "avg_anomaly_score")
    shown = [
        F.coalesce(F.col(f"{s}.{n}"), F.lit(0)).alias(f"{n}_{s}") for s in ("a", "b") for n in names
    ]
    return pair.select("version_a", "version_b", *shown, "winner")
