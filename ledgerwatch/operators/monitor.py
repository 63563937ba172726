"""Rules over metric, request and audit tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.classify import REQUEST_CLASSES, endpoint, request_class
from ledgerwatch.functions.numeric import rounded, safe_divide
from ledgerwatch.operators.ordered import (
    HOT_ROWS, count_within, islands, previous_values, row_numbers,
)
from ledgerwatch.operators.prefix import exact_quantiles

# Limit name, requests per window, window in seconds.
LIMITS = {
    "global": (10_000, 60),
    "per_ip": (100, 60),
    "per_user": (200, 60),
    "predict": (500, 60),
    "batch_predict": (50, 60),
    "train": (5, 3600),
    "auth": (10, 300),
}

# Metric, unhealthy above, degraded above, degraded below.
HEALTH_RULES = (
    ("cpu_percent", 90.0, 75.0, None),
    ("memory_percent", 90.0, 75.0, None),
    ("disk_percent", 90.0, 80.0, None),
    ("hit_rate", None, None, 20.0),
    ("buffer_utilization", None, 0.9, None),
)
HEALTH_ORDER = ("healthy", "degraded", "unhealthy")
SLOW_SECONDS = 1.0


def _window_start(ts: str, length: str) -> Column:
    return F.window(F.col(ts), length).getField("start").alias("window_start")


def counter_rate(
    samples: DataFrame, keys: Sequence[str], ts: str, value: str, length: str, seconds: float,
    tie: Sequence[str] = (), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per-second increase of a counter per series and window.

    A fall of the counter means a restart; the new value is then the increase.
    """
    lagged = previous_values(samples, keys, [ts, *tie], [value], hot_rows)
    before, now = F.col(f"prev_{value}"), F.col(value)
    increase = F.when(before.isNull(), 0.0).when(now < before, now).otherwise(now - before)
    return lagged.groupBy(*keys, _window_start(ts, length)).agg(
        F.sum(increase).alias("increase"), (F.sum(increase) / F.lit(float(seconds))).alias("rate")
    )


def ratio_alerts(
    events: DataFrame, part: Column, whole: Column, threshold: float, length: str, ts: str = "ts",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Share of matching events per window and whether it exceeds the threshold."""
    share = safe_divide(F.count_if(part), F.count_if(whole))
    return events.groupBy(*keys, _window_start(ts, length)).agg(
        F.count_if(part).cast("bigint").alias("matching"),
        F.count_if(whole).cast("bigint").alias("total"),
        share.alias("ratio"), (share > threshold).alias("firing"),
    )


def bucket_counts(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative histogram buckets (keys, le, n) in one pass; the last bound is infinity."""
    limits = [*sorted(bounds), float("inf")]
    wide = df.groupBy(*keys).agg(*[
        F.count_if(F.col(value) <= F.lit(b)).cast("bigint").alias(f"le_{i}")
        for i, b in enumerate(limits)
    ])
    entries = F.explode(F.array(*[
        F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(limits)
    ]))
    return wide.select(*keys, entries.alias("_b")).select(*keys, "_b.le", "_b.n")


def bucket_quantile(buckets: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Quantile from cumulative buckets with linear interpolation.

    In the open last bucket the answer is the largest finite bound. Groups are the bounds of
    one series, a handful of rows.
    """
    order = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    rows = buckets.select(
        *keys, "le", "n",
        F.coalesce(F.lag("n").over(order), F.lit(0)).alias("below"),
        F.coalesce(F.lag("le").over(order), F.lit(0.0)).alias("low"),
        (F.max("n").over(whole) * F.lit(float(share))).alias("rank"),
        F.max("n").over(whole).alias("total"),
    )
    inside = F.col("low") + (F.col("le") - F.col("low")) * safe_divide(
        F.col("rank") - F.col("below"), F.col("n") - F.col("below")
    )
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    hit = rows.where((F.col("total") > 0) & (F.col("n") >= F.col("rank")))
    return hit.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def raw_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Exact quantile of raw values."""
    return exact_quantiles(df, keys, value, share)


def held_alerts(
    samples: DataFrame, keys: Sequence[str], ts: str, condition: Column, hold_seconds: float,
    tie: Sequence[str] = (), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Stretches in which a condition held for at least the given time."""
    found = islands(samples, keys, [ts, *tie], ts, condition, hot_rows)
    micros = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return found.withColumn("held_seconds", micros / F.lit(1e6)).where(
        F.col("held_seconds") >= hold_seconds
    )


def silent_periods(
    events: DataFrame, keys: Sequence[str], start: datetime, end: datetime, silent_seconds: int,
    step_seconds: int = 60, ts: str = "ts", expected: DataFrame | None = None,
) -> DataFrame:
    """Stretches of at least ``silent_seconds`` without any event of a key.

    Events shrink to the active steps (minutes, say) first; a stretch is the distance between
    two active steps, so no row per silent minute is ever made. The ends of the observed
    range count as borders. ``expected`` names keys that should send something, so that one
    without a single event is silent throughout; without keys the whole table is one series,
    silent even if empty.
    """
    keys, step = list(keys), F.lit(step_seconds)
    at = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step).cast("bigint")
    inside = events.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    active = inside.select(*keys, at.alias("step")).distinct()
    first, beyond = int(_epoch(start) // step_seconds), int(-(-_epoch(end) // step_seconds))
    if keys:
        known = active.select(*keys)
        known = (known if expected is None else known.union(expected.select(*keys))).distinct()
    else:
        known = events.sparkSession.range(1).select()
    borders = known.withColumn(
        "step", F.explode(F.array(F.lit(first - 1), F.lit(beyond)).cast("array<bigint>"))
    )
    lagged = previous_values(active.unionByName(borders), keys, ["step"], ["step"])
    silent = (F.col("step") - F.col("prev_step") - 1) * step
    return lagged.where(silent >= silent_seconds).select(
        *keys, F.timestamp_seconds((F.col("prev_step") + 1) * step).alias("silent_from"),
        F.timestamp_seconds(F.col("step") * step).alias("silent_until"),
        silent.cast("bigint").alias("silent_seconds"),
    )


def _epoch(moment: datetime) -> float:
    from datetime import timezone

    return (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp()


# -- health ------------------------------------------------------------------------------


def health_status(metric: Column, value: Column) -> Column:
    """Status of one value by the fixed rules; an unknown metric is healthy."""
    status = F.lit("healthy")
    for name, unhealthy, above, below in HEALTH_RULES:
        here = F.lit("healthy")
        if below is not None:
            here = F.when(value < below, "degraded").otherwise(here)
        if above is not None:
            here = F.when(value > above, "degraded").otherwise(here)
        if unhealthy is not None:
            here = F.when(value > unhealthy, "unhealthy").otherwise(here)
        status = F.when(metric == name, here).otherwise(status)
    return status


def health_report(metrics: DataFrame, keys: Sequence[str], metric: str, value: str) -> DataFrame:
    """Per key the number of values by status, and the worst status."""
    status = health_status(F.col(metric), F.col(value))
    rank = F.lit(0)
    for i, name in enumerate(HEALTH_ORDER):
        rank = F.when(status == name, F.lit(i)).otherwise(rank)
    worst = F.max(rank)
    overall = F.lit(HEALTH_ORDER[0])
    for i, name in enumerate(HEALTH_ORDER):
        overall = F.when(worst == i, name).otherwise(overall)
    return metrics.groupBy(*keys).agg(
        *[F.count_if(status == name).cast("bigint").alias(f"n_{name}") for name in HEALTH_ORDER],
        overall.alias("status"),
    )


# -- requests ----------------------------------------------------------------------------


def request_metrics(
    requests: DataFrame, method: str = "method", path: str = "path", status: str = "status_code",
    duration: str = "duration_s", sizes: Sequence[str] = (),
) -> DataFrame:
    """Counts, errors, slow requests, latency and sizes per method, endpoint and status."""
    seconds = F.col(duration)
    extra = [F.sum(s).alias(f"total_{s}") for s in sizes]
    return requests.groupBy(
        method, endpoint(F.col(path)).alias("endpoint"), status
    ).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col(status) >= 400).cast("bigint").alias("errors"),
        F.count_if(seconds > SLOW_SECONDS).cast("bigint").alias("slow"),
        F.avg(seconds).alias("avg_seconds"), F.max(seconds).alias("max_seconds"), *extra,
    )


def fixed_window_audit(
    requests: DataFrame, keys: Sequence[str], limit: int, window_seconds: int, ts: str = "ts",
    tie: str = "id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Which requests exceed ``limit`` per fixed window of their key.

    The position inside a window with a flood of requests is counted over time slices of it.
    """
    if limit < 1 or window_seconds < 1:
        raise ValueError("limit and window must be positive")
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    windowed = requests.withColumn("window", F.floor(second / window_seconds).cast("bigint"))
    ranked = row_numbers(windowed, [*keys, "window"], [ts, tie], "position", hot_rows)
    allowed = F.col("position") <= limit
    reset = (F.col("window") + 1) * window_seconds
    return ranked.withColumns({
        "allowed": allowed,
        "remaining": F.greatest(F.lit(limit) - F.col("position"), F.lit(0)).cast("bigint"),
        "reset": reset.cast("bigint"),
        "retry_after": F.when(allowed, 0).otherwise(
            reset - F.unix_seconds(F.col(ts).cast("timestamp"))
        ).cast("bigint"),
    })


def named_limits_audit(
    requests: DataFrame, ip: str = "ip", user: str = "user_id", path: str = "path", ts: str = "ts",
    tie: str = "id", limits: dict[str, tuple[int, int]] = LIMITS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every request against each named limit that applies to it, in one pass.

    All requests share the global limit, each address and each known user has its own, and
    the classes of paths count per user, or per address where there is none. A row per
    request and limit: ``limit_type, key`` and what ``fixed_window_audit`` says; refused
    requests count as well.
    """
    who = F.when(F.coalesce(F.col(user), F.lit("")) != "", F.col(user))
    kind = request_class(F.col(path))
    subjects = [("global", F.lit("global")), ("per_ip", F.col(ip)), ("per_user", who)]
    entries = [
        F.when(F.lit(True), F.struct(
            F.lit(name).alias("limit_type"), key.cast("string").alias("key"), F.lit(limits[name][0]).alias("max_requests"),
            F.lit(limits[name][1]).alias("window_seconds")))
        for name, key in subjects
    ] + [
        F.when(kind == name, F.struct(
            F.lit(name).alias("limit_type"), F.coalesce(who, F.col(ip)).cast("string").alias("key"),
            F.lit(limits[name][0]).alias("max_requests"), F.lit(limits[name][1]).alias("window_seconds")))
        for _text, name in REQUEST_CLASSES
    ]
    applied = F.filter(F.array(*entries), lambda e: e.isNotNull() & e["key"].isNotNull())
    rows = requests.select("*", F.inline(applied))
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    windowed = rows.withColumn("window", F.floor(second / F.col("window_seconds")).cast("bigint"))
    ranked = row_numbers(windowed, ["limit_type", "key", "window"], [ts, tie], "position", hot_rows)
    allowed = F.col("position") <= F.col("max_requests")
    reset = (F.col("window") + 1) * F.col("window_seconds")
    return ranked.withColumns({
        "allowed": allowed,
        "remaining": F.greatest(F.col("max_requests") - F.col("position"), F.lit(0)).cast("bigint"),
        "reset": reset.cast("bigint"),
        "retry_after": F.when(allowed, 0).otherwise(reset - second).cast("bigint"),
    })


def rolling_request_count(
    requests: DataFrame, keys: Sequence[str], seconds: float = 60, ts: str = "ts",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Requests of the key in the last seconds, the request itself included."""
    return count_within(requests, keys, ts, seconds, "recent", None, hot_rows)


# -- keys and logins ---------------------------------------------------------------------


def key_usage(usage: DataFrame, keys: DataFrame, key: str = "key_id", ts: str = "ts") -> DataFrame:
    """Every use of a key with its verdict at that time: ok, expired, inactive or unknown."""
    known = keys.select(key, "is_active", "expires_at").withColumn("_known", F.lit(True))
    verdict = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(~F.col("is_active"), "inactive")
        .when(F.col("expires_at") < F.col(ts), "expired")
        .otherwise("ok")
    )
    return usage.join(known, key, "left").withColumn("verdict", verdict).drop(
        "_known", "is_active", "expires_at"
    )


def recent_failures(
    logs: DataFrame, user: str = "user_id", ts: str = "timestamp", seconds: float = 300,
    status: str = "status", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Failures of the same user in the seconds up to each row."""
    return count_within(
        logs, [user], ts, seconds, "recent_failures", F.col(status) == "failure", hot_rows
    )
