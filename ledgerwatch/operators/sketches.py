"""Latency percentiles from mergeable sketches.

A KLL sketch holds a sample of a few hundred values whose ranks are right within a stated
share. Sketches of windows are stored as rows and merged upward: to longer windows, to all of
an endpoint, to the whole service. Raw values are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.classify import endpoint
from ledgerwatch.functions.checks import require, require_count
from ledgerwatch.session import require_columns

#: Size of a sketch, and the error of a rank with it (a share of all values, 99 % of the time).
SIZE = 400
PERCENTILES = (0.5, 0.95, 0.99)


def rank_error(size: int = SIZE) -> float:
    """The published bound of a single quantile's rank for sketches of this size."""
    return 2.296 / size ** 0.9021


def latency_sketches(
    requests: DataFrame, length: str = "5 minutes", ts: str = "ts", path: str = "path", duration: str = "duration_s",
    method: str = "method", size: int = SIZE,
) -> DataFrame:
    """One sketch per method, endpoint and window: ``method, endpoint, window_start, sketch``.

    Sketches are built on the map side and merged, so a busy endpoint is many small sketches and
    never many rows in one place. Null and NaN durations don't count.
    """
    require_columns(requests, ts, path, duration, method)
    require_count("size", size, 8)
    seconds = F.col(duration).cast("double")
    kept = requests.where(seconds.isNotNull() & ~F.isnan(seconds))
    return kept.groupBy(
        F.col(method).alias("method"), endpoint(F.col(path)).alias("endpoint"),
        F.window(F.col(ts).cast("timestamp"), length).getField("start").alias("window_start"),
    ).agg(F.kll_sketch_agg_double(seconds, size).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], length: str | None = None, size: int = SIZE) -> DataFrame:
    """Sketches of fewer keys, or of longer windows, from stored ones."""
    if length is not None:
        longer = F.window(F.col("window_start"), length).getField("start")
        sketches, keys = sketches.withColumn("window_start", longer), [*keys, "window_start"]
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def percentiles(sketches: DataFrame, shares: Sequence[float] = PERCENTILES) -> DataFrame:
    """Replace the sketch by the number of values and a column per share: ``p50, p95, p99``."""
    for s in shares:
        require(0 <= s <= 1, ValueError, f"share: {s} is not between 0 and 1")
    found = {f"p{100 * s:g}".replace(".", "_"): F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares}
    return sketches.withColumns({"values": F.kll_sketch_get_n_double("sketch"), **found}).drop("sketch")


def share_upto(sketch: Column, value: Column) -> Column:
    """Share of the sketch's values up to and including a value, as for a limit on slow requests."""
    return F.kll_sketch_get_rank_double(sketch, value.cast("double"))
