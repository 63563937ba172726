"""Running sums in value order without sending all rows to one task.

A window without a partition column moves every row to a single task. Here equal values are
added up first, then the distinct values are cut into ranges of about equal size, the range
totals are summed (a few rows), and the sums inside each range run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at least and at most; between, as many as the session has shuffle partitions.
RANGES, MOST_RANGES = 256, 4096


def value_counts(df: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Sums of the weights per distinct key, combined on the map side first."""
    return df.groupBy(*keys).agg(*[
        F.sum(w).cast("double" if df.schema[w].dataType.typeName() == "double" else "bigint").alias(w)
        for w in weights
    ])


def _ranges(df: DataFrame, ranges: int | None) -> int:
    if ranges is None:
        ranges = min(MOST_RANGES, max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return max(2, math.isqrt(ranges))


def running_sums(
    df: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], ranges: int | None = None,
) -> DataFrame:
    """One row per (keys, value) with, for each weight ``w``, its sum ``w``, the sum up to
    and including this value ``w_upto`` and the total of the key group ``w_total``.

    A value shared by a third of all rows is one row after the first aggregate, which also
    combines on the map side. Cut points come from the distinct values, so the ranges stay
    balanced whatever the frequencies are. Their number follows the session's shuffle
    partitions. Without keys the cut points are one constant row.
    """
    keys = list(keys)
    step = _ranges(df, ranges)
    ranges = step * step
    per_value = value_counts(df, [*keys, value], weights)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cut_table = per_value.groupBy(*keys).agg(
        F.percentile_approx(value, shares, F.lit(max(ranges * 4, 2000))).alias("_cuts"),
        *[F.sum(w).alias(f"{w}_total") for w in weights],
    )

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col(value)))

    # Two short searches, first among every step-th cut, then between two of those.
    coarse = F.transform(
        F.sequence(F.lit(step), F.lit(ranges - step), F.lit(step)), lambda i: F.element_at("_cuts", i)
    )
    searchable = cut_table.withColumn("_coarse", coarse)
    if keys:
        beside = per_value.join(searchable, keys)
    else:
        names = ["_cuts", "_coarse", *[f"{w}_total" for w in weights]]
        row = searchable.select(F.struct(*names).alias("t")).scalar()
        beside = per_value.withColumn("_t", row).withColumns({n: F.col(f"_t.{n}") for n in names}).drop("_t")
    placed = (
        beside.withColumn("_at", below(F.col("_coarse")) * step)
        .withColumn("_range", F.col("_at") + below(F.slice("_cuts", F.col("_at") + 1, F.lit(step - 1))))
        .drop("_cuts", "_coarse", "_at")
    )

    # The sum before a range is the total less the sum from it on. Reading the totals here
    # too keeps this plan like the main one, so that both share one shuffle of ``per_value``.
    onward = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    per_range = placed.groupBy(*keys, "_range").agg(
        *[F.sum(w).alias(w) for w in weights],
        *[F.max(f"{w}_total").alias(f"{w}_total") for w in weights],
    )
    offsets = per_range.select(
        *keys, "_range",
        *[(F.col(f"{w}_total") - F.sum(w).over(onward)).alias(f"_{w}_before") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return placed.join(offsets, [*keys, "_range"]).select(
        *keys, value, *weights,
        *[(F.col(f"_{w}_before") + F.sum(w).over(inside)).alias(f"{w}_upto") for w in weights],
        *[f"{w}_total" for w in weights],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, share: float, ranges: int | None = None,
) -> DataFrame:
    """The quantile with linear interpolation, exact at any size.

    The built-in exact percentile keeps all values of a group in one task; this one only
    looks for the two neighbouring order statistics in the running counts.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    keys = list(keys)
    ones = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_x"), F.lit(1).cast("bigint").alias("_n")
    )
    sums = running_sums(ones, keys, "_x", ["_n"], ranges)
    place = F.lit(share) * (F.col("_n_total") - 1)

    def at(rank):
        inside = (F.col("_n_upto") - F.col("_n") <= rank) & (rank < F.col("_n_upto"))
        return F.max(F.when(inside, F.col("_x")))

    found = (sums.groupBy(*keys) if keys else sums).agg(
        at(F.floor(place)).alias("_low"), at(F.ceil(place)).alias("_high"),
        F.max(place - F.floor(place)).alias("_part"),
    )
    return found.select(
        *keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile")
    )


#: Cuts of a part in one pass, and distinct values that may come to the driver.
CUTS, FEW = 64, 100_000
#: Precision of the approximate cuts: a part between two of them holds at most 1/64 + 2/10000 of the rows.
_PRECISION = 10_000


def exact_quantile(df: DataFrame, value: str, share: float) -> float | None:
    """The quantile of a whole stored column, exact at any size, without a sort or a shuffle of rows.

    Each pass cuts the rows that may hold the wanted place at approximate quantiles, counts the
    rows at each cut and between two, and goes on between two; the last few rows come to the
    driver by distinct value. Cuts are values of the column, so neither infinities nor skew keep a
    part from shrinking: every pass leaves a sixtieth of the rows, three passes 10^5 of 2 * 10^10. Two
    scans a pass, so ``df`` should be stored. Null and NaN don't count; without values the
    answer is None. Between an infinity and another value lies that infinity, between both NaN.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must be between 0 and 1")
    rows = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = rows.count()
    if not n:
        return None
    place = share * (n - 1)
    low = _order_statistic(rows, math.floor(place), n)
    if place == math.floor(place):
        return low
    high = _order_statistic(rows, math.ceil(place), n)
    return low if low == high else low + (high - low) * (place - math.floor(place))


def _order_statistic(rows: DataFrame, rank: int, n: int) -> float:
    """The value with ``rank`` values before it, among ``n``."""
    inside = rows
    while n > FEW:
        cuts = _cuts(inside)
        listed = F.lit(cuts)
        # Even places are the gaps before each cut, odd ones the cuts themselves.
        below = F.size(F.filter(listed, lambda c: c < F.col("x")))
        place = 2 * below + F.array_contains(listed, F.col("x")).cast("int")
        for at, here in sorted((r["at"], r["n"]) for r in inside.groupBy(place.alias("at")).agg(F.count("x").alias("n")).collect()):
            if rank < here:
                break
            rank -= here
        if at % 2:
            return cuts[at // 2]
        n = here
        if at // 2 > 0:
            inside = inside.where(F.col("x") > F.lit(cuts[at // 2 - 1]))
        if at // 2 < len(cuts):
            inside = inside.where(F.col("x") < F.lit(cuts[at // 2]))
    for r in sorted(inside.groupBy("x").agg(F.count("x").alias("n")).collect(), key=lambda r: r["x"]):
        if rank < r["n"]:
            return r["x"]
        rank -= r["n"]
    raise RuntimeError("the rows changed between two passes")


def _cuts(rows: DataFrame) -> list[float]:
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    return sorted(set(rows.agg(F.percentile_approx("x", shares, F.lit(_PRECISION)).alias("c")).first()["c"]))
