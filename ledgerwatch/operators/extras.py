"""Address profiles, mergeable scaling state, category tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.gamma import chi_square_pvalue
from ledgerwatch.functions.numeric import num


def address_profile(tx: DataFrame, address: str = "from_address", ts: str = "timestamp") -> DataFrame:
    """Transactions, first and last sight and age in days of every address."""
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return tx.groupBy(address).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        (span / F.lit(86_400_000_000.0)).alias("age_days"),
        F.sum("value").alias("total_value"),
    )


def batch_moments(df: DataFrame, columns: Sequence[str], by: Sequence[Column] = ()) -> DataFrame:
    """Count, mean, sum of squared deviations, min and max per column, of one batch or of each
    part that ``by`` (named expressions) tells apart; one pass either way."""
    wide = df.select(*[b.alias(f"_by{i}") for i, b in enumerate(by)], *[num(F.col(c)).alias(c) for c in columns])
    parts = [f"_by{i}" for i in range(len(by))]
    long = wide.unpivot(parts, list(columns), "feature", "x").where("x is not null")
    return long.groupBy("feature", *parts).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"),
        (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("lo"), F.max("x").alias("hi"),
    ).drop(*parts)


def merge_moments(*states: DataFrame) -> DataFrame:
    """Combine any number of states, of several tables or of one (Chan, Golub and LeVeque 1979).

    The spread between the states needs the common mean: a window over the states of a
    feature, of which there is one per batch, gives it in the pass that adds them up.
    """
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    feature = Window.partitionBy("feature")
    common = F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    gap = F.col("mean") - F.col("_mean")
    return every.withColumn("_mean", common).groupBy("feature").agg(
        F.sum("n").cast("bigint").alias("n"), F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )


def scale_with_state(df: DataFrame, state: DataFrame, columns: Sequence[str], mode: str = "zscore") -> DataFrame:
    """Scale by the state of earlier batches: z-score or min-max; zero spread divides by 1."""
    if mode not in ("zscore", "minmax"):
        raise ValueError("mode must be zscore or minmax")
    rows = state.where(F.col("feature").isin(*columns))
    std = F.when(F.col("n") < 2, 1.0).otherwise(F.sqrt(F.col("m2") / (F.col("n") - 1)))
    spread = std if mode == "zscore" else F.col("hi") - F.col("lo")
    shift = F.col("mean") if mode == "zscore" else F.col("lo")
    pivoted = rows.select(
        "feature", shift.alias("shift"), F.when(spread == 0, 1.0).otherwise(spread).alias("spread")
    ).agg(F.struct(*[
        F.max(F.when(F.col("feature") == c, F.struct("shift", "spread"))).alias(c) for c in columns
    ]).alias("s")).scalar()
    return df.withColumns({
        c: (num(F.col(c)) - pivoted.getField(c).getField("shift"))
        / pivoted.getField(c).getField("spread")
        for c in columns
    })


def chi_square(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson's statistic of the contingency table of two categories.

    Only cells that occur are listed; the absent ones add their expected counts, which sum to
    the total less the expected counts of the present ones. No pairs are generated. With one
    category only on a side there are no degrees of freedom and no p-value.
    """
    cells = df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(left).agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(right).agg(F.sum("n").alias("col_n"))
    total = cells.agg(F.sum("n")).scalar()
    expected = F.col("row_n") * F.col("col_n") / total.cast("double")
    gap = F.col("n") - F.col("e")
    return (
        cells.join(rows, left).join(columns, right).withColumn("e", expected)
        .agg(
            (F.sum(gap * gap / F.col("e")) + F.sum("n") - F.sum("e")).alias("statistic"),
            ((F.count_distinct(left) - 1) * (F.count_distinct(right) - 1)).alias("degrees"),
            F.sum("n").cast("bigint").alias("n"),
        )
    )


def chi_square_test(df: DataFrame, left: str, right: str) -> DataFrame:
    """``chi_square`` with its p-value."""
    return chi_square(df, left, right).withColumn("p_value", chi_square_pvalue(F.col("statistic"), F.col("degrees")))
