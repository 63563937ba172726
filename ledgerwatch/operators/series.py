"""Daily series, rolling features and forecasts, for one series or millions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from ledgerwatch.functions.checks import require, require_count
from ledgerwatch.functions.features import BASE_FEATURES
from ledgerwatch.functions.numeric import num
from ledgerwatch.operators import likelihood
from ledgerwatch.operators.ordered import HOT_ROWS, with_preceding_rows
from ledgerwatch.session import python_tasks, require_columns


def daily_series(
    df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp", value: str = "value", runs: bool = False,
) -> DataFrame:
    """Dense daily sums per key: (keys, day, value).

    A day that sums to zero counts as missing and takes the last value before it; days
    before the first value stay null. Rows shrink to one per key and day before any window,
    and the spine runs from each key's own first to its own last day.

    With ``runs`` the same series has one row per day with transactions and a column ``days``:
    the value holds on that many days from ``day`` on. Fits, forecasts and slopes take both
    forms; runs keep millions of sparse series from growing to a row per day.
    """
    require_columns(df, ts, value, *keys)
    keys = list(keys) or ["_series"]
    source = df if keys != ["_series"] else df.withColumn("_series", F.lit(0))
    daily = (
        source.where(F.col(ts).isNotNull())
        .groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(F.coalesce(F.sum(num(F.col(value))), F.lit(0.0)).alias("total"))
    )
    window = Window.partitionBy(*keys).orderBy("day")
    filled = daily.select(
        *keys, "day",
        F.last(F.when(F.col("total") != 0, F.col("total")), ignorenulls=True).over(
            window.rowsBetween(Window.unboundedPreceding, 0)
        ).alias("value"),
        F.lead("day").over(window).alias("_next"),
    )
    if runs:
        days = F.coalesce(F.datediff("_next", "day"), F.lit(1))
        return filled.withColumn("days", days).drop("_next", "_series")
    until = F.coalesce(F.date_sub("_next", 1), F.col("day"))
    dense = filled.withColumn("day", F.explode(F.sequence(F.col("day"), until)))
    return dense.drop("_next", "_series")


def rolling_features(
    tx: DataFrame, key: str = "from_address", ts: str = "timestamp", tie: str = "hash",
    columns: Sequence[str] = BASE_FEATURES, rows: int = 10,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean, deviation, maximum and z-score over the last rows of an address, and the
    seconds since its previous row."""
    require_columns(tx, key, ts, tie, *columns)
    seen = with_preceding_rows(tx, [key], [ts, tie], rows - 1, columns, hot_rows)
    order = Window.partitionBy(key, "_slice").orderBy(ts, tie)
    frame = order.rowsBetween(-(rows - 1), 0)
    rolled = {}
    for c in columns:
        rolled[f"{c}_rolling_mean"] = F.avg(c).over(frame)
        rolled[f"{c}_rolling_std"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
        rolled[f"{c}_rolling_max"] = F.max(c).over(frame)
    elapsed = (
        F.unix_micros(F.col(ts).cast("timestamp"))
        - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(order)
    ) / F.lit(1e6)
    rolled["time_delta"] = F.coalesce(elapsed, F.lit(0.0))

    def zscore(c: str) -> Column:
        std = F.col(f"{c}_rolling_std")
        return (F.col(c) - F.col(f"{c}_rolling_mean")) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return (
        seen.withColumns(rolled).where(~F.col("_halo"))
        .withColumns({f"{c}_zscore": zscore(c) for c in columns})
        .drop("_halo", "_slice")
    )


# -- forecasts ---------------------------------------------------------------------------


def check_order(order: tuple[int, int, int]) -> None:
    """A tuple of three whole numbers, none below zero: lags, differences, moving-average terms."""
    require(isinstance(order, tuple), TypeError, f"expected (p, d, q) as a tuple, not {order!r}")
    require(len(order) == 3, ValueError, f"expected three numbers (p, d, q), not {len(order)}")
    for name, n in zip("pdq", order):
        require_count(name, n, 0)


def check_steps(steps: int) -> None:
    require_count("steps", steps, 1)


def _lagged(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    return np.column_stack([x[start - k: len(x) - k] for k in range(1, lags + 1)]) if lags else (
        np.empty((len(x) - start, 0))
    )


def _fit(y: np.ndarray, order: tuple[int, int, int]):
    """Least squares for the differenced series: (constant, ar, ma, residuals, variance).

    Moving-average terms use the residuals of a long autoregression (Hannan and Rissanen).
    A constant is fitted only without differencing.
    """
    p, d, q = order
    w = np.diff(y, n=d) if d else y
    mean = float(w.mean()) if d == 0 and len(w) else 0.0
    w = w - mean
    residuals = np.zeros(len(w))
    if q:
        long = min(max(p, q) + 4, max(len(w) // 3, 1))
        if len(w) > long:
            x = _lagged(w, long, long)
            beta = np.linalg.lstsq(x, w[long:], rcond=None)[0]
            residuals[long:] = w[long:] - x @ beta
    start = max(p, q)
    if 1 < len(w) <= start:  # too short for a full row of lags: those before the series are zero
        w, residuals = np.concatenate([np.zeros(start), w]), np.concatenate([np.zeros(start), residuals])
        mean, ar, ma, errors, variance = _least_squares(w, residuals, mean, p, q, start + 1)
        return mean, ar, ma, errors[start:], variance
    if start == 0 or len(w) <= start:
        return mean, np.zeros(p), np.zeros(q), w, float(np.var(w)) if len(w) else 0.0
    return _least_squares(w, residuals, mean, p, q, start)


def _least_squares(w: np.ndarray, residuals: np.ndarray, mean: float, p: int, q: int, start: int):
    x = np.hstack([_lagged(w, p, start), _lagged(residuals, q, start)])
    beta = np.linalg.lstsq(x, w[start:], rcond=None)[0]
    errors = np.zeros(len(w))
    errors[start:] = w[start:] - x @ beta
    return mean, beta[:p], beta[p:], errors, float(np.mean(errors[start:] ** 2))


def forecast_from(
    y: np.ndarray, order: tuple[int, int, int], steps: int, mean: float, ar: Sequence[float],
    ma: Sequence[float], errors: Sequence[float],
) -> np.ndarray:
    """The next values from the last ones, the coefficients and the last errors."""
    _, d, _ = order
    y = y[-(max(len(ar), len(ma)) + d + 1):]  # no more is looked back on
    w = list((np.diff(y, n=d) if d else y) - mean)
    e = list(errors[-len(ma):]) if len(ma) else []
    for _ in range(steps):
        back = sum(c * w[-k] for k, c in enumerate(ar, 1) if k <= len(w))
        shock = sum(c * e[-k] for k, c in enumerate(ma, 1) if k <= len(e))
        w.append(back + shock)
        e.append(0.0)
    ahead = np.array(w[-steps:]) + mean
    for level in range(d - 1, -1, -1):
        ahead = np.cumsum(ahead) + np.diff(y, n=level)[-1]
    return ahead


def _fits(values: Sequence, order: tuple[int, int, int], method: str) -> list[tuple | None]:
    """For each series (constant, ar, ma, errors, variance, log-likelihood, that of the start), or None.

    The likelihoods are None after least squares, and for a series without any change.
    """
    ys = [np.asarray(v, float) for v in values]
    out = [(*_fit(y, order), None, None) if _enough(y, order) else None for y in ys]
    if method == "likelihood":
        _, d, _ = order
        some, found = [], []
        for i, fit in enumerate(out):
            if fit is not None:
                w = (np.diff(ys[i], n=d) if d else ys[i]) - fit[0]
                if np.ptp(w) > 0 and np.isfinite(w).all():
                    some.append((i, w))
        if some:
            found = likelihood.maximised([w for _, w in some], [(out[i][1], out[i][2]) for i, _ in some])
        for (i, _), f in zip(some, found):
            out[i] = (out[i][0], f["ar"], f["ma"], f["errors"], f["sigma2"], f["loglik"], f["start_loglik"])
    return out


def _dealt(arrays: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """The search for a likelihood takes long for its few bytes, so it gets all tasks there are."""
    return arrays if method == "least_squares" else arrays.repartition(python_tasks(arrays.sparkSession), *keys)


def check_method(method: str) -> None:
    if method not in ("least_squares", "likelihood"):
        raise ValueError(f"unknown method: {method}")


def _grouped(series: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return series, list(keys)
    return series.withColumn("series", F.lit(0)), ["series"]


def _as_arrays(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series: its last day, its values in day order and the days each holds (null: one).

    An array is as long as the series has rows, whatever the number of transactions; runs are
    drawn out to days where a series is fitted, a few at a time.
    """
    held = "days" in series.columns
    last = F.max(F.date_add("day", F.col("days") - 1) if held else F.col("day"))
    kept = F.struct("day", "value", *(["days"] if held else []))
    points = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), kept)))
    return series.groupBy(*keys).agg(last.alias("last"), points.alias("_p")).select(
        *keys, "last", (F.col("_p.days") if held else F.lit(None).cast("array<int>")).alias("days"), F.col("_p.value").alias("y")
    )


#: Series drawn out to days at a time; a search for likelihoods does well with many.
_AT_ONCE = {"least_squares": 256, "likelihood": 4096}


def _fitted(batches, order: tuple[int, int, int], method: str):
    """For each row of ``_as_arrays``: (its keys and last day, its values day by day, the fit or None)."""
    for pdf in batches:
        rows = list(pdf.itertuples(index=False, name=None))
        for at in range(0, len(rows), _AT_ONCE[method]):
            part = rows[at : at + _AT_ONCE[method]]
            ys = [np.asarray(r[-1], float) if r[-2] is None else np.repeat(np.asarray(r[-1], float), r[-2]) for r in part]
            yield [(r[:-2], y, one) for r, y, one in zip(part, ys, _fits(ys, order, method))]


def _enough(y: np.ndarray, order: tuple[int, int, int]) -> bool:
    """Points for all coefficients, and two differences at least where lags are fitted."""
    p, d, q = order
    return len(y) >= max(p + d + q, 1) and len(y) - d >= (2 if max(p, q) else 1)


def fit_arima(
    series: DataFrame, keys: Sequence[str] = (), order: tuple[int, int, int] = (5, 1, 0), method: str = "least_squares",
) -> DataFrame:
    """One row per series with its coefficients, or the status ``insufficient``.

    ``method`` is ``least_squares`` or ``likelihood`` (exact, from the least-squares start; then
    with ``loglik`` and ``start_loglik``, null for a series without any change). Each series is one
    array in one task; ``long_series`` fits one of any length.
    """
    check_order(order)
    check_method(method)
    rows, keys = _grouped(series, keys)
    extra = [StructField(n, DoubleType()) for n in ("loglik", "start_loglik")] if method == "likelihood" else []
    schema = StructType([
        *[rows.schema[k] for k in keys],
        StructField("points", LongType()), StructField("status", StringType()),
        StructField("constant", DoubleType()), StructField("ar", ArrayType(DoubleType())),
        StructField("ma", ArrayType(DoubleType())), StructField("sigma2", DoubleType()), *extra,
    ])

    def fit(batches):
        for part in _fitted(batches, order, method):
            found = []
            for row, y, one in part:
                if one is None:
                    found.append([*row[:-1], len(y), "insufficient"] + [None] * (4 + len(extra)))
                    continue
                constant, ar, ma, _, sigma2, *more = one
                found.append([*row[:-1], len(y), "ok", constant, list(map(float, ar)), list(map(float, ma)), sigma2,
                              *more[: len(extra)]])
            yield pd.DataFrame(found, columns=schema.names)

    return _dealt(_as_arrays(rows, keys), keys, method).mapInPandas(fit, schema)


def forecast(
    series: DataFrame, keys: Sequence[str] = (), order: tuple[int, int, int] = (5, 1, 0),
    steps: int = 10, method: str = "least_squares",
) -> DataFrame:
    """The next days of every series: (keys, step, day, forecast)."""
    check_order(order)
    check_steps(steps)
    check_method(method)
    rows, keys = _grouped(series, keys)
    ahead_schema = StructType([
        *[rows.schema[k] for k in keys], StructField("last", DateType()),
        StructField("ahead", ArrayType(DoubleType())),
    ])

    def ahead(batches):
        for part in _fitted(batches, order, method):
            found = [[*row, [] if one is None else list(map(float, forecast_from(y, order, steps, *one[:4])))] for row, y, one in part]
            yield pd.DataFrame(found, columns=ahead_schema.names)

    found = _dealt(_as_arrays(rows, keys), keys, method).mapInPandas(ahead, ahead_schema)
    return found.select(*keys, "last", F.posexplode("ahead").alias("_at", "forecast")).select(
        *keys, (F.col("_at") + 1).cast(IntegerType()).alias("step"),
        F.date_add("last", F.col("_at") + 1).alias("day"), "forecast",
    )


def ar1_slopes(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First-order slope of each series by regression on the day before, without Python.

    A run of equal days counts as often as it has pairs, so it is not drawn out. Sums are of
    differences to the first value: a series that never changes has none, and a null slope.
    """
    rows, keys = _grouped(series.where(F.col("value").isNotNull()), keys)
    window = Window.partitionBy(*keys).orderBy("day")
    held = F.col("days") if "days" in series.columns else F.lit(1)
    start = F.first("value").over(window.rowsBetween(Window.unboundedPreceding, 0))
    pairs = rows.select(
        *keys, (held - 1).alias("_same"), (F.col("value") - start).alias("_y"), (F.lag("value").over(window) - start).alias("_x"))
    step, same = F.col("_x").isNotNull().cast("int"), F.col("_same")
    x, y = F.coalesce("_x", F.lit(0.0)), F.col("_y")
    n = F.sum(step + same)
    sums = pairs.groupBy(*keys).agg(
        n.cast("bigint").alias("pairs"), F.sum(x + same * y).alias("_sx"), F.sum(step * y + same * y).alias("_sy"),
        F.sum(x * x + same * y * y).alias("_sxx"), F.sum(x * y + same * y * y).alias("_sxy")).where("pairs > 0")
    spread = F.col("_sxx") - F.col("_sx") * F.col("_sx") / F.col("pairs")
    slope = (F.col("_sxy") - F.col("_sx") * F.col("_sy") / F.col("pairs")) / F.when(spread != 0, spread)
    return sums.select(*keys, "pairs", slope.alias("slope"))
