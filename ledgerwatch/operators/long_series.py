"""Fit and forecast of one series of any length, without gathering it in one task.

Least squares needs only sums of products of a value and its lags. Lags come from windows over
slices of the series (see ``ordered``), the sums are one aggregate, and the driver solves as
many equations as there are lags. Moving averages take a second pass: the residuals of a long
autoregression are sums of lags too. A forecast needs the last few days besides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.operators.ordered import HOT_ROWS, with_preceding_rows
from ledgerwatch.operators.series import _enough, _fit, check_order, check_steps, forecast_from
from ledgerwatch.session import require_columns


@dataclass(frozen=True)
class LongFit:
    """Coefficients of a long series, and its last values and errors, oldest first."""

    order: tuple[int, int, int]
    points: int
    status: str
    constant: float | None = None
    ar: tuple[float, ...] = ()
    ma: tuple[float, ...] = ()
    sigma2: float | None = None
    last: object = None
    tail: tuple[float, ...] = ()
    errors: tuple[float, ...] = ()


def _lagged(rows: DataFrame, depth: int, hot_rows: int) -> DataFrame:
    """Each value ``v0`` with the ``depth`` values before it, null before the first."""
    seen = with_preceding_rows(rows, [], ["day"], depth, ["value"], hot_rows)
    order = Window.partitionBy("_slice").orderBy("day")
    lags = {f"v{k}": F.lag("value", k).over(order) for k in range(1, depth + 1)}
    return seen.withColumns(lags).where(~F.col("_halo")).select(F.col("value").alias("v0"), *lags)


def _difference(k: int, d: int) -> Column:
    """The d-th difference, k days back."""
    terms = [F.lit(float((-1) ** j * math.comb(d, j))) * F.col(f"v{k + j}") for j in range(d + 1)]
    return sum(terms[1:], terms[0])


def _moments(rows: DataFrame, columns: list[Column], since: Column) -> tuple[int, np.ndarray]:
    """Number of rows and sums of products of all pairs of columns, in one aggregate."""
    named = rows.where(since).select(*[c.alias(f"x{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = named.agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}")), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]).first()
    sums = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        sums[i, j] = sums[j, i] = found[f"s{i}_{j}"]
    return found["n"], sums


def _solved(n: int, sums: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of the first column on the others, and the mean squared error."""
    a, b = sums[1:, 1:], sums[1:, 0]
    beta = np.linalg.lstsq(a, b, rcond=None)[0] if len(b) else b
    return beta, max(0.0, float(sums[0, 0] - 2 * beta @ b + beta @ a @ beta)) / max(n, 1)


def fit_long(series: DataFrame, order: tuple[int, int, int] = (5, 1, 0), hot_rows: int = HOT_ROWS) -> LongFit:
    """Least-squares fit of one series of (day, value), by the rule of ``series.fit_arima``.

    Null values are left out. A series too short for all lags comes to the driver whole.
    """
    check_order(order)
    require_columns(series, "day", "value")
    p, d, q = order
    rows = series.where(F.col("value").isNotNull()).select("day", F.col("value").cast("double").alias("value"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last")).first()
    start, n = max(p, q), whole["n"]
    if n < 2 or n - d < 2:
        return LongFit(order, n, "insufficient", last=whole["last"])
    long = min(start + 4, max((n - d) // 3, 1)) if q else 0
    if n - d <= start + 2 * long + 1:
        y = np.array([r["value"] for r in rows.orderBy("day").collect()])
        if not _enough(y, order):
            return LongFit(order, n, "insufficient", last=whole["last"])
        constant, ar, ma, errors, sigma2 = _fit(y, order)
        return LongFit(order, n, "ok", constant, tuple(map(float, ar)), tuple(map(float, ma)), sigma2,
                       whole["last"], tuple(y), tuple(errors))

    depth = d + max(start, long + q)
    lagged = _lagged(rows, depth, hot_rows)
    w = _difference(0, d)
    about = lagged.select(w.alias("w")).agg(F.avg("w").alias("mean"), F.max(F.abs("w")).alias("size")).first()
    mean = about["mean"] if d == 0 else 0.0
    size = (about["size"] + abs(mean)) or 1.0  # products of about one

    def x(k: int) -> Column:
        return (_difference(k, d) - F.lit(mean)) / F.lit(size)

    early, residuals = np.zeros(0), []
    if q:
        early, _ = _solved(*_moments(lagged, [x(k) for k in range(long + 1)], F.col(f"v{d + long}").isNotNull()))
        for k in range(1, q + 1):
            rest = sum((F.lit(-float(c)) * x(k + j) for j, c in enumerate(early, 1)), x(k))
            residuals.append(F.when(F.col(f"v{d + k + long}").isNotNull(), rest).otherwise(0.0))
    columns = [x(0), *[x(k) for k in range(1, p + 1)], *residuals]
    beta, error = _solved(*_moments(lagged, columns, F.col(f"v{d + start}").isNotNull()))
    tail = rows.orderBy(F.desc("day")).limit(d + long + 2 * (p + q) + 2).collect()[::-1]
    y = np.array([r["value"] for r in tail])
    errors = _last_errors((np.diff(y, n=d) if d else y) - mean, early, beta[:p], beta[p:], len(y) == n)
    return LongFit(order, n, "ok", float(mean), tuple(map(float, beta[:p])), tuple(map(float, beta[p:])), error * size * size,
                   whole["last"], tuple(y), tuple(errors))


def _last_errors(w: np.ndarray, early: np.ndarray, ar: np.ndarray, ma: np.ndarray, whole: bool) -> np.ndarray:
    """Errors at the end of a series, from its last differences; exact for the last lags' worth."""
    def back(x, coefficients, t):
        return sum(c * x[t - k] for k, c in enumerate(coefficients, 1) if t >= k)

    residuals, errors, start = np.zeros(len(w)), np.zeros(len(w)), max(len(ar), len(ma))
    for t in range(len(early), len(w)):
        residuals[t] = w[t] - back(w, early, t)
    for t in range(start, len(w)):
        errors[t] = w[t] - back(w, ar, t) - back(residuals, ma, t)
    return errors


def forecast_long(series: DataFrame, order: tuple[int, int, int] = (5, 1, 0), steps: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The next days of one series of any length: ``step, day, forecast``; no rows if it is too short."""
    check_steps(steps)
    fitted = fit_long(series, order, hot_rows)
    rows = []
    if fitted.status == "ok":
        ahead = forecast_from(np.array(fitted.tail), order, steps, fitted.constant, fitted.ar, fitted.ma, fitted.errors)
        rows = [(k, fitted.last + timedelta(days=k), float(v)) for k, v in enumerate(ahead, 1)]
    return series.sparkSession.createDataFrame(rows, "step int, day date, forecast double")
