"""Exact laws, p-values, quantiles of a column and sketches."""

import math
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions.gamma import chi_square_pvalue, upper_gamma
from ledgerwatch.operators import drift, extras, monitor, prefix, sketches


# -- quantiles -------------------------------------------------------------------------------


@pytest.mark.parametrize("x", [
    [math.inf] * 40 + [-math.inf] * 20 + list(range(60)), [1e308, -1e308, 1e-308, -1e-308, 0.0, -0.0] * 30,
    [math.inf] * 100, [0.0] * 500 + [1.0], np.exp(np.random.default_rng(1).normal(size=600) * 50).tolist(),
])
def test_quantiles_of_infinite_and_skewed_columns(spark, monkeypatch, x):
    monkeypatch.setattr(prefix, "FEW", 10)
    ordered, df = np.sort(np.array(x)), spark.createDataFrame([(float(v),) for v in [*x, float("nan")]] + [(None,)], "x double")
    for share in (0.0, 0.3, 0.5, 0.77, 1.0):
        at = share * (len(x) - 1)
        low, high = float(ordered[math.floor(at)]), float(ordered[math.ceil(at)])
        want = low if low == high else low + (high - low) * (at % 1)
        got = prefix.exact_quantile(df, "x", share)
        assert got == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_passes_of_a_quantile_are_few(spark, monkeypatch):
    """Every pass leaves a sixtieth: 200 000 rows of a column that halves down to nothing, two passes."""
    df = spark.range(200_000).select(F.pow(F.lit(0.5), F.col("id") / 200.0).alias("x"))
    passes, old = [], prefix._cuts
    monkeypatch.setattr(prefix, "FEW", 200)
    monkeypatch.setattr(prefix, "_cuts", lambda rows: passes.append(1) or old(rows))
    assert prefix.exact_quantile(df, "x", 0.5) == pytest.approx(0.5 ** (99_999.5 / 200), rel=1e-3)
    assert len(passes) <= 2 * 2


# -- two samples -----------------------------------------------------------------------------


def plain_share(m, n, distance):
    """By listing all orders of the two samples."""
    hits = total = 0
    for chosen in combinations(range(m + n), m):
        i = j = most = 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            most = max(most, abs(i * n - j * m))
        hits, total = hits + (most >= distance), total + 1
    return hits / total


@pytest.mark.parametrize("m, n", [(1, 1), (1, 4), (3, 3), (4, 6), (5, 5), (2, 9)])
def test_exact_law_by_listing(m, n):
    for distance in range(0, m * n + 2):
        assert drift.outside_probability(m, n, distance) == pytest.approx(plain_share(m, n, distance) if distance else 1.0, abs=1e-14)


def test_exact_law_in_the_tail_and_in_the_limit():
    """Total separation of n and n values: 2 of all orders; many rows: near the asymptotic series."""
    assert drift.outside_probability(30, 30, 900) == pytest.approx(2 / math.comb(60, 30), rel=1e-12)
    n, d = 2000, 0.04
    x = math.sqrt(n / 2) * d
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 50))
    assert drift.outside_probability(n, n, round(d * n * n)) == pytest.approx(series, abs=0.01)


def test_law_by_size(frame, spark):
    rows = frame([("a", 0.5, 10, 12), ("b", 0.5, 10, 40), ("c", 1.0, 5, 5), ("d", 0.3, 41, 3)],
                 "feature string, ks_statistic double, n_reference long, n_detection long")
    found = {r.feature: r.ks_pvalue for r in drift.ks_pvalue_exact(rows, 40).collect()}
    assert found["a"] == pytest.approx(drift.outside_probability(10, 12, 60))
    assert found["b"] == pytest.approx(drift.outside_probability(10, 40, 200)) and found["c"] == pytest.approx(2 / math.comb(10, 5))
    series = rows.withColumn("p", drift.ks_pvalue(F.col("ks_statistic"), F.col("n_reference"), F.col("n_detection")))
    assert found["d"] == series.where("feature = 'd'").first().p
    assert drift.ks_pvalue_exact(rows.limit(0)).count() == 0


# -- chi-square ------------------------------------------------------------------------------


def test_upper_gamma_against_closed_forms(spark):
    """Whole a: a Poisson sum; halves: the error function and a recursion."""
    rows = []
    for a in [1, 2, 3, 7, 20, 60, 150, 400]:
        for x in (1e-9, 0.1, 0.9, a / 2, a * 0.95, float(a), a * 1.05, a + 5.0, a * 2.0, a * 4.0 + 20):
            rows.append((float(a), x, math.fsum(math.exp(-x + i * math.log(x) - math.lgamma(i + 1)) for i in range(a))))
    for x in (1e-6, 0.2, 1.0, 3.0, 9.0, 30.0):
        half = math.erfc(math.sqrt(x))
        rows.append((0.5, x, half))
        rows.append((1.5, x, half + 2 * math.sqrt(x / math.pi) * math.exp(-x)))
    rows.append((3.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "a double, x double, want double")
    for r in df.withColumn("q", upper_gamma(F.col("a"), F.col("x"))).collect():
        assert r.q == pytest.approx(r.want, abs=1e-10, rel=1e-8), (r.a, r.x)


def test_chi_square_pvalues(spark):
    """Values of the printed table: 5 % and 1 % points."""
    table = [(3.841458820694124, 1, 0.05), (6.634896601021213, 1, 0.01), (18.307038053275146, 10, 0.05), (23.209251158954356, 10, 0.01),
             (124.34211340400407, 100, 0.05), (0.0, 5, 1.0)]
    df = spark.createDataFrame([*table, (3.0, 0, None)], "s double, d long, want double")
    for r in df.withColumn("p", chi_square_pvalue(F.col("s"), F.col("d"))).collect():
        assert r.p is None if r.want is None else r.p == pytest.approx(r.want, abs=1e-8)
    same = spark.createDataFrame([("a", "x"), ("a", "y")] * 5, "l string, r string")
    one = extras.chi_square_test(same, "l", "r").first()
    assert one.degrees == 0 and one.p_value is None


# -- sketches --------------------------------------------------------------------------------


def requests(spark, n=30_000):
    rng, start = np.random.default_rng(4), datetime(2024, 1, 1)
    times, paths = np.sort(rng.integers(0, 7200, n)), rng.choice(["/a/1", "/a/2", "/b", "/b/0xff"], n, p=[0.6, 0.1, 0.2, 0.1])
    x = rng.lognormal(-2, 1, n)
    rows = [(start + timedelta(seconds=int(t)), "GET", str(p), float(v) if i % 97 else None) for i, (t, p, v) in enumerate(zip(times, paths, x))]
    return spark.createDataFrame(rows, "ts timestamp, method string, path string, duration_s double")


def test_percentiles_within_the_stated_error(spark):
    df = requests(spark).cache()
    windows = sketches.latency_sketches(df, "5 minutes")
    assert windows.count() == 24 * 3
    merged = sketches.percentiles(sketches.merged_sketches(windows, ["method", "endpoint"]))
    at_once = {r.endpoint: r for r in sketches.percentiles(sketches.latency_sketches(df, "1 day").drop("window_start")).collect()}
    values = {}
    for r in df.where("duration_s is not null").select(monitor.endpoint(F.col("path")).alias("e"), "duration_s").collect():
        values.setdefault(r.e, []).append(r.duration_s)
    error = sketches.rank_error()
    assert error < 0.011
    for r in merged.collect():
        x = np.sort(values[r.endpoint])
        assert r["values"] == len(x) == at_once[r.endpoint]["values"]
        for share, name in zip(sketches.PERCENTILES, ("p50", "p95", "p99")):
            for got in (r[name], at_once[r.endpoint][name]):
                assert np.searchsorted(x, got) / len(x) - error <= share <= np.searchsorted(x, got, "right") / len(x) + error
    hours = sketches.percentiles(sketches.merged_sketches(windows, ["endpoint"], "1 hour"), (0.0, 1.0))
    assert hours.count() == 6 and hours.agg(F.sum("values")).first()[0] == sum(map(len, values.values()))
    with pytest.raises(ValueError):
        sketches.percentiles(windows, (1.5,))


def test_small_sketches_are_exact(spark):
    """Below the size of a sketch all values are kept: merged windows give what one sketch gives."""
    df = requests(spark, 300).where("path = '/b'")
    merged = sketches.percentiles(sketches.merged_sketches(sketches.latency_sketches(df, "5 minutes"), ["endpoint"]), (0.1, 0.5, 0.9)).first()
    once = sketches.percentiles(sketches.latency_sketches(df, "1 day"), (0.1, 0.5, 0.9)).first()
    assert [merged[c] for c in ("values", "p10", "p50", "p90")] == [once[c] for c in ("values", "p10", "p50", "p90")]
    assert sketches.latency_sketches(df.limit(0)).count() == 0
