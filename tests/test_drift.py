import bisect
import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwatch.operators import drift, evaluate, prefix, stats


def long_rows(frame, ref, det):
    rows = [("x", float(v), 1, 0) for v in ref] + [("x", float(v), 0, 1) for v in det]
    return frame(rows, "feature string, x double, ref bigint, det bigint")


def ks(frame, ref, det):
    return drift.ks_statistic(long_rows(frame, ref, det)).first().ks_statistic


def psi(frame, ref, det):
    return drift.psi(long_rows(frame, ref, det)).first().psi


def test_psi_and_ks_by_hand(frame):
    assert psi(frame, range(10), range(10)) == pytest.approx(0, abs=1e-12)
    assert psi(frame, range(10), [0] * 5 + [9] * 5) == pytest.approx(17.866163, abs=1e-5)
    assert psi(frame, range(10), [0, 1, 2, 3, 20]) == pytest.approx(12.711218, abs=1e-5)
    assert ks(frame, range(10), [0] * 5 + [9] * 5) == pytest.approx(0.4)
    assert psi(frame, [5] * 10, [5] * 3) == pytest.approx(0, abs=1e-12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.lists(st.integers(0, 40), min_size=1, max_size=40))
def test_ks_properties(frame, a, b):
    d = ks(frame, a, b)
    sa, sb = sorted(a), sorted(b)
    brute = max(abs(bisect.bisect_right(sa, v) / len(sa) - bisect.bisect_right(sb, v) / len(sb)) for v in a + b)
    assert d == pytest.approx(brute) and d == pytest.approx(ks(frame, b, a)) and 0 <= d <= 1
    assert psi(frame, a, b) >= 0


def test_shifted_feature_drifts_and_ladder(frame):
    rng = random.Random(1)
    now = datetime(2024, 3, 1)
    rows = []
    for i in range(600):
        old = i < 300
        at = now - timedelta(days=20 if old else 3)
        rows.append((f"h{i}", at, rng.gauss(100 if old else 200, 10), rng.gauss(21000, 1000), rng.gauss(20, 2)))
    tx = frame(rows, "hash string, timestamp timestamp, value double, gas double, gas_price double")
    rows = {r.feature: r for r in drift.feature_drift(drift.tagged(tx, drift.Periods(now))).collect()}
    assert rows["value"].drift_detected and rows["value"].psi > 0.2
    assert rows["value"].mean_change_pct == pytest.approx(100, abs=5)

    def severity(*pairs):
        df = frame([(p, d) for p, d in pairs], "psi double, drift_detected boolean")
        return drift.drift_severity(df).first().drift_severity

    assert severity((.05, False), (.03, False)) == "none"
    assert severity((.6, True), (.4, True), (.7, True)) == "critical"
    assert severity((.25, True), (.1, False)) == "high"
    assert severity((.05, True), (.1, False), (.1, False), (.1, False), (.1, False)) == "low"


def test_boundary_row_counts_twice(frame):
    now = datetime(2024, 3, 1)
    at = [now - timedelta(days=d) for d in (38, 37, 7, 6, 0)]
    tx = frame([(f"h{i}", t, 1.0, 1.0, 1.0) for i, t in enumerate(at)],
               "hash string, timestamp timestamp, value double, gas double, gas_price double")
    p = drift.Periods(now)
    row = drift.window_counts(drift.tagged(tx, p)).first()
    assert (row.reference_count, row.detection_count) == (2, 3)
    none = tx.where("hash = 'none'")
    anomalies = frame([(1, now, 0.5, "low", True, None)],
                      "model_version_id int, detected_at timestamp, confidence double, severity string, "
                      "reviewed boolean, false_positive boolean")
    row = drift.drift_report(none, anomalies, p).first()
    assert row.insufficient_data and not row.drift_detected and row.recommendation == "insufficient_data"
    assert row.advice.startswith("NONE")


def test_pvalue_series(frame):
    df = frame([(0.4, 10, 10), (0.01, 100, 100), (1.0, 50, 50)], "d double, n bigint, m bigint")
    got = [r.p for r in df.select(drift.ks_pvalue(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    x = math.sqrt(5) * 0.4
    assert got[0] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))
    assert got[1] == 1.0 and got[2] == pytest.approx(0, abs=1e-9)


def test_running_sums_and_quantiles_with_a_hot_value(frame):
    rng = random.Random(3)
    values = [7.0] * 500 + [float(rng.randint(0, 300)) for _ in range(1000)]
    df = frame([("a", v, 1) for v in values] + [("b", v, 1) for v in values[:20]], "k string, x double, n bigint")
    got = {(r.k, r.x): (r.n_upto, r.n_total) for r in prefix.running_sums(df, ["k"], "x", ["n"], 8).collect()}
    ordered = sorted(values)
    assert all(got["a", v] == (bisect.bisect_right(ordered, v), len(values)) for v in set(values))
    for share in (0.0, 0.01, 0.37, 0.5, 1.0):
        at = share * (len(ordered) - 1)
        want = ordered[math.floor(at)] + (ordered[math.ceil(at)] - ordered[math.floor(at)]) * (at % 1)
        q = prefix.exact_quantiles(df.where("k = 'a'"), [], "x", share).first().quantile
        assert q == pytest.approx(want)


def test_auc_and_binary(frame):
    rows = [(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1), (1, 0.4), (0, 0.3)]
    df = frame(rows, "y_true int, score double")
    pairs = [(p > n) + 0.5 * (p == n) for t, p in rows if t for u, n in rows if not u]
    assert evaluate.roc_auc(df).first().roc_auc == pytest.approx(sum(pairs) / len(pairs))
    three = frame([(0, 0.1), (1, 0.2), (2, 0.3)], "y_true int, score double")
    assert evaluate.roc_auc(three).first().roc_auc is None
    empty = frame([(0, 0)], "a int, b int")
    row = evaluate.binary_evaluation(empty, F.col("a") == 1, F.col("b") == 1).first()
    assert (row.precision, row.recall, row.f1_score, row.true_negatives) == (0, 0, 0, 1)


def test_histogram_edges(frame):
    df = frame([(float(v),) for v in (0, 1, 2, 3, 10)], "value double")
    assert [r.n for r in stats.histogram(df, "value", 5).orderBy("bin").collect()] == [2, 2, 0, 0, 1]
    with pytest.raises(ValueError):
        stats.histogram(df, "absent")


def test_exact_quantile_of_a_stored_column(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    for few in (5, 10**5):
        monkeypatch.setattr(prefix, "FEW", few)
        for x in ([3.0], [1.0, 2.0], [0.0] * 50 + [1e-300, 1e300, -1e300], rng.normal(size=3000).tolist(), (rng.integers(0, 9, 500) / 2).tolist()):
            df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "x double")
            for share in (0.0, 0.01, 0.37, 0.5, 1.0):
                assert prefix.exact_quantile(df, "x", share) == pytest.approx(np.quantile(x, share), rel=1e-12)
    assert prefix.exact_quantile(df.where("x is null"), "x", 0.5) is None


def test_no_nested_loop_join(frame):
    df = frame([(float(i % 7), 1) for i in range(50)], "x double, n bigint")
    plan = prefix.running_sums(df, [], "x", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
