from datetime import date, datetime, timedelta

import numpy as np
import pytest

from ledgerwatch.operators import series

DAYS = [(datetime(2023, 1, 1) + timedelta(days=i), v) for i, v in enumerate((100., 200., 150., 300., 500., 600., 700.))]


def test_dense_series_fits_and_forecasts(frame):
    daily = series.daily_series(frame(DAYS, "timestamp timestamp, value double"))
    assert [r.value for r in daily.orderBy("day").collect()] == [v for _t, v in DAYS]
    ahead = series.forecast(daily, steps=3).orderBy("step").collect()
    assert [r.day for r in ahead] == [date(2023, 1, 8), date(2023, 1, 9), date(2023, 1, 10)]
    assert all(r.forecast is not None for r in ahead)


def test_gaps_zeros_and_leading_days(frame):
    rows = [("a", datetime(2024, 1, 1), 0.0), ("a", datetime(2024, 1, 2), 5.0), ("a", datetime(2024, 1, 5), 0.0),
            ("a", datetime(2024, 1, 6), 7.0), ("b", datetime(2024, 1, 3), None)]
    daily = series.daily_series(frame(rows, "k string, timestamp timestamp, value double"), ["k"])
    got = [(r.k, r.day.day, r.value) for r in daily.orderBy("k", "day").collect()]
    assert got == [("a", 1, None), ("a", 2, 5), ("a", 3, 5), ("a", 4, 5), ("a", 5, 5), ("a", 6, 7), ("b", 3, None)]


@pytest.mark.parametrize("order, coefficients", [((2, 0, 0), (0.6, -0.3)), ((1, 1, 0), (0.5,))])
def test_recovers_coefficients(frame, order, coefficients):
    rng = np.random.default_rng(0)
    p, n = len(coefficients), 3000
    w = list(rng.normal(size=p))
    for _ in range(n):
        w.append(sum(c * w[-k] for k, c in enumerate(coefficients, 1)) + rng.normal())
    y = np.cumsum(w) if order[1] else np.array(w)
    rows = [(date(2000, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(y)]
    fitted = series.fit_arima(frame(rows, "day date, value double"), order=order).first()
    assert fitted.status == "ok" and fitted.ar == pytest.approx(coefficients, abs=0.06)


def test_moving_average_term(frame):
    rng = np.random.default_rng(1)
    e = rng.normal(size=4001)
    y = e[1:] + 0.6 * e[:-1]
    rows = [(date(2000, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(y)]
    fitted = series.fit_arima(frame(rows, "day date, value double"), order=(0, 0, 1)).first()
    assert fitted.ma == pytest.approx([0.6], abs=0.08)


def test_short_series_and_bad_arguments(frame):
    short = frame([(date(2024, 1, 1), 1.0), (date(2024, 1, 2), 2.0)], "day date, value double")
    assert series.fit_arima(short).first().status == "insufficient"
    assert series.forecast(short).count() == 0
    two = frame([(date(2024, 1, 1 + i), float(v)) for i, v in enumerate((1, 4))], "day date, value double")
    assert series.fit_arima(two, order=(1, 1, 0)).first().status == "insufficient"
    for order, kind in (([5, 1, 0], TypeError), ((1, 2), ValueError), ((1.0, 0, 0), TypeError), ((-1, 0, 0), ValueError)):
        with pytest.raises(kind):
            series.check_order(order)
    for steps, kind in ((0, ValueError), (1.5, TypeError)):
        with pytest.raises(kind):
            series.check_steps(steps)


def test_six_points_have_coefficients(frame):
    """One difference fewer than a full row of lags: the lags before the series count as zero."""
    y = (10.0, 13.0, 11.0, 16.0, 12.0, 19.0)
    six = frame([(date(2024, 1, 1 + i), v) for i, v in enumerate(y)], "day date, value double")
    fitted = series.fit_arima(six).first()
    assert fitted.status == "ok" and any(abs(c) > 1e-6 for c in fitted.ar)
    w = np.concatenate([np.zeros(5), np.diff(y)])
    x = np.column_stack([w[6 - k : len(w) - k] for k in range(1, 6)])
    assert fitted.ar == pytest.approx(np.linalg.lstsq(x, w[6:], rcond=None)[0].tolist())
    assert series.forecast(six, steps=2).count() == 2


def _sparse(frame):
    """Four addresses with gaps, a leading zero, a day without change and a null."""
    rng = np.random.default_rng(3)
    rows = [(k, datetime(2024, 1, 1) + timedelta(days=int(d)), float(v))
            for k in "abc" for d, v in zip(np.cumsum(rng.integers(1, 9, 30)), rng.uniform(1, 100, 30))]
    rows += [("a", datetime(2023, 12, 30), 0.0), ("b", datetime(2024, 9, 9), 0.0), ("d", datetime(2024, 1, 1), 3.0),
             ("d", datetime(2024, 1, 8), 3.0), ("e", datetime(2024, 1, 1), None), (None, datetime(2024, 1, 1), 1.0), (None, datetime(2024, 1, 9), 2.0)]
    return frame(rows, "k string, timestamp timestamp, value double")


def test_runs_are_the_dense_series(frame):
    tx = _sparse(frame)
    dense, runs = series.daily_series(tx, ["k"]), series.daily_series(tx, ["k"], runs=True)
    drawn = runs.selectExpr("k", "explode(sequence(day, date_add(day, days - 1))) as day", "value")
    assert drawn.exceptAll(dense).count() == dense.exceptAll(drawn).count() == 0
    assert runs.count() < dense.count()


@pytest.mark.parametrize("order", [(5, 1, 0), (1, 1, 1), (2, 0, 0)])
def test_fits_and_forecasts_of_runs(frame, order):
    tx = _sparse(frame)
    dense, runs = series.daily_series(tx, ["k"]), series.daily_series(tx, ["k"], runs=True)
    for one, other in zip(*[sorted(series.fit_arima(x, ["k"], order).collect(), key=str) for x in (dense, runs)], strict=True):
        assert one == other
    for one, other in zip(*[sorted(series.forecast(x, ["k"], order, 3).collect(), key=str) for x in (dense, runs)], strict=True):
        assert one == other


def test_runs_are_not_drawn_out_before_a_fit(frame):
    """A series of two days a century apart stays two rows up to the fit."""
    tx = frame([("a", datetime(1924, 1, 1), 1.0), ("a", datetime(2024, 1, 1), 2.0)], "k string, timestamp timestamp, value double")
    runs = series.daily_series(tx, ["k"], runs=True)
    assert runs.count() == 2
    assert "Generate" not in series.fit_arima(runs, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert series.fit_arima(runs, ["k"]).first().points == 36526


def test_slopes_of_runs(frame):
    tx = _sparse(frame)
    dense, runs = series.daily_series(tx, ["k"]), series.daily_series(tx, ["k"], runs=True)
    values = {}
    for r in dense.where("value is not null").orderBy("day").collect():
        values.setdefault(r.k, []).append(r.value)
    for rows in (dense, runs):
        found = {r.k: r for r in series.ar1_slopes(rows, ["k"]).collect()}
        assert set(found) == {k for k, y in values.items() if len(y) > 1}
        for k, r in found.items():
            x, y = np.array(values[k][:-1]), np.array(values[k][1:])
            assert r.pairs == len(x)
            if np.ptp(x) == 0:
                assert r.slope is None
            else:
                assert r.slope == pytest.approx(np.polyfit(x, y, 1)[0])
