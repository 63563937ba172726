from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import likelihood, long_series, series


def made(n, ar=(), ma=(), d=0, mean=0.0, seed=0):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 50), np.zeros(n + 50)
    for t in range(len(w)):
        w[t] = e[t] + sum(c * w[t - k] for k, c in enumerate(ar, 1) if t >= k) + sum(c * e[t - k] for k, c in enumerate(ma, 1) if t >= k)
    y = w[50:] + mean
    for _ in range(d):
        y = np.cumsum(y)
    return y


def rows_of(frame, y):
    return frame([(date(1990, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(y)], "day date, value double")


@pytest.mark.parametrize("order, y", [
    ((5, 1, 0), made(900, (0.5, -0.2), d=1, seed=1)), ((2, 0, 0), made(700, (0.6, -0.3), mean=40.0, seed=2)),
    ((1, 0, 2), made(800, (0.4,), (0.5, 0.2), mean=-7.0, seed=3)), ((0, 1, 1), made(650, (), (0.6,), d=1, seed=4)),
    ((1, 2, 0), made(500, (0.3,), d=2, seed=5)), ((0, 0, 0), made(60, mean=3.0, seed=6)),
])
@pytest.mark.parametrize("hot_rows", [97, 10_000])
def test_long_fit_equals_the_array_fit(frame, order, y, hot_rows):
    df = rows_of(frame, y)
    fitted, plain = long_series.fit_long(df, order, hot_rows), series.fit_arima(df, order=order).first()
    assert (fitted.points, fitted.status) == (plain.points, plain.status)
    assert fitted.ar == pytest.approx(plain.ar, abs=1e-9) and fitted.ma == pytest.approx(plain.ma, abs=1e-9)
    assert fitted.constant == pytest.approx(plain.constant, abs=1e-9) and fitted.sigma2 == pytest.approx(plain.sigma2, rel=1e-8)
    ahead = [(r.step, r.day, r.forecast) for r in long_series.forecast_long(df, order, 7, hot_rows).orderBy("step").collect()]
    want = [(r.step, r.day, pytest.approx(r.forecast, rel=1e-7, abs=1e-7)) for r in series.forecast(df, order=order, steps=7).orderBy("step").collect()]
    assert ahead == want


def test_long_plan_gathers_no_series(frame, monkeypatch):
    """No aggregate of the plan collects the series; a hot one is cut into slices."""
    plans, old = [], long_series._moments

    def seen(rows, columns, since):
        plans.append(rows._jdf.queryExecution().toString())
        return old(rows, columns, since)

    monkeypatch.setattr(long_series, "_moments", seen)
    lagged = long_series._lagged(rows_of(frame, made(600, (0.5,))), 3, 100)
    slices = lagged.count()
    assert slices == 600
    long_series.fit_long(rows_of(frame, made(600, (0.5,))), (2, 0, 0), 100)
    values = [line for p in plans for line in p.splitlines() if "collect_list" in line and "value" in line.split("collect_list")[1][:40]]
    # Only the slices' last rows travel as lists: as many as there are lags.
    assert plans and all("_rank" in p for p in plans) and not [v for v in values if "_tail" not in v and "day" not in v]


def test_long_fit_of_short_series(frame):
    for n in (0, 1, 2, 3, 6, 9):
        df = rows_of(frame, made(n, seed=8))
        plain = series.fit_arima(df).first()
        fitted = long_series.fit_long(df)
        assert fitted.status == ("insufficient" if plain is None else plain.status)
        if fitted.status == "ok":
            assert fitted.ar == pytest.approx(plain.ar, abs=1e-9)
        assert long_series.forecast_long(df, steps=3).count() == (3 if fitted.status == "ok" else 0)


# -- likelihood ------------------------------------------------------------------------------


def dense_loglik(w, ar, ma):
    """The normal density of the whole series, from its autocovariances (a long moving average)."""
    psi = np.zeros(4000)
    for j in range(len(psi)):
        psi[j] = (1.0 if j == 0 else ma[j - 1] if j <= len(ma) else 0.0) + sum(c * psi[j - k] for k, c in enumerate(ar, 1) if j >= k)
    gamma = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(len(w))])
    cov = gamma[np.abs(np.subtract.outer(np.arange(len(w)), np.arange(len(w))))]
    sigma2 = w @ np.linalg.solve(cov, w) / len(w)
    return -0.5 * (len(w) * (np.log(2 * np.pi * sigma2) + 1) + np.linalg.slogdet(cov)[1])


@pytest.mark.parametrize("ar, ma", [((0.7,), ()), ((), (0.5,)), ((0.5, -0.3), (0.4,)), ((0.2,), (-0.6, 0.1))])
def test_filter_gives_the_exact_likelihood(ar, ma):
    w = made(40, ar, ma, seed=9)
    padded = np.concatenate([w, [np.nan] * 5])[None]
    value, _, errors = likelihood.filtered(padded, np.array([ar]), np.array([ma]))
    assert value[0] == pytest.approx(dense_loglik(w, ar, ma), abs=1e-8)
    assert errors[0, -5:].tolist() == [0] * 5


def test_partial_autocorrelations_are_inverse():
    rng = np.random.default_rng(3)
    for k in range(1, 6):
        r = rng.uniform(-0.9, 0.9, k)
        a = likelihood.from_partial(r[None])[0]
        assert likelihood.to_partial(a) == pytest.approx(r)
        assert np.abs(np.roots(np.concatenate([[1.0], -a]))).max() < 1


def test_likelihood_recovers_moving_averages(frame):
    """Many series at once, of unequal lengths; never below the start, better than least squares on short ones."""
    rows, squares, likely = [], [], []
    for s in range(40):
        y = made(80 + s, (), (0.7,), seed=100 + s)
        rows += [(s, date(2000, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(y)]
    rows += [(90, date(2000, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(made(1500, (), (0.6,), seed=7))]
    rows += [(91, date(2000, 1, 1) + timedelta(days=i), 5.0) for i in range(30)] + [(92, date(2000, 1, 1), 1.0)]
    df = frame(rows, "k int, day date, value double")
    fitted = {r.k: r for r in series.fit_arima(df, ["k"], (0, 0, 1), "likelihood").collect()}
    plain = {r.k: r for r in series.fit_arima(df, ["k"], (0, 0, 1)).collect()}
    assert fitted[90].ma[0] == pytest.approx(0.6, abs=0.05) and fitted[90].sigma2 == pytest.approx(1.0, abs=0.1)
    assert fitted[91].status == "ok" and fitted[91].loglik is None and fitted[92].status == "insufficient"
    for s in range(40):
        assert fitted[s].loglik >= fitted[s].start_loglik
        squares.append((plain[s].ma[0] - 0.7) ** 2)
        likely.append((fitted[s].ma[0] - 0.7) ** 2)
    assert np.mean(likely) < np.mean(squares)
    ahead = series.forecast(df, ["k"], (0, 0, 1), 3, "likelihood").where(F.col("k") < 90)
    assert ahead.count() == 120 and ahead.where("forecast is null or isnan(forecast)").count() == 0
    with pytest.raises(ValueError):
        series.fit_arima(df, ["k"], method="guess")


def test_likelihood_of_a_mixed_model_beats_every_neighbour():
    w = made(400, (0.6,), (0.4,), seed=11)
    found = likelihood.maximised([w, w[:100]], [(np.array([0.1]), np.array([0.0])), (np.array([1.7]), np.array([-3.0]))])
    assert found[0]["ar"] == pytest.approx([0.6], abs=0.15) and found[0]["ma"] == pytest.approx([0.4], abs=0.15)
    for f, s in zip(found, (w, w[:100])):
        assert f["loglik"] >= f["start_loglik"]
        for da in (-0.01, 0.01, 0):
            for dm in (-0.01, 0.01, 0):
                near = likelihood.filtered(s[None], np.array([f["ar"] + da]), np.array([f["ma"] + dm]))[0][0]
                assert near <= f["loglik"] + 1e-6
