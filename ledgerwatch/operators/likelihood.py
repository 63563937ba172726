"""Maximum likelihood for many short ARMA series at once.

The likelihood is exact: a Kalman filter over the state-space form, started from the stationary
covariance, with the variance concentrated out. All series of a block, and all trial values of
their coefficients, run through the filter together, a step of time at a go. Coefficients are
moved in a space where every point is stationary and invertible: partial autocorrelations between
-1 and 1. The search is a quasi-Newton one from the least-squares fit; it only takes steps that
raise the likelihood.
"""

from __future__ import annotations

import numpy as np

#: Partial autocorrelations of a start stay within this.
INSIDE = 0.98
#: Steps of the search at most, lengths tried in each, and the gain that ends it.
ROUNDS, TRIED, GAIN = 40, 8, 1e-7
#: Change of the covariance below which it counts as settled.
SETTLED = 1e-13
#: Series in one block, by length, so that little is padded.
BLOCK = 1024


def from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients (..., p) of the stationary autoregression with these partial autocorrelations."""
    out = np.zeros_like(r)
    for k in range(r.shape[-1]):
        before = out[..., :k].copy()
        out[..., k] = r[..., k]
        out[..., :k] = before - r[..., k : k + 1] * before[..., ::-1]
    return out


def to_partial(a: np.ndarray) -> np.ndarray:
    """The inverse; values outside the stationary region end at its border."""
    a, out = np.array(a, float), np.zeros(len(a))
    for k in range(len(a) - 1, -1, -1):
        r = out[k] = np.clip(a[k], -INSIDE, INSIDE)
        a = (a[:k] + r * a[:k][::-1]) / (1 - r * r)
    return out


def filtered(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods, variances and innovations of series (b, n) under coefficients (b, p) and (b, q).

    NaN marks padding at the end of a series.
    """
    b, n = w.shape
    p, q = ar.shape[1], ma.shape[1]
    m = max(p, q + 1)
    move = np.zeros((b, m, m))
    move[:, :p, 0] = ar
    move[:, np.arange(m - 1), np.arange(1, m)] = 1
    shock = np.zeros((b, m))
    shock[:, 0], shock[:, 1 : q + 1] = 1, ma
    noise = shock[:, :, None] * shock[:, None, :]
    kron = np.einsum("bij,bkl->bikjl", move, move).reshape(b, m * m, m * m)
    cov = np.linalg.solve(np.eye(m * m) - kron, noise.reshape(b, m * m, 1)).reshape(b, m, m)
    logs, squares, errors = np.zeros(b), np.zeros(b), np.zeros((n, b))
    first, noise, cov = np.zeros((m, b)), noise.transpose(1, 2, 0).copy(), cov.transpose(1, 2, 0).copy()
    first[:p] = ar.T
    state, steady, over_time, present = np.zeros((m, b)), False, np.ascontiguousarray(w.T), ~np.isnan(w.T)
    for t in range(n):
        if not steady:  # the covariance settles soon, and is the same from then on
            spread = np.maximum(cov[0, 0], 1e-300)
            gain, size = cov[:, 0] / spread, np.log(spread)
            known = cov - gain[:, None] * cov[0]
            half = first[:, None] * known[0]  # a move is the first column and a shift by one
            half[:-1] += known[1:]
            after = half[:, 0, None] * first + noise
            after[:, :-1] += half[:, 1:]
            steady, cov = bool(np.abs(after - cov).max() < SETTLED), after
        here = present[t]
        error = np.where(here, over_time[t] - state[0], 0.0)
        errors[t] = error
        logs += size * here
        squares += error * error / spread
        seen = state + gain * error
        state = first * seen[0]
        state[:-1] += seen[1:]
    errors, points = errors.T, present.sum(axis=0)
    variance = squares / points
    with np.errstate(divide="ignore"):
        value = -0.5 * (points * (np.log(2 * np.pi * variance) + 1) + logs)
    return value, variance, errors


def _coefficients(u: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.tanh(u)
    return from_partial(r[..., :p]), -from_partial(-r[..., p:])


def maximised(series: list[np.ndarray], starts: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """For each series (mean taken off) and start (ar, ma): ``ar, ma, sigma2, loglik, start_loglik, errors``."""
    out: list[dict] = [{}] * len(series)
    order = sorted(range(len(series)), key=lambda i: len(series[i]))
    for at in range(0, len(order), BLOCK):
        part = order[at : at + BLOCK]
        for i, found in zip(part, _block([series[i] for i in part], [starts[i] for i in part])):
            out[i] = found
    return out


def _block(series, starts) -> list[dict]:
    p, q = len(starts[0][0]), len(starts[0][1])
    size, longest, k = len(series), max(map(len, series)), p + q
    w = np.full((size, longest), np.nan)
    scale = np.array([np.sqrt(np.mean(s * s)) or 1.0 for s in series])
    for i, s in enumerate(series):
        w[i, : len(s)] = s / scale[i]

    def values(u, rows=slice(None)):  # (rows, trials, k)
        flat = u.reshape(-1, k)
        return filtered(np.repeat(w[rows], u.shape[1], axis=0), *_coefficients(flat, p))[0].reshape(len(u), u.shape[1])

    u = np.array([np.arctanh(np.concatenate([to_partial(ar), -to_partial(-np.asarray(ma, float))])) for ar, ma in starts]).reshape(size, k)
    best = first = values(u[:, None])[:, 0]
    if k:
        u, best = _climbed(values, u, best)
    ar, ma = _coefficients(u, p)
    _, variance, errors = filtered(w, ar, ma)
    points = np.array([len(s) for s in series])
    shift = points * np.log(scale)  # the series were scaled
    return [{"ar": ar[i], "ma": ma[i], "sigma2": float(variance[i] * scale[i] ** 2), "loglik": float(best[i] - shift[i]),
             "start_loglik": float(first[i] - shift[i]), "errors": errors[i, : points[i]] * scale[i]} for i in range(size)]


def _climbed(values, u: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, k = u.shape
    step, lengths = 1e-5, 0.5 ** np.arange(TRIED)
    about = np.concatenate([np.eye(k), -np.eye(k)]) * step

    def slope(u, rows):
        f = values(u[:, None] + about, rows)
        return (f[:, :k] - f[:, k:]) / (2 * step)

    u, best, live = u.copy(), best.copy(), np.isfinite(best)
    inverse, fresh = np.repeat(np.eye(k)[None], size, axis=0), np.ones(size, bool)
    g = np.zeros((size, k))
    if live.any():
        g[live] = slope(u[live], live)
    for _ in range(ROUNDS):
        rows = np.flatnonzero(live)  # a series that has ended costs no more
        if not len(rows):
            break
        way = np.einsum("sij,sj->si", inverse[rows], g[rows])
        reach = np.abs(way).max(axis=1, keepdims=True)
        way = np.where(reach > 1, way / np.maximum(reach, 1e-300), way)
        f = values(u[rows, None] + lengths[None, :, None] * way[:, None], rows)
        f = np.where(np.isfinite(f), f, -np.inf)
        at = f.argmax(axis=1)
        new = f[np.arange(len(rows)), at]
        better = new > best[rows]
        moved = np.where(better[:, None], lengths[at][:, None] * way, 0.0)
        gain = np.where(better, new - best[rows], 0.0)
        u[rows] += moved
        best[rows] = np.where(better, new, best[rows])
        now = slope(u[rows], rows)
        change = g[rows] - now  # of the negative likelihood's slope
        along = np.einsum("si,si->s", moved, change)
        ok = better & (along > 1e-12)
        rho = np.where(ok, 1 / np.where(ok, along, 1), 0.0)
        left = np.eye(k) - rho[:, None, None] * moved[:, :, None] * change[:, None, :]
        turned = left @ inverse[rows] @ left.transpose(0, 2, 1) + rho[:, None, None] * moved[:, :, None] * moved[:, None, :]
        once_more = np.where(better[:, None, None], inverse[rows], np.eye(k))  # along the slope itself
        inverse[rows] = np.where(ok[:, None, None], turned, once_more)
        live[rows] = ~(~better & fresh[rows]) & ~(better & (gain < GAIN))
        fresh[rows] = ~better
        g[rows] = now
    return u, best
