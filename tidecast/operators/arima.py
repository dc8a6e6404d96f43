"""ARIMA orders of one series from one matrix of lag moments.

For every degree of differencing the changes of a series give, in one pass, the sums of products of its lags and of the lags of its
shocks, which a long autoregression estimates.  An order's least squares are the rows and columns of that matrix that belong to it, plus
the few early rows that it can use and longer orders cannot; so a search over orders reads a series once.  Where too few rows are left
for the shocks, autoregression and moving average come from the innovations of the sample autocovariances, so no part of an order is dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG, DEPTH = 8, 25
SHORT = 8  # fixed value: below so many points the order is reduced
REDUCED = "fewer than 8 points: order reduced to ({},0,{})"
FALLBACK = "ARIMA fitting failed; used naive fallback. Reason: {}"


def _lags(z: np.ndarray, count: int, begin: int) -> np.ndarray:
    """Columns z[t - 1] ... z[t - count] for t = begin ... end."""
    return np.column_stack([z[begin - k: len(z) - k] for k in range(1, count + 1)]) if count else np.zeros((len(z) - begin, 0))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


class Moments:
    """Sums of products for all orders up to (p, q) of one series, differenced and centred."""

    def __init__(self, z: np.ndarray, p: int, q: int):
        self.z, self.p, self.q = z, p, q
        self.long = min(LONG, max((len(z) - 1) // 3, 0)) if q else 0
        self.shocks = np.zeros_like(z)
        if self.long:
            x = _lags(z, self.long, self.long)
            self.shocks[self.long:] = z[self.long:] - x @ _solve(x.T @ x, x.T @ z[self.long:])
        self.begin = min(max(p, self.long + q), len(z))
        wide = self._full(self.begin)
        self.xx, self.xy = wide.T @ wide, wide.T @ z[self.begin:]

    def _full(self, begin: int) -> np.ndarray:
        """Lags of values and shocks for t >= begin; what lies before the series counts as zero."""
        pad = lambda v: np.r_[np.zeros(self.p + self.q), v]
        at = begin + self.p + self.q
        return np.column_stack([_lags(pad(self.z), self.p, at), _lags(pad(self.shocks), self.q, at)]) if self.p + self.q else np.zeros((len(self.z) - begin, 0))

    def coefficients(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(ar, ma) of an order within the largest one; None if too few rows have all its lags, or the shocks look back too short a way."""
        begin = max(p, self.long + q) if q else p
        if len(self.z) - begin <= p + q or (q and self.long <= max(p, q)):  # shocks of no more lags than p would be sums of these lags
            return None
        own = [*range(p), *range(self.p, self.p + q)]
        early = self._full(begin)[:max(self.begin - begin, 0)][:, own]
        xx = self.xx[np.ix_(own, own)] + early.T @ early
        xy = self.xy[own] + early.T @ self.z[begin:begin + len(early)]
        c = _solve(xx, xy)
        return c[:p], c[p:]


def innovations(z: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(ar, ma) from the innovations of the sample autocovariances: the moving average weights psi of the series are read off, and both parts solved from them."""
    if len(z) <= p + q:
        raise ValueError("too few points for the order")
    n = min(len(z) - 1, max(p + q, min(len(z) // 4, DEPTH)))  # the weights settle as the recursion goes on
    g = np.array([z[h:] @ z[:len(z) - h] for h in range(n + 1)]) / len(z)
    if g[0] <= 0:
        return np.zeros(p), np.zeros(q)
    theta, v = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
    v[0] = g[0]
    for m in range(1, n + 1):
        for k in range(m):
            done = sum(theta[k, k - j] * theta[m, m - j] * v[j] for j in range(k))
            theta[m, m - k] = (g[m - k] - done) / v[k]
        v[m] = max(g[0] - sum(theta[m, m - j] ** 2 * v[j] for j in range(m)), 1e-12 * g[0])
    psi = np.r_[1.0, theta[n, 1:p + q + 1]]
    at = lambda i: psi[i] if i >= 0 else 0.0
    ar = np.linalg.lstsq(np.array([[at(q + i - k) for k in range(1, p + 1)] for i in range(1, p + 1)]), psi[q + 1:], rcond=None)[0] if p else np.zeros(0)
    ma = np.array([psi[j] - sum(ar[k - 1] * psi[j - k] for k in range(1, min(j, p) + 1)) for j in range(1, q + 1)])
    return ar, ma


def residuals(z: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors of the fitted series, zero before it begins."""
    e = np.zeros(len(z))
    for t in range(len(z)):
        e[t] = z[t] - sum(a * z[t - 1 - i] for i, a in enumerate(ar) if t > i) - sum(m * e[t - 1 - i] for i, m in enumerate(ma) if t > i)
    return e


def _ahead(z, shocks, ar, ma, horizon) -> np.ndarray:
    past, noise, out = list(z[len(z) - max(len(ar), 1):]), list(shocks[len(shocks) - max(len(ma), 1):]), []
    for _ in range(horizon):
        nxt = sum(a * past[-1 - i] for i, a in enumerate(ar) if i < len(past)) + sum(m * noise[-1 - i] for i, m in enumerate(ma) if i < len(noise))
        past.append(nxt)
        noise.append(0.0)
        out.append(nxt)
    return np.asarray(out)


def forecasts(values, orders, horizon: int) -> list[tuple[np.ndarray, str | None]]:
    """(forecast, note) of one series for every order (p, d, q).

    Below 8 points an order is (min(p, 1), 0, min(q, 1)); a fit that fails or leaves the finite numbers repeats the last value.  Both are
    told in the note, which else is None.
    """
    y = np.asarray(values, dtype=float)
    wanted = [(min(p, 1), 0, min(q, 1)) if len(y) < SHORT else (p, d, q) for p, d, q in orders]
    moments: dict[int, tuple] = {}
    for d in {d for _, d, _ in wanted}:
        levels, work = [], y
        for _ in range(min(d, len(y) - 1)):
            levels.append(work[-1])
            work = np.diff(work)
        mean = work.mean() if d == 0 else 0.0
        same = [(p, q) for p, e, q in wanted if e == d]
        # pure autoregressions need no shocks and share their own matrix
        pure, mixed = [p for p, q in same if not q], [x for x in same if x[1]]
        moments[d] = (levels, mean, Moments(work - mean, max(pure), 0) if pure else None,
                      Moments(work - mean, max(p for p, _ in mixed), max(q for _, q in mixed)) if mixed else None)
    out = []
    for (p, d, q), asked in zip(wanted, orders):
        note = REDUCED.format(p, q) if (p, d, q) != tuple(asked) else None
        levels, mean, pure, mixed = moments[d]
        m = mixed if q else pure
        try:
            z = m.z
            if not len(z):
                raise ValueError("no points left after differencing")
            found, shocks = m.coefficients(p, q), m.shocks
            if found is None:
                found = innovations(z, p, q)
                shocks = residuals(z, *found)
            made = _ahead(z, shocks, *found, horizon) + mean
            for last in reversed(levels):
                made = last + np.cumsum(made)
            if not np.isfinite(made).all():
                raise ValueError("forecast is not finite")
        except (np.linalg.LinAlgError, ValueError, IndexError) as e:
            made, note = np.repeat(y[-1], horizon), FALLBACK.format(e)
        out.append((made, note))
    return out


def arima_fits(train: Column, orders: Column, horizon: int) -> Column:
    """STRUCT<pred ARRAY<DOUBLE>, note ARRAY<STRING>> for an array of orders 'p,d,q': the forecasts one behind the other, a note (or null) for each."""
    @F.pandas_udf("pred array<double>, note array<string>")
    def fit(batch: pd.Series, asked: pd.Series) -> pd.DataFrame:
        made = [forecasts(v, [tuple(map(int, o.split(","))) for o in os], horizon) if len(v) and len(os) else [] for v, os in zip(batch, asked)]
        return pd.DataFrame({"pred": [np.concatenate([np.zeros(0), *[p for p, _ in m]]) for m in made], "note": [[n for _, n in m] for m in made]})

    return fit(train, orders)
