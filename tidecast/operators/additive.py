"""Trend and season by least squares, one small system of equations per series.

The normal equations need only sums of products, so the panel is read once with
map-side partial aggregates; a vectorised Python step then solves a p x p
system per series (p is about ten) and never sees the points.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import check_freq, next_period, period_no
from ..spec import KEYS

# Fixed values: (length in periods, harmonics) of the seasons looked for at each frequency, and the 80 % normal quantile.
SEASONS = {"H": ((24, 4), (168, 3)), "D": ((7, 3), (365.25, 3)), "W": ((52.18, 3),), "M": ((12, 3),), "Q": ((4, 1),), "Y": ()}
Z80 = 1.2816
# Hinges and scale of their prior where none are given.
CHANGEPOINTS, PRIOR = 25, 0.05
ROUNDS, TURNS = 500, 30


def design(number: Column, scale: Column, origin: Column, seasons, knots) -> list[Column]:
    """Intercept, scaled trend, hinges at the knots (shares of the history) and Fourier terms."""
    x = (number - origin) / scale
    terms = [F.lit(1.0), x] + [F.greatest(x - k, F.lit(0.0)) for k in knots]
    for length, harmonics in seasons:
        for h in range(1, harmonics + 1):
            angle = number * (2 * math.pi * h / length)
            terms += [F.sin(angle), F.cos(angle)]
    return terms


def waves(number: np.ndarray, seasons) -> np.ndarray:
    """Fourier columns of period numbers."""
    made = [f(number * (2 * math.pi * h / length)) for length, harmonics in seasons for h in range(1, harmonics + 1) for f in (np.sin, np.cos)]
    return np.column_stack(made) if made else np.zeros((len(number), 0))


def hinged(x: np.ndarray, knots) -> np.ndarray:
    return np.column_stack([np.ones_like(x), x, *[np.maximum(x - k, 0.0) for k in knots]])


def shrunk(g: np.ndarray, r: np.ndarray, free: int, weight: float, ridge: np.ndarray) -> np.ndarray:
    """argmin b'Gb / 2 - r'b + sum(ridge b^2) / 2 + weight * sum|b| over all but the first ``free`` coefficients.

    The free ones are solved for and put into the moments of the others, which coordinate descent then shrinks one after the other.
    """
    g = g + np.diag(ridge)
    a, c = g[:free, :free], g[:free, free:]
    back = np.linalg.solve(a, np.column_stack([c, r[:free]]))
    h, q = g[free:, free:] - c.T @ back[:, :-1], r[free:] - c.T @ back[:, -1]
    b, pull = np.zeros(len(q)), -q.astype(float)
    width = np.maximum(np.diag(h), 1e-12)
    for _ in range(ROUNDS):
        most = 0.0
        for j in range(len(b)):
            old = b[j]
            z = width[j] * old - pull[j]
            b[j] = np.sign(z) * max(abs(z) - weight, 0.0) / width[j]
            if b[j] != old:
                pull += h[:, j] * (b[j] - old)
                most = max(most, abs(b[j] - old))
        if most < 1e-10:
            break
    return np.r_[back[:, -1] - back[:, :-1] @ b, b]


def fit_with_prior(number: np.ndarray, y: np.ndarray, ahead: np.ndarray, seasons, knots, mode: str, prior: float) -> tuple[np.ndarray, float]:
    """(prediction at ``ahead``, residual spread) of a trend whose hinges have a Laplace prior of scale ``prior``, plus or times a season.

    Values are taken in units of the largest one and time in units of the history.  The penalty is the residual variance over the prior's
    scale, both found together.  A multiplicative season is a factor 1 + S b of the trend: trend and factor are fitted in turn.
    """
    unit = float(np.abs(y).max()) or 1.0
    y, first, span = y / unit, number[0], max(number[-1] - number[0], 1.0)
    trend, season = hinged((number - first) / span, knots), waves(number, seasons)
    t_ahead, s_ahead = hinged((ahead - first) / span, knots), waves(ahead, seasons)
    loose = np.full(2, 1 / 25), np.full(season.shape[1], 1 / 100)  # normal priors of level, slope (5) and waves (10)
    variance = max(float(np.var(y)), 1e-10)
    b, s = np.zeros(trend.shape[1]), np.zeros(season.shape[1])
    for _ in range(TURNS):
        before = variance
        if mode == "additive":
            x = np.column_stack([trend[:, :2], season, trend[:, 2:]])
            ridge = variance * np.r_[loose[0], loose[1], np.zeros(len(knots))]
            c = shrunk(x.T @ x, x.T @ y, 2 + season.shape[1], variance / prior, ridge)
            b, s = np.r_[c[:2], c[2 + len(s):]], c[2:2 + len(s)]
            fitted, out = trend @ b + season @ s, t_ahead @ b + s_ahead @ s
        else:
            x = trend * (1 + season @ s)[:, None]
            b = shrunk(x.T @ x, x.T @ y, 2, variance / prior, variance * np.r_[loose[0], np.zeros(len(knots))])
            level = trend @ b
            w = season * level[:, None]
            s = np.linalg.solve(w.T @ w + np.diag(variance * loose[1]), w.T @ (y - level)) if len(s) else s
            fitted, out = level * (1 + season @ s), (t_ahead @ b) * (1 + s_ahead @ s)
        variance = max(float(((y - fitted) ** 2).mean()), 1e-10)
        if abs(variance - before) < 1e-6 * before:
            break
    return out * unit, unit * math.sqrt(float(((y - fitted) ** 2).sum()) / max(len(y) - 2 - len(s), 1))


def _with_prior(panel: DataFrame, horizon: int, freq: str, changepoints: int, seasons, mode: str, prior: float, keys) -> DataFrame:
    """One row a series: its points as arrays (bounded by its calendar), fitted in an Arrow batch."""
    known = panel.where(F.col("y").isNotNull()).withColumn("_no", period_no("t", freq).cast("double"))
    rows = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "_no", "y"))).alias("pts"))

    @F.pandas_udf("array<double>")
    def solve(no: pd.Series, y: pd.Series) -> pd.Series:
        def one(n, v):
            n, v = np.asarray(n, float), np.asarray(v, float)
            count = min(changepoints, max(len(v) - 2, 0))
            knots = [0.8 * (i + 1) / (count + 1) for i in range(count)]
            try:
                out, sigma = fit_with_prior(n, v, n[-1] + np.arange(1, horizon + 1), seasons, knots, mode, prior)
            except np.linalg.LinAlgError:
                return np.full(horizon + 1, np.nan)
            return np.r_[out, sigma]
        return pd.Series([one(n, v) for n, v in zip(no, y)])

    fitted = rows.select(*keys, F.element_at("pts", -1)["t"].alias("_last"), solve(F.transform("pts", lambda p: p["_no"]), F.transform("pts", lambda p: p["y"])).alias("_w"))
    ahead = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    predicted, sigma = F.nanvl(F.col("_w")[F.col("step") - 1], F.lit(None)), F.col("_w")[horizon]
    return ahead.select(
        *keys, F.lit("trend_season").alias("model_id"), "step", next_period("_last", freq, F.col("step")).alias("t"),
        predicted.alias("predicted"), (predicted - Z80 * sigma).alias("lower"), (predicted + Z80 * sigma).alias("upper"))


def trend_season(panel: DataFrame, horizon: int, freq: str, changepoints: int = 0, seasons=None, ridge: float = 0.0, mode: str = "additive",
                 prior: float | None = None, keys=KEYS) -> DataFrame:
    """keys, model_id, step, t, predicted, lower, upper (80 % of the residual spread).

    ``changepoints`` hinges are spread over the first 80 % of each history.  A
    season longer than half of a series is still fitted: the smallest solution of
    a singular system is taken, and ``ridge`` shrinks it further.

    With ``prior`` the hinges (25 if no number is given) have a Laplace prior of that scale; ``mode="multiplicative"`` makes the season a factor of the
    trend (prior 0.05 if none is given).  Both are fitted on the arrays of a series instead of sums over its rows.
    """
    seasons = SEASONS[check_freq(freq)] if seasons is None else seasons
    if mode not in ("additive", "multiplicative"):
        raise ValueError("mode is 'additive' or 'multiplicative'")
    if prior is not None or mode == "multiplicative":
        if prior is not None and prior <= 0:
            raise ValueError("prior must be positive")
        if ridge:
            raise ValueError("ridge goes with the plain additive model")
        return _with_prior(panel, horizon, freq, changepoints or CHANGEPOINTS, seasons, mode, PRIOR if prior is None else prior, keys)
    knots = [0.8 * (i + 1) / (changepoints + 1) for i in range(changepoints)]
    known = panel.where(F.col("y").isNotNull()).withColumn("_no", period_no("t", freq).cast("double"))
    edges = known.groupBy(*keys).agg(F.min("_no").alias("_a"), F.max("_no").alias("_z"), F.max("t").alias("_last"), F.avg("y").alias("_mean"))
    # sums of squares of a high level would drown the residuals, so values are taken from their mean
    rows = known.join(edges, list(keys)).withColumn("y", F.col("y") - F.col("_mean"))
    scale = F.greatest(F.col("_z") - F.col("_a"), F.lit(1.0))
    terms = design(F.col("_no"), scale, F.col("_a"), seasons, knots)
    p = len(terms)
    rows = rows.select(*keys, "_a", "_z", "_last", "_mean", "y", *[c.alias(f"_x{i}") for i, c in enumerate(terms)])
    x = [F.col(f"_x{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(*keys).agg(
        *[F.sum(x[i] * x[j]).alias(f"_s{n}") for n, (i, j) in enumerate(pairs)],
        *[F.sum(x[i] * F.col("y")).alias(f"_r{i}") for i in range(p)],
        F.sum(F.col("y") * F.col("y")).alias("_yy"), F.count("*").alias("_n"),
        F.first("_a").alias("_a"), F.first("_z").alias("_z"), F.first("_last").alias("_last"), F.first("_mean").alias("_mean"))

    @F.pandas_udf("array<double>")
    def solve(sxx: pd.Series, sxy: pd.Series) -> pd.Series:
        def one(a, b):
            m = np.zeros((p, p))
            for v, (i, j) in zip(a, pairs):
                m[i, j] = m[j, i] = v
            m[np.diag_indices(p)] += ridge * max(m[0, 0], 1.0)
            return np.linalg.lstsq(m, np.asarray(b, dtype=float), rcond=None)[0]
        return pd.Series([one(a, b) for a, b in zip(sxx, sxy)])

    fitted = sums.select(
        *keys, "_a", "_z", "_last", "_n", "_yy", "_mean",
        F.array(*[F.col(f"_r{i}") for i in range(p)]).alias("_xy"),
        solve(F.array(*[F.col(f"_s{n}") for n in range(len(pairs))]), F.array(*[F.col(f"_r{i}") for i in range(p)])).alias("_b"))
    explained = F.aggregate(F.zip_with("_b", "_xy", lambda b, r: b * r), F.lit(0.0), lambda s, v: s + v)
    left = F.greatest(F.col("_yy") - explained, F.lit(0.0))
    free = F.greatest(F.col("_n") - p, F.lit(1))
    fitted = fitted.withColumn("_sigma", F.sqrt(left / free))
    ahead = fitted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    future = design(F.col("_z") + F.col("step"), scale, F.col("_a"), seasons, knots)
    predicted = sum((F.col("_b")[i] * c for i, c in enumerate(future[1:], start=1)), F.col("_b")[0] + F.col("_mean"))
    return ahead.select(
        *keys, F.lit("trend_season").alias("model_id"), "step", next_period("_last", freq, F.col("step")).alias("t"),
        predicted.alias("predicted"), (predicted - Z80 * F.col("_sigma")).alias("lower"), (predicted + Z80 * F.col("_sigma")).alias("upper"))
