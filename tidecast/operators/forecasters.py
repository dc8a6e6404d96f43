"""Forecasters.

The univariate methods are array expressions: they take the training values of
one series as ``ARRAY<DOUBLE>`` and give ``ARRAY<DOUBLE>`` of the horizon.  A
back-test or a parameter search then needs one row per series and no join
between history, candidates and predictions.  Training arrays of the baselines
hold only the last few points; the smoothing and ARIMA methods read the whole
series, whose length the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import SEASON, check_freq, next_period
from ..spec import KEYS
from ._common import backward
from .arima import arima_fits

# Parameter grid of the smoothing method and the 95 % normal quantile.
ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.05, 0.1, 0.3, 0.5)
Z95 = 1.96


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- array forecasters --------------------------------------------------------

def naive_values(train: Column, horizon: int, **_) -> Column:
    return F.array_repeat(F.element_at(train, -1), horizon)


def seasonal_values(train: Column, horizon: int, period=None, freq: str = "D", **_) -> Column:
    """Repeat the last season; a history shorter than the season repeats its last value."""
    asked = _lit(SEASON[check_freq(freq)]) if period is None else F.when(_lit(period) > 0, _lit(period)).otherwise(SEASON[freq])
    n = F.size(train)
    p = F.when(n < asked, 1).otherwise(asked).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: F.element_at(train, (n - p + k % p + 1).cast("int")))


def average_values(train: Column, horizon: int, window=7, **_) -> Column:
    w = F.least(_lit(window).cast("int"), F.size(train))
    tail = F.slice(train, F.size(train) - w + 1, w)
    mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / w
    return F.array_repeat(mean, horizon)


def smoothing_fit(train: Column, trend="auto", alphas=ALPHAS, betas=BETAS) -> Column:
    """STRUCT<sse, alpha, beta, level, slope> with the smallest one-step squared error.

    Level and slope start from the first two points; every grid point is folded
    over the array inside the row.  ``trend`` may be 'auto', 'add', 'none' or a column.
    """
    mode = _lit(trend)
    with_trend = (mode == "add") | ((mode == "auto") & (F.size(train) >= 10))
    first = F.element_at(train, 1)
    slope0 = F.when(F.size(train) > 1, F.try_element_at(train, F.lit(2)) - first).otherwise(0.0)

    def best(grid) -> Column:
        def fold(c):
            start = F.struct(F.lit(0.0).alias("sse"), c["alpha"].alias("alpha"), c["beta"].alias("beta"), first.alias("level"),
                             F.when(c["beta"] > 0, slope0).otherwise(0.0).alias("slope"))

            def step(s, x):
                err = x - (s["level"] + s["slope"])
                return F.struct((s["sse"] + err * err).alias("sse"), s["alpha"].alias("alpha"), s["beta"].alias("beta"),
                                (s["level"] + s["slope"] + s["alpha"] * err).alias("level"),
                                (s["slope"] + (s["alpha"] * s["beta"]) * err).alias("slope"))

            return F.aggregate(F.slice(train, 2, F.greatest(F.size(train) - 1, F.lit(0))), start, step)

        points = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in grid])
        return F.array_min(F.transform(points, fold))

    return F.when(with_trend, best([(a, b) for a in alphas for b in betas])).otherwise(best([(a, 0.0) for a in alphas]))


def smoothing_values(train: Column, horizon: int, trend="auto", alphas=ALPHAS, betas=BETAS, **_) -> Column:
    fit = smoothing_fit(train, trend, alphas, betas)
    steps = F.sequence(F.lit(1), F.lit(horizon))
    # the fit is put in a one-element array so that it is evaluated once, not once per step
    return F.flatten(F.transform(F.array(fit), lambda f: F.transform(steps, lambda k: f["level"] + f["slope"] * k)))


def array_std(train: Column) -> Column:
    """Sample standard deviation of an array; null below two values."""
    n = F.size(train)
    mean = F.aggregate(train, F.lit(0.0), lambda s, x: s + x) / F.when(n > 0, n)
    ss = F.aggregate(train, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(ss / F.when(n > 1, n - 1)))


def arima_values(train: Column, horizon: int, p=1, d=1, q=1, **_) -> Column:
    """ARIMA(p,d,q), numbers or columns (see ``arima``); a series that cannot be fitted repeats its last value."""
    return arima_noted(train, horizon, p, d, q)["pred"]


def arima_noted(train: Column, horizon: int, p=1, d=1, q=1, **_) -> Column:
    """STRUCT<pred, note>: the forecast, and what was changed to get it, if anything."""
    fit = arima_fits(train, F.array(F.concat_ws(",", *[_lit(x).cast("string") for x in (p, d, q)])), horizon)
    return F.struct(fit["pred"].alias("pred"), fit["note"][0].alias("note"))


ARRAY_MODELS = {
    "naive": naive_values,
    "seasonal_naive": seasonal_values,
    "moving_average": average_values,
    "exp_smoothing": smoothing_values,
    "arima": arima_values,
}
#: Models that tell what they changed: STRUCT<pred, note>.
NOTED = {"arima": arima_noted}
WHOLE_HISTORY = ("exp_smoothing", "arima")


def points_needed(model: str, freq: str, params: dict) -> int | None:
    """How many trailing training points the model reads; None for all."""
    if model == "naive":
        return 1
    if model == "moving_average":
        return int(params.get("window", 7))
    if model == "seasonal_naive":
        return int(params.get("period") or SEASON[check_freq(freq)])
    return None


# -- one row per series -------------------------------------------------------

def series_tail(panel: DataFrame, points: int | None, keys=KEYS) -> DataFrame:
    """One row per series: ``pts`` ARRAY<STRUCT<t, y>> of the last points in order.

    With a limit, Spark keeps only that many rows per series on the map side
    (WindowGroupLimit) before the exchange.
    """
    rows = panel.where(F.col("y").isNotNull())
    if points is not None:
        rows = rows.withColumn("_r", F.row_number().over(backward(keys))).where(F.col("_r") <= points)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("pts"))


def _steps(rows: DataFrame, freq: str, keys) -> DataFrame:
    """Explode ``_pred`` into step, t, predicted; drops nothing."""
    out = rows.select(*keys, F.element_at("pts", -1)["t"].alias("_last"), *[c for c in rows.columns if c not in (*keys, "pts", "_pred")],
                      F.posexplode("_pred").alias("_pos", "predicted"))
    return (out.withColumn("step", F.col("_pos") + 1)
            .withColumn("t", next_period("_last", freq, F.col("step"))).drop("_pos", "_last"))


def forecast(panel: DataFrame, model: str, horizon: int, freq: str, keys=KEYS, **params) -> DataFrame:
    """keys, model_id, step, t, predicted for one array model over the whole panel."""
    if model not in ARRAY_MODELS:
        raise ValueError(f"unknown model {model!r}")
    rows = series_tail(panel, points_needed(model, freq, params), keys)
    train = F.transform("pts", lambda p: p["y"])
    pred = ARRAY_MODELS[model](train, horizon, **({"freq": freq} | params))
    return (_steps(rows.withColumn("_pred", pred), freq, keys).withColumn("model_id", F.lit(model))
            .select(*keys, "model_id", "step", "t", "predicted"))


def naive(panel, horizon, freq="D", keys=KEYS):
    return forecast(panel, "naive", horizon, freq, keys)


def seasonal_naive(panel, horizon, freq="D", period=None, keys=KEYS):
    return forecast(panel, "seasonal_naive", horizon, freq, keys, period=period)


def moving_average(panel, horizon, freq="D", window=7, keys=KEYS):
    return forecast(panel, "moving_average", horizon, freq, keys, window=window)


def arima(panel, horizon, freq="D", p=1, d=1, q=1, keys=KEYS):
    return forecast(panel, "arima", horizon, freq, keys, p=p, d=d, q=q)


def exp_smoothing(panel: DataFrame, horizon: int, freq: str = "D", trend: str = "auto", band: str = "residual",
                  alphas=ALPHAS, betas=BETAS, keys=KEYS) -> DataFrame:
    """Forecast with a 95 % band from the one-step residuals, or from the spread of y (``band='level'``)."""
    rows = series_tail(panel, None, keys)
    train = F.transform("pts", lambda p: p["y"])
    rows = rows.withColumn("_fit", smoothing_fit(train, trend, alphas, betas))
    n = F.size(train)
    if band == "level":
        sigma = array_std(train)
    elif band == "residual":
        sigma = F.when(n > 2, F.sqrt(F.col("_fit.sse") / F.when(n > 2, n - 1)))
    else:
        raise ValueError("band is 'residual' or 'level'")
    fit = F.col("_fit")
    rows = rows.select(*keys, "pts", sigma.alias("_sigma"),
                       F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: fit["level"] + fit["slope"] * k).alias("_pred"))
    out = _steps(rows, freq, keys)
    return out.select(*keys, F.lit("exp_smoothing").alias("model_id"), "step", "t", "predicted",
                      (F.col("predicted") - Z95 * F.col("_sigma")).alias("lower"),
                      (F.col("predicted") + Z95 * F.col("_sigma")).alias("upper"))


def future_axis(panel: DataFrame, horizon: int, freq: str, keys=KEYS) -> DataFrame:
    last = panel.groupBy(*keys).agg(F.max("t").alias("_last"))
    return (last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .select(*keys, "step", next_period("_last", freq, F.col("step")).alias("t")))


def residual_interval(fitted: DataFrame, predictions: DataFrame, keys=KEYS) -> DataFrame:
    """Add lower/upper: 1.96 sample deviations of the in-sample residuals per series and model; null if 0."""
    by = [*keys, "model_id"]
    spread = fitted.groupBy(*by).agg(F.stddev_samp("residual").alias("_s"))
    s = F.when(F.col("_s") > 0, F.col("_s") * Z95)
    return (predictions.join(spread, by, "left")
            .withColumn("lower", F.col("predicted") - s).withColumn("upper", F.col("predicted") + s).drop("_s"))
