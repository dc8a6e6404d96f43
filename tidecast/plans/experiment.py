"""A whole experiment over any number of series: build, check, back-test, tune, forecast."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.additive import trend_season
from ..operators.covariates import future_covariates, to_long
from ..operators.custom import REGISTERED, run_forecaster
from ..operators.diagnostics import data_health
from ..operators.features import feature_matrix
from ..operators.forecasters import ARRAY_MODELS, future_axis, residual_interval
from ..operators.holidays import FEATURES as HOLIDAYS
from ..operators.holidays import holiday_features
from ..operators.rows import detect_frequency
from ..operators._common import backward
from ..operators.scoring import error_metrics, holdout_split, pair_predictions, part_windows, split_eligible
from ..operators.trees import fitted_residuals, lag_boosting, lag_forest, recursive_predict
from ..session import stage
from ..spec import KEYS, CleaningConfig, CovariateRole, FeatureConfig, PanelSpec
from .backtest import (LISTED, PROFILE_LIMITS, SEARCHED, Model, backtest, backtest_points, base_text, evaluate_candidates, final_by_series, leaderboard_of, model_grid,
                       parameters_of, select_candidate, tuning_split)
from .build import BuiltPanel, build_panel

TUNABLE = ("moving_average", "seasonal_naive", "exp_smoothing", "arima")


@dataclass(frozen=True)
class Experiment:
    """Lazy result tables; ``tables()`` is what the run store saves."""

    built: BuiltPanel
    health: DataFrame
    skipped: DataFrame
    windows: DataFrame
    leaderboard: DataFrame
    points: DataFrame
    forecast: DataFrame
    trials: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        out = {"series_points": self.built.panel, "diagnostics": self.built.diagnostics, "health": self.health, "skipped": self.skipped,
               "windows": self.windows, "leaderboard": self.leaderboard, "backtest": self.points, "forecast": self.forecast}
        return out | ({"trials": self.trials} if self.trials is not None else {})


def melt_targets(df: DataFrame, targets: Iterable[str], keys: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """One row per target column: ``series_id`` (keys and target name joined by '|'), ``value`` and the kept columns."""
    targets, keys = list(targets), list(keys)
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in targets])
    rows = df.select(*keys, *keep, F.explode(items).alias("_t"))
    return rows.select(F.concat_ws("|", *keys, "_t.name").alias("series_id"), *keep, F.col("_t.value").alias("value"))


def check_frequency(df: DataFrame, spec: PanelSpec, cfg: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Detected frequency of each series of a raw table against the one of the spec (``too_fine`` must be false)."""
    from ..operators.rows import annotate_rows, drop_invalid_time
    rows = drop_invalid_time(annotate_rows(df, spec, cfg))
    return detect_frequency(rows, replace(spec, time="t", target="y"), spec.freq)


TREES = {"lag_forest": lag_forest, "lag_boosting": lag_boosting}


def _wide(ahead: DataFrame, names, keys) -> DataFrame:
    """Covariates of the steps ahead, one column each."""
    return ahead.groupBy(*keys, "step").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in names])


class _Matrix:
    """The feature matrix of a history, staged once however many models and candidates are fitted on it."""

    def __init__(self, history: DataFrame, features: FeatureConfig, keys):
        self.history, self.features, self.keys, self.made = history, features, keys, None

    def get(self):
        if self.made is None:
            matrix, names = feature_matrix(self.history, self.features, self.keys)
            self.made = stage(matrix), names
        return self.made


def _fitted(m: str, params: dict, history: DataFrame, matrix: _Matrix, wanted: DataFrame | None, horizon: int, freq: str, ahead: DataFrame | None) -> DataFrame:
    """keys, model_id, step, t, predicted, lower, upper, error of one model for the series of ``wanted`` (keys; None: all).

    Trees are fitted here on all series (Spark jobs); their band is that of their in-sample residuals.
    """
    keys = list(matrix.keys)
    cols = [*keys, "model_id", "step", "t", "predicted", "lower", "upper"]
    own = history if wanted is None else history.join(wanted, keys, "left_semi")
    if m == "trend_season":
        out = trend_season(own.select(*keys, "t", "y"), horizon, freq, keys=keys, **params)
    elif m in TREES:
        rows, names = matrix.get()
        model = TREES[m](rows, names, matrix.features, **params)
        out = residual_interval(fitted_residuals(model, rows, keys), recursive_predict(model, own, horizon, freq, ahead, keys), keys)
    else:
        out = run_forecaster(m, own, horizon, keys).join(future_axis(own, horizon, freq, keys), [*keys, "step"], "left")
        return out.select(*cols, "error")
    return out.select(*cols, F.lit(None).cast("string").alias("error"))


def _reason(e: Exception) -> str:
    return (str(e).strip().splitlines() or [type(e).__name__])[0][:300]


def _failed(wanted: DataFrame, m: str, keys, e: Exception) -> DataFrame:
    """What a model says that could not be fitted at all: a row per series."""
    empty = {c: F.lit(None).cast(k) for c, k in (("step", "int"), ("t", "timestamp_ntz"), ("predicted", "double"), ("lower", "double"), ("upper", "double"))}
    return wanted.select(*keys, F.lit(m).alias("model_id"), *[v.alias(c) for c, v in empty.items()], F.lit(_reason(e)).alias("error"))


def _beyond_arrays(named, history: DataFrame, horizon: int, freq: str, keys, ahead: DataFrame | None, features: FeatureConfig, tuned: DataFrame | None = None) -> DataFrame:
    """Predictions of the models that need more than the array of a series: additive, tree and user models (see ``_fitted``).

    With ``tuned`` (keys, model_id, param) every candidate that some series chose is fitted, and predicts those series.  A model that
    fails has rows with its error instead, and does not stop the others.
    """
    matrix, parts = _Matrix(history, features, keys), []
    every = history.select(*keys).distinct()
    for m, params in named:
        own = None if tuned is None or m not in LISTED else tuned.where(F.col("model_id") == m)
        texts = [] if own is None else [r["param"] for r in own.select("param").distinct().orderBy("param").collect()]  # no more than the list of candidates
        jobs = [(params | parameters_of(m, x), own.where(F.col("param") == x).select(*keys)) for x in texts]
        if own is None:
            jobs.append((params, None))
        elif (rest := every.join(own, list(keys), "left_anti")).head(1):
            jobs.append((params, rest))
        for p, wanted in jobs:
            try:
                parts.append(_fitted(m, p, history, matrix, wanted, horizon, freq, ahead))
            except Exception as e:  # noqa: BLE001  whatever a learner throws is that model's failure
                parts.append(_failed(every if wanted is None else wanted, m, keys, e))
    return reduce(lambda a, b: a.unionByName(b), parts)


def search_fitted(history: DataFrame, models: Iterable[Model], test_size: int, freq: str, features: FeatureConfig = FeatureConfig(), limit: int | None = None,
                  ahead_of=None, keys=KEYS) -> DataFrame:
    """``evaluate_candidates`` for additive and tree models: keys, model_id, round, param, mae, mse, rmse, wape, status, error.

    ``history`` has keys, t, y and the covariates of ``features``.  The last points of each series are held back as in every search; the rest is one
    staged feature matrix on which each candidate is fitted once for all series.  ``ahead_of(train, axis)`` gives the inputs known for
    the steps held back.  A candidate that cannot be fitted is a failed row with its error.
    """
    keys = list(keys)
    full = history.where(F.col("y").isNotNull())
    splits = stage(tuning_split(full, test_size, keys).where(F.col("reason").isNull()).withColumn("freq", F.lit(freq)))
    back = F.row_number().over(backward(keys))
    rows = stage(full.join(splits.select(*keys, "validation"), keys).withColumn("_back", back))
    train, held = rows.where("_back > validation").drop("_back", "validation"), rows.where("_back <= validation").withColumn("step", F.col("validation") - F.col("_back") + 1)
    horizon = max(test_size, 4)
    ahead = ahead_of(train, held.select(*keys, "step", "t")) if ahead_of else None
    matrix, wanted, parts = _Matrix(train, features, keys), splits.select(*keys), []
    for m, params in [(x, {}) if isinstance(x, str) else x for x in models]:
        tried = list(dict.fromkeys([base_text(m, params), *LISTED[m]]))[:limit]
        for i, text in enumerate(tried, 1):
            try:
                made = _fitted(m, params | parameters_of(m, text), train, matrix, wanted, horizon, freq, ahead)
            except Exception as e:  # noqa: BLE001
                made = _failed(wanted, m, keys, e)
            told = made.groupBy(*keys).agg(F.max("error").alias("error"))
            scored = error_metrics(successful_steps(pair_predictions(held, made.where("error is null"), keys), held, keys), keys=keys)
            parts.append(stage(wanted.join(scored, keys, "left").join(told, keys, "left").withColumns({"model_id": F.lit(m), "round": F.lit(i), "param": F.lit(text)})))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select(*keys, "model_id", "round", "param", "mae", "mse", "rmse", "wape", F.when(F.col("mae").isNull(), "failed").otherwise("success").alias("status"), "error")


def successful_steps(points: DataFrame, held: DataFrame, keys) -> DataFrame:
    """Points of the series that have a finite prediction at every step held back."""
    p = F.col("predicted")
    good = points.groupBy(*keys).agg(F.count_if(p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))).alias("_g"))
    whole = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(good, list(keys)).where("_g = _n").select(*keys)
    return points.join(whole, list(keys), "left_semi")


def _detected(df: DataFrame, spec: PanelSpec, cfg: CleaningConfig) -> PanelSpec:
    """The spec with the one frequency that all series show."""
    found = [r["freq"] for r in check_frequency(df, replace(spec, freq="H"), cfg).select("freq").distinct().collect()]
    known = sorted(f for f in found if f)
    if len(known) != 1:
        raise ValueError(f"no common frequency: {known or 'none'}; name one")
    return replace(spec, freq=known[0])


def run_experiment(df: DataFrame, spec: PanelSpec, models: Iterable[Model], horizon: int, test_size: int,
                   cfg: CleaningConfig = CleaningConfig(), how: str | None = None, tune: str | None = None, roles: Iterable[CovariateRole] = (),
                   calendar: DataFrame | None = None, features: FeatureConfig = FeatureConfig(), known_ahead: DataFrame | None = None) -> Experiment:
    """Back-test, rank and forecast every series with every model.

    ``models``: array models, ``trend_season``, ``lag_forest``, ``lag_boosting`` and registered user forecasters, each by name or
    with parameters.  ``spec.freq`` may be ``auto``.  ``tune`` is None, a search profile (fast, balanced, accurate: the first
    candidates) or ``all``; every series is then scored and forecast with its own best parameters, of every model but naive and user ones.  A model that
    fails, for all series or for some, is a failed row with its error; what a model changed to fit at all is in ``warnings``.  ``roles`` name the covariates
    that trees use, text or numbers; ``calendar`` adds the holiday columns to them; ``known_ahead`` (keys, step, name,
    value) are inputs known beyond the history.  The forecast is that of the best model of each series; where a model
    has no band of its own, it is 1.96 deviations of its back-test residuals.

    The finished panel is staged once (one job), so the tables that follow read
    it instead of the raw rows; it holds a row per series and period.
    """
    if horizon < 1 or test_size < 1:
        raise ValueError("horizon and test_size must be at least 1")
    if tune not in (None, "all", *PROFILE_LIMITS):
        raise ValueError(f"unknown search profile {tune!r}")
    keys, roles = list(spec.keys), list(roles)
    named = [(m, {}) if isinstance(m, str) else (m[0], dict(m[1])) for m in models]
    unknown = [m for m, _ in named if m not in ARRAY_MODELS and m not in TREES and m != "trend_season" and m not in REGISTERED]
    if unknown or not named:
        raise ValueError(f"unknown models: {', '.join(unknown)}" if unknown else "select at least one model")
    arrays = [(m, p) for m, p in named if m in ARRAY_MODELS]
    others = [(m, p) for m, p in named if m not in ARRAY_MODELS]
    if spec.freq == "auto":
        spec = _detected(df, spec, cfg)
    freq = spec.freq
    built = build_panel(df, spec, cfg, how, covariates=tuple(r.name for r in roles), staged=True)
    full, extra = built.panel, [r.name for r in roles]
    if calendar is not None:
        full, extra = holiday_features(full, calendar, freq), [*extra, *HOLIDAYS]
        roles += [CovariateRole(c, "known_future") for c in HOLIDAYS]
    features = replace(features, covariates=tuple(extra))
    panel = full.select(*keys, "t", "y")
    _, listed = split_eligible(panel, test_size, keys)
    split = holdout_split(full.select(*keys, "t", "y", *extra), test_size, keys)
    train, test = split.where(~F.col("is_test")).drop("is_test", "step"), split.where("is_test").drop("is_test")

    def ahead(history, axis, purpose, observed):
        if not extra:
            return None
        held = None if calendar is None else holiday_features(axis.select(*keys, "t").distinct(), calendar, freq)
        return _wide(future_covariates(to_long(history, extra, keys), axis, roles, purpose, observed, held, keys), extra, keys)

    trials = tuned = None
    if tune is not None:
        names = [m for m, _ in arrays if m in TUNABLE]
        base = {m: p[SEARCHED[m]] for m, p in arrays if m in TUNABLE and SEARCHED[m] in p} | {m: base_text(m, p) for m, p in arrays if m == "arima"}
        limit, found = PROFILE_LIMITS.get(tune), []
        if names:
            found.append(evaluate_candidates(train.select(*keys, "t", "y"), names, test_size, freq, limit, base, keys).withColumn("error", F.lit(None).cast("string")))
        if any(m in LISTED for m, _ in others):
            told = lambda h, axis: ahead(h, axis, "backtest", to_long(train, extra, keys).join(axis, [*keys, "t"]) if extra else None)
            found.append(search_fitted(train, [(m, p) for m, p in others if m in LISTED], test_size, freq, features, limit, told, keys))
        if found:
            trials = select_candidate(stage(reduce(lambda a, b: a.unionByName(b), found)), keys)
            tuned = stage(trials.where("selected").select(*keys, "model_id", "param"))

    if others:
        seen = to_long(test, extra, keys).join(test.select(*keys, "t", "step"), [*keys, "t"]) if extra else None
        eligible = train.join(listed.where(F.col("reason").isNull()).select(*keys), keys, "left_semi")
        guessed = stage(_beyond_arrays(others, eligible, test_size, freq, keys, ahead(train, test.select(*keys, "step", "t"), "backtest", seen), features, tuned))
        said = guessed.where("error is not null").groupBy(*keys, "model_id").agg(F.min("error").alias("error")).withColumn("note", F.lit(None).cast("string"))
        points = pair_predictions(test, guessed.where("error is null"), keys)
        if arrays:
            raw = stage(backtest_points(panel, arrays, test_size, freq, keys, tuned))
            said = said.unionByName(raw.where("note is not null").groupBy(*keys, "model_id").agg(F.lit(None).cast("string").alias("error"), F.min("note").alias("note")))
            points = points.unionByName(raw.where("ok").select(*points.columns))
        points = stage(points)
        expected = model_grid(listed.where(F.col("reason").isNull()).select(*keys), [m for m, _ in named])
        board = leaderboard_of(points, expected, test_size, keys, said)
    else:
        board, points = backtest(panel, arrays, test_size, freq, keys, tuned)
    if tuned is not None:
        board = board.join(tuned, [*keys, "model_id"], "left")

    cols = [*keys, "model_id", "step", "t", "predicted", "lower", "upper"]
    parts = []
    if arrays:
        ours = board.where(F.col("model_id").isin([m for m, _ in arrays]))
        parts.append(residual_interval(points, final_by_series(panel, ours, arrays, horizon, freq, keys, tuned), keys).select(*cols))
    if others:
        best = board.where(F.col("rank") == 1).select(*keys, "model_id")
        final = _beyond_arrays(others, full, horizon, freq, keys, ahead(full, future_axis(panel, horizon, freq, keys), "forecast", known_ahead), features, tuned)
        parts.append(final.where("error is null").join(best, [*keys, "model_id"], "left_semi").select(*cols))
    forecast = reduce(lambda a, b: a.unionByName(b), parts)
    return Experiment(
        built, data_health(built.diagnostics, horizon, test_size, keys), listed.where(F.col("reason").isNotNull()), part_windows(split, keys),
        board, points, forecast, trials)
