"""Holdout back-test, final forecast and parameter search over a panel.

After the panel is bucketed there is one shuffle, by series: the trailing
points are cut off on the map side, gathered into one row per series, and
every model of every series is predicted, paired, scored and ranked from that
row.  The groupings and the ranking window that follow are on the same key and
need no further exchange.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import SEASON, check_freq
from ..operators._common import START, forward, whole
from ..operators.arima import arima_fits
from ..operators.forecasters import ARRAY_MODELS, NOTED, exp_smoothing, forecast, points_needed, series_tail
from ..operators.scoring import error_metrics, rank_models, with_residuals
from ..spec import KEYS

Model = str | tuple[str, dict]

# How many candidates a search profile tries.
PROFILE_LIMITS = {"fast": 4, "balanced": 7, "accurate": 10}


def _named(models: Iterable[Model]) -> list[tuple[str, dict]]:
    out = [(m, {}) if isinstance(m, str) else (m[0], dict(m[1])) for m in models]
    unknown = [m for m, _ in out if m not in ARRAY_MODELS]
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    if not out:
        raise ValueError("select at least one model")
    return out


def _finite_all(values: Column, size: int) -> Column:
    ok = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(values) == size) & ok, F.lit(False))


# which parameter of a model a search tries
SEARCHED = {"moving_average": "window", "seasonal_naive": "period", "exp_smoothing": "trend", "arima": "order"}


def _reach(named, freq: str, tuned) -> int | None:
    """How many trailing points the models read; with tuned parameters as many as the longest candidate."""
    need = [points_needed(m, freq, p) for m, p in named]
    if tuned is not None and None not in need:
        need += [max(WINDOWS), *(2 * x for x in PERIODS[freq]), 2 * SEASON[freq]]
    return None if None in need else max(need)


def _with_tuned(rows: DataFrame, tuned: DataFrame | None, keys) -> DataFrame:
    """Every series' own parameters beside it: one text column per searched model."""
    if tuned is None:
        return rows
    wide = tuned.groupBy(*keys).agg(*[F.max(F.when(F.col("model_id") == m, F.col("param"))).alias(f"_tuned_{m}") for m in SEARCHED])
    return rows.join(wide, list(keys), "left")


def _predict(m: str, train: Column, steps: int, freq: str, params: dict, tuned, noted: bool = False) -> Column:
    """Predictions of an array model, with the series' tuned parameter where there is one; ``noted``: STRUCT<pred, note>."""
    params = {"freq": freq} | params
    if tuned is not None and m in SEARCHED:
        own, name = F.col(f"_tuned_{m}"), SEARCHED[m]
        if m == "arima":
            order = F.split(F.coalesce(own, F.lit(base_text(m, params))), ",")
            params |= {x: order[i] for i, x in enumerate("pdq")}
        elif m == "exp_smoothing":
            params[name] = F.coalesce(own, F.lit(params.get(name, BASE[m])))
        else:
            params[name] = F.coalesce(own.try_cast("int"), F.lit(int(params.get(name) or BASE[m] or SEASON[freq])))
    if noted:
        return NOTED[m](train, steps, **params) if m in NOTED else F.struct(ARRAY_MODELS[m](train, steps, **params).alias("pred"), F.lit(None).cast("string").alias("note"))
    return ARRAY_MODELS[m](train, steps, **params)


def base_text(model: str, params: dict) -> str:
    """A model's own parameters as the text of a candidate; what is not given is the model's default."""
    names, values = DEFAULTS[model]
    return ",".join(str(params.get(n, v)) for n, v in zip(names, values))


def _model_rows(panel: DataFrame, models, test_size: int, freq: str, keys, tuned: DataFrame | None = None) -> DataFrame:
    """One row per series and model: test points and predictions as arrays."""
    named = _named(models)
    need = _reach(named, freq, tuned)
    limit = None if need is None else need + test_size
    rows = _with_tuned(series_tail(panel, limit, keys).where(F.size("pts") > test_size), tuned, keys)
    cut = F.size("pts") - test_size
    rows = rows.select(
        *keys, *[c for c in rows.columns if c.startswith("_tuned_")], F.transform(F.slice("pts", 1, cut), lambda p: p["y"]).alias("train"),
        F.slice("pts", cut + 1, test_size).alias("test"))
    # every prediction is a column of its own first, so a Python-backed model is evaluated once
    preds = rows.withColumns({f"_p{i}": _predict(m, F.col("train"), test_size, freq, p, tuned, noted=True) for i, (m, p) in enumerate(named)})
    per_model = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(i).alias("selection"),
                                   F.col(f"_p{i}.pred").alias("pred"), F.col(f"_p{i}.note").alias("note")) for i, (m, _) in enumerate(named)])
    return preds.select(*keys, "test", F.explode(per_model).alias("m")).select(*keys, "test", "m.*")


def backtest_points(panel: DataFrame, models: Iterable[Model], test_size: int, freq: str, keys=KEYS, tuned: DataFrame | None = None) -> DataFrame:
    """keys, model_id, selection, step, t, actual, predicted, residual, abs_error, sq_error, ok, note.

    ``tuned`` (keys, model_id, param) gives series parameters of their own.

    A model without ``test_size`` finite predictions keeps one row with nulls
    and ``ok`` false, so the leaderboard can report the failure.
    """
    rows = _model_rows(panel, models, test_size, freq, keys, tuned)
    ok = _finite_all(F.col("pred"), test_size)
    zipped = F.when(ok, F.arrays_zip(F.col("test"), F.col("pred")))
    flat = rows.select(*keys, "model_id", "selection", ok.alias("ok"), "note", F.posexplode_outer(zipped).alias("_pos", "z"))
    points = flat.select(
        *keys, "model_id", "selection", "ok", "note", (F.col("_pos") + 1).alias("step"),
        F.col("z.test.t").alias("t"), F.col("z.test.y").alias("actual"), F.col("z.pred").alias("predicted"))
    return with_residuals(points)


def leaderboard(points: DataFrame, keys=KEYS) -> DataFrame:
    """Metrics, status and rank per series and model from back-test points."""
    by = [*keys, "model_id", *[c for c in ("selection", "ok", "note") if c in points.columns]]
    return _told(rank_models(error_metrics(points, by), keys=keys), None, "note" if "note" in points.columns else None).drop("note")


def _told(ranked: DataFrame, error: str | None, note: str | None) -> DataFrame:
    """Status, error and warnings of ranked models; ``error`` and ``note`` are columns with what the models themselves said."""
    failed = F.col("mae").isNull()
    usual = F.lit("model gave missing, non-finite or too few predictions")
    return ranked.withColumns({
        "status": F.when(failed, "failed").otherwise("success"),
        "error": F.when(failed, usual if error is None else F.coalesce(error, usual)),
        "warnings": F.array_compact(F.array(
            F.col(note) if note else F.lit(None).cast("string"),
            F.when(~failed & F.col("wape").isNull(), "WAPE is null because the actual values sum to zero"))),
    })


def backtest(panel: DataFrame, models: Iterable[Model], test_size: int, freq: str, keys=KEYS,
             tuned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(leaderboard, points).  Series not longer than ``test_size`` have no rows: see ``split_eligible``."""
    points = backtest_points(panel, models, test_size, freq, keys, tuned)
    good = points.where(F.col("ok")).drop("ok", "selection", "note") if "ok" in points.columns else points
    return leaderboard(points, keys), good


def leaderboard_of(points: DataFrame, expected: DataFrame, test_size: int, keys=KEYS, said: DataFrame | None = None) -> DataFrame:
    """Leaderboard for points from any source; ``expected`` (keys, model_id, selection) lists what should be there.

    ``said`` (keys, model_id, error, note; one row each at most) is what models reported: errors of those without points, notes of those with.
    """
    from ..operators.scoring import successful_only
    metrics = error_metrics(successful_only(points, test_size, keys), keys=keys)
    full = expected.join(metrics, [*keys, "model_id"], "left")
    if said is not None:
        full = full.join(said, [*keys, "model_id"], "left")
    ranked = _told(rank_models(full, keys=keys), "error" if said is not None else None, "note" if said is not None else None)
    return ranked.drop("note")


def final_forecast(panel: DataFrame, model: str, horizon: int, freq: str, keys=KEYS, **params) -> DataFrame:
    """Refit on all history; keys, model_id, step, t, predicted, lower, upper."""
    if model == "exp_smoothing":
        return exp_smoothing(panel, horizon, freq, keys=keys, **params)
    out = forecast(panel, model, horizon, freq, keys, **params)
    empty = F.lit(None).cast("double")
    return out.withColumns({"lower": empty, "upper": empty})


def final_by_series(panel: DataFrame, board: DataFrame, models: Iterable[Model], horizon: int, freq: str, keys=KEYS,
                    tuned: DataFrame | None = None) -> DataFrame:
    """Final forecast of every series by its own rank-1 model, in one pass over the panel."""
    named = _named(models)
    best = board.where(F.col("rank") == 1).select(*keys, F.col("model_id").alias("_best"))
    rows = _with_tuned(series_tail(panel, _reach(named, freq, tuned), keys).join(best, list(keys)), tuned, keys)
    train = F.transform("pts", lambda p: p["y"])
    pred = None
    for m, p in named:
        one = _predict(m, train, horizon, freq, p, tuned)
        pred = F.when(F.col("_best") == m, one) if pred is None else pred.when(F.col("_best") == m, one)
    from ..operators.forecasters import _steps
    out = _steps(rows.withColumn("_pred", pred), freq, keys)
    return out.select(*keys, F.col("_best").alias("model_id"), "step", "t", "predicted")


def model_grid(series: DataFrame, models: Iterable[str]) -> DataFrame:
    """Every series with every model, exploded from a literal list instead of a cross join."""
    names = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(i).alias("selection")) for i, m in enumerate(models)])
    return series.withColumn("_m", F.explode(names)).select(*series.columns, "_m.*")


# -- parameter search ---------------------------------------------------------

# The candidates of each searchable method, in order of trial.
WINDOWS = (3, 5, 7, 14, 21, 28)
TRENDS = ("auto", "add", "none")
PERIODS = {"H": (12, 24, 48, 168), "D": (7, 14, 28), "W": (13, 26, 52), "M": (3, 6, 12, 24), "Q": (2, 4, 8), "Y": (1, 2, 3)}
ORDERS = ("1,1,1", "2,1,1", "2,1,2", "3,1,1", "1,0,1", "1,1,2")
SEASON_MODES = ("additive,0.05", "additive,0.1", "multiplicative,0.05", "multiplicative,0.1", "additive,0.3")  # mode, changepoint prior
FORESTS = ("80,8,1", "120,12,2", "160,18,2", "220,24,2", "260,32,1")  # trees, depth, leaf
BOOSTS = ("80,2,0.08", "120,3,0.05", "200,4,0.05", "300,5,0.03", "400,6,0.03")  # trees, depth, rate
BASE = {"moving_average": 7, "seasonal_naive": 0, "exp_smoothing": "auto"}
# what the fields of a candidate are called and what a model takes for them by itself
DEFAULTS = {"arima": (("p", "d", "q"), (1, 1, 1)), "trend_season": (("mode", "prior"), ("additive", 0.05)),
            "lag_forest": (("trees", "depth", "leaf"), (120, 18, 2)), "lag_boosting": (("trees", "depth", "rate"), (200, 3, 0.05))}
LISTED = {"arima": ORDERS, "trend_season": SEASON_MODES, "lag_forest": FORESTS, "lag_boosting": BOOSTS}


def parameters_of(model: str, text: str) -> dict:
    """A candidate's text as parameters of its model."""
    names, values = DEFAULTS[model]
    return {n: type(v)(x) for n, v, x in zip(names, values, text.split(","), strict=True)}


def candidate_grid(series_meta: DataFrame, model: str, base=None, keys=KEYS) -> DataFrame:
    """keys, n, freq, model_id, raw round, ``param`` (text) of every candidate, the current setting first.

    ``series_meta`` has keys, ``freq`` and ``n`` (training points left for tuning).
    """
    base = BASE.get(model) if base is None else base
    if model == "moving_average":
        values = F.array(*[F.lit(str(w)) for w in (base, *WINDOWS)])
    elif model == "exp_smoothing":
        values = F.array(*[F.lit(t) for t in (base, *TRENDS)])
    elif model == "seasonal_naive":
        season = F.create_map(*[F.lit(x) for pair in SEASON.items() for x in pair])[F.col("freq")]
        usual = F.lit(int(base)) if base else season
        listed = F.create_map(*[x for f, ps in PERIODS.items() for x in (F.lit(f), F.array(*[F.lit(p) for p in ps]))])
        near = F.array(F.lit(int(base or 0)), F.lit(int(base or 0)), usual, F.greatest(F.floor(usual / 2).cast("int"), F.lit(1)),
                       F.greatest(usual - 1, F.lit(1)), usual + 1, usual * 2, F.lit(1))
        values = F.transform(F.concat(near, listed[F.col("freq")]), lambda v: v.cast("string"))
    elif model in LISTED:
        values = F.array(*[F.lit(t) for t in (base if isinstance(base, str) else base_text(model, base or {}), *LISTED[model])])
    else:
        raise ValueError(f"{model!r} has no candidate list")
    return (series_meta.select(*keys, "freq", "n", F.posexplode(values).alias("_raw", "param"))
            .withColumn("model_id", F.lit(model)))


def dedupe_candidates(grid: DataFrame, keys=KEYS) -> DataFrame:
    """Canonical parameters, first occurrence of each kept, renumbered as ``round``."""
    season = F.create_map(*[F.lit(x) for pair in SEASON.items() for x in pair])[F.col("freq")]
    asked = F.col("param").try_cast("int")
    # periods and windows beyond these bounds are refused, not cut
    refused = lambda c, top, what: F.when(c > top, F.raise_error(F.lit(f"{what} above {top}")).cast("int")).otherwise(c)
    period = F.when(asked > 0, asked).otherwise(season)
    period = F.when(F.col("n") < period, 1).otherwise(period)
    canon = (F.when(F.col("model_id") == "seasonal_naive", refused(period, 8760, "season period").cast("string"))
             .when(F.col("model_id") == "moving_average", refused(F.greatest(asked, F.lit(2)), 720, "window").cast("string"))
             .otherwise(F.col("param")))
    by = [*keys, "model_id"]
    rows = grid.withColumn("param", canon).groupBy(*by, "param", "freq", "n").agg(F.min("_raw").alias("_raw"))
    return rows.withColumn("round", F.row_number().over(forward(by, "_raw"))).drop("_raw")


def tuning_split(train: DataFrame, test_size: int, keys=KEYS) -> DataFrame:
    """Validation size per series, with the reason when there are too few points to tune."""
    rows = train.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.count("*").alias("points"))
    size = F.least(F.greatest(F.lit(test_size), F.lit(4)), F.greatest(F.lit(4), F.floor(F.col("points") / 4))).cast("int")
    left = F.col("points") - F.col("validation")
    reason = (F.when(F.col("points") < max(18, 3 * test_size), "too few training points")
              .when(left < 12, "too few points after the split"))
    return rows.withColumn("validation", size).withColumn("n", left.cast("int")).withColumn("reason", reason)


def evaluate_candidates(train: DataFrame, models: Iterable[str], test_size: int, freq: str,
                        limit: int | None = None, base: dict | None = None, keys=KEYS) -> DataFrame:
    """Score every candidate of every series on its validation part, in one job.

    keys, model_id, round, param, mae, mse, rmse, wape, status.  The history
    of a series is one array; candidates are short rows joined to it by key.
    ``limit`` keeps the first rounds of each model; None tries every candidate.
    """
    check_freq(freq)
    keys = list(keys)
    models = list(models)
    splits = tuning_split(train, test_size, keys).where(F.col("reason").isNull()).withColumn("freq", F.lit(freq))
    grids = None
    for m in models:
        g = dedupe_candidates(candidate_grid(splits, m, (base or {}).get(m), keys), keys)
        g = g if limit is None else g.where(F.col("round") <= limit)
        grids = g if grids is None else grids.unionByName(g)
    tried = grids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("model_id", "round", "param"))).alias("cands"))
    longest = max(max(WINDOWS), *(2 * p for p in PERIODS[freq]), 2 * SEASON[freq], int((base or {}).get("seasonal_naive") or 0) * 2,
                  int((base or {}).get("moving_average") or 0))
    need = None if {"exp_smoothing", "arima"} & set(models) else longest + max(test_size, 4)
    hist = series_tail(train, need, keys).join(splits.select(*keys, "validation"), keys).join(tried, keys)
    cut = F.size("pts") - F.col("validation")
    hist = hist.select(*keys, "cands", "validation",
                       F.transform(F.slice("pts", 1, cut), lambda p: p["y"]).alias("train"),
                       F.transform(F.slice("pts", cut + 1, F.col("validation")), lambda p: p["y"]).alias("actual"))
    horizon = max(test_size, 4)
    if "arima" in models:  # all orders of a series in one call, before candidates become rows
        hist = hist.withColumn("_orders", F.transform(F.filter("cands", lambda c: c["model_id"] == "arima"), lambda c: c["param"]))
        hist = hist.withColumn("_fits", arima_fits(F.col("train"), F.col("_orders"), horizon)["pred"])
    rows = hist.withColumn("c", F.explode("cands")).drop("cands").select("*", "c.*").drop("c")
    number = F.col("param").try_cast("int")
    calls = {
        "moving_average": lambda: ARRAY_MODELS["moving_average"](F.col("train"), horizon, window=number),
        "seasonal_naive": lambda: ARRAY_MODELS["seasonal_naive"](F.col("train"), horizon, period=number, freq=freq),
        "exp_smoothing": lambda: ARRAY_MODELS["exp_smoothing"](F.col("train"), horizon, trend=F.col("param")),
        "arima": lambda: F.slice("_fits", (F.array_position("_orders", F.col("param")).cast("int") - 1) * horizon + 1, F.lit(horizon)),
    }
    pred = None
    for m in models:
        one = calls[m]()
        pred = F.when(F.col("model_id") == m, one) if pred is None else pred.when(F.col("model_id") == m, one)
    rows = rows.withColumn("pred", F.slice(pred, 1, F.col("validation")))
    points = rows.select(*keys, "model_id", "round", "param",
                         F.explode(F.arrays_zip("actual", "pred")).alias("z")).select(
        *keys, "model_id", "round", "param", F.col("z.actual").alias("actual"), F.col("z.pred").alias("predicted"))
    scored = error_metrics(points, [*keys, "model_id", "round", "param"])
    return scored.withColumn("status", F.when(F.col("mae").isNull(), "failed").otherwise("success"))


def select_candidate(trials: DataFrame, keys=KEYS) -> DataFrame:
    """Mark the trial with the smallest MAE of each series and model; the earlier round wins ties.

    Errors equal in eleven digits are ties: they differ by the order of a sum only.
    """
    scale = F.pow(F.lit(10.0), F.floor(F.log10("mae")))
    rounded = F.when(F.col("mae") > 0, F.round(F.col("mae") / scale, 10) * scale).otherwise(F.col("mae"))
    w = whole([*keys, "model_id"]).orderBy(rounded.asc_nulls_last(), "round")
    return trials.withColumn("selected", (F.row_number().over(w) == 1) & F.col("mae").isNotNull())
