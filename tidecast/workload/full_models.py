"""Models, searches and explanations at their production settings, on whole tables.

Trees, moving averages and shrunk trends have no SQL; tests/test_search.py compares them with plain versions on small series.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees as L
from ..operators.additive import trend_season
from ..operators.arima import arima_fits
from ..operators.features import feature_matrix
from ..operators.forecasters import arima, naive, residual_interval, series_tail
from ..operators.scoring import largest_residual, pair_predictions
from ..plans.backtest import leaderboard_of, model_grid
from ..plans.experiment import run_experiment
from ..session import stage
from ..spec import CleaningConfig
from .base import hourly_zero, monthly, near, near_sql, query
from .learning import MONTHLY, TEST, order_rows, split

PURE = ("1,0,0", "2,0,0", "1,1,0", "2,1,0")


# several orders of one series from its lag moments; pure autoregressions can be solved in SQL as well
@query("arima_orders", f"""
WITH RECURSIVE m AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS t, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
z AS (SELECT series_id, 0 AS d, t, y, y - avg(y) OVER (PARTITION BY series_id) AS z FROM m
 UNION ALL SELECT series_id, 1, t, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) FROM m),
l AS (SELECT *, lag(z) OVER w AS z1, lag(z, 2) OVER w AS z2, row_number() OVER (PARTITION BY series_id, d ORDER BY t DESC) AS rb FROM z WHERE z IS NOT NULL WINDOW w AS (PARTITION BY series_id, d ORDER BY t)),
s AS (SELECT series_id, d, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c, sum(z * z1) AS u, sum(z * z2) AS v FROM l WHERE z2 IS NOT NULL GROUP BY 1, 2),
k AS (SELECT series_id, d, 1 AS p, sum(z * z1) / sum(z1 * z1) AS f, 0.0::DOUBLE AS g FROM l WHERE z1 IS NOT NULL GROUP BY 1, 2
 UNION ALL SELECT series_id, d, 2, (u * c - v * b) / (a * c - b * b), (a * v - b * u) / (a * c - b * b) FROM s),
e AS (SELECT series_id, d, max(z) FILTER (rb = 1) AS z1, max(z) FILTER (rb = 2) AS z2, max(y) FILTER (rb = 1) AS y, avg(y) AS mean FROM l GROUP BY 1, 2),
r AS (SELECT series_id, d, p, f, g, 0 AS step, z1, z2, 0.0::DOUBLE AS total FROM k JOIN e USING (series_id, d)
 UNION ALL SELECT series_id, d, p, f, g, step + 1, f * z1 + g * z2, z1, total + f * z1 + g * z2 FROM r WHERE step < 6)
SELECT r.series_id, p || ',' || d || ',0' AS pdq, step::BIGINT AS step, {near_sql('CASE d WHEN 0 THEN mean + r.z1 ELSE e.y + total END', 1)} AS predicted FROM r JOIN e USING (series_id, d) WHERE step > 0""")
def _(t):
    rows = series_tail(monthly(t), None)
    fits = rows.select("series_id", arima_fits(F.transform("pts", lambda p: p["y"]), F.array(*[F.lit(o) for o in PURE]), 6)["pred"].alias("made"))
    orders = F.array(*[F.lit(o) for o in PURE])
    flat = fits.select("series_id", F.posexplode("made").alias("at", "predicted"))
    return flat.select("series_id", orders[F.floor(F.col("at") / 6).cast("int")].alias("pdq"), (F.col("at") % 6 + 1).alias("step"), near("predicted", 1).alias("predicted"))


@query("arima_default")
def _(t):
    return arima(hourly_zero(t), 24, "H")


@query("trend_season_default")
def _(t):
    p = hourly_zero(t)
    return trend_season(p, 48, "H", prior=0.05).withColumn("mode", F.lit("additive")).unionByName(trend_season(p, 48, "H", mode="multiplicative", prior=0.05).withColumn("mode", F.lit("multiplicative")))


_FITTED: dict[tuple, tuple] = {}


def fitted(t, learner, panel):
    """(model, its staged matrix) at default settings; fitted once a session and folder, for all queries that look at it."""
    key = (t.spark.sparkContext.applicationId, t.folder, learner.__name__)
    if key not in _FITTED:
        matrix, names = feature_matrix(panel)
        matrix = stage(matrix)
        _FITTED[key] = learner(matrix, names), matrix
    return _FITTED[key]


@query("lag_forest_default")
def _(t):
    train, test = split(t)
    points = pair_predictions(test, L.recursive_predict(fitted(t, L.lag_forest, train)[0], train, TEST, "H").unionByName(naive(train, TEST, "H")))
    return leaderboard_of(points, model_grid(train.select("series_id").distinct(), ["lag_forest", "naive"]), TEST)


@query("lag_boosting_default")
def _(t):
    p = hourly_zero(t)
    model, matrix = fitted(t, L.lag_boosting, p)
    return residual_interval(L.fitted_residuals(model, matrix), L.recursive_predict(model, p, TEST, "H"))


@query("forest_drivers")
def _(t):
    model, matrix = fitted(t, L.lag_forest, split(t)[0])
    return L.shapley_sampled(model, matrix, paths=True)


@query("forest_worst_points")
def _(t):
    train, test = split(t)
    model, _ = fitted(t, L.lag_forest, train)
    rows = stage(L.recursive_predict(model, train, TEST, "H", with_features=True))
    worst = largest_residual(pair_predictions(test, rows))
    told = rows.join(worst.select("series_id", "t"), ["series_id", "t"])
    return L.single_point(worst, L.shapley_points(model, told, None, ["series_id", "t"]))


# trees at the sizes that benchmarks use: fitting them for the back-test and again for the forecast is a job per level and tree
EVERY = ("naive", "seasonal_naive", "moving_average", "exp_smoothing", "arima", ("trend_season", {"prior": 0.05}), ("lag_forest", {"trees": 60}), ("lag_boosting", {"trees": 40, "depth": 2}))


@query("experiment_every_model")
def _(t):
    run = run_experiment(order_rows(t), MONTHLY, EVERY, 6, 6, CleaningConfig(missing="drop", fill_steps=False), "sum")
    return run.leaderboard.select("series_id", "model_id", "mae", "rmse", "wape", "rank", "status", "error", "warnings")


# searches over tree models fit some hundred trees a candidate; tests/test_search.py runs them with short lists
@query("experiment_search")
def _(t):
    run = run_experiment(order_rows(t), MONTHLY, ["moving_average", "seasonal_naive", "exp_smoothing", "arima", "trend_season"], 6, 6, CleaningConfig(missing="drop", fill_steps=False), "sum", tune="all")
    return run.trials.select("series_id", "model_id", "round", "param", "mae", "status", "error", "selected")
