"""Tree models, explanations, drivers and user forecasters."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from ..functions.calendar import next_period
from ..operators import scenario as N
from ..operators import trees as L
from ..operators.custom import register_forecaster, run_forecaster
from ..operators.features import feature_matrix
from ..operators.forecasters import naive, residual_interval
from ..operators.runs import importance_by_name
from ..operators.scoring import holdout_split, largest_residual, pair_predictions
from ..plans.backtest import leaderboard_of, model_grid
from ..plans.experiment import run_experiment
from ..spec import CleaningConfig, CovariateRole, FeatureConfig, PanelSpec
from .base import CTES, hourly_zero, monthly, near, near_sql, query, with_ctes
from .models_and_scores import BASELINES, hourly_run
from .windows_and_fill import NAMES

TEST = 24


def split(t):
    s = holdout_split(hourly_zero(t), TEST)
    return s.where(~F.col("is_test")).drop("is_test", "step"), s.where("is_test")


# One tree with one split over the hour and the weekday can be found in SQL: the split that leaves the least variance, and
# the mean on either side.  Deeper trees are compared with the model's own prediction in the unit tests.

ONLY = FeatureConfig(lags=(), means=(), stds=(), calendar=False, holidays=False, covariates=("hour", "weekday"))


def with_clock(df):
    return df.withColumns({"hour": F.hour("t").cast("double"), "weekday": F.weekday("t").cast("double")})


def stump(train):
    return L.lag_forest(with_clock(train), ONLY.covariates, ONLY, trees=1, depth=1, bootstrap=False)


def clock_ahead(panel, horizon):
    ends = panel.groupBy("series_id").agg(F.max("t").alias("_t"))
    steps = ends.select("series_id", "_t", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return with_clock(steps.withColumn("t", next_period("_t", "H", F.col("step")))).drop("_t", "t")


def _stump_ctes(prefix, source, features=("hour", "weekday")):
    every = " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS x, y FROM {prefix}_v" for f in features)
    CTES[f"{prefix}_v"] = (source, f"SELECT *, hour(t) AS hour, isodow(t) - 1 AS weekday FROM {source}")
    CTES[f"{prefix}_g"] = (f"{prefix}_v", f"""
SELECT f, x, sum(y) AS s, count(*) AS n FROM ({every}) GROUP BY 1, 2""")
    CTES[f"{prefix}_c"] = (f"{prefix}_g", f"""
SELECT f, x, sum(s) OVER w AS ls, sum(n) OVER w AS ln, sum(s) OVER (PARTITION BY f) AS ts, sum(n) OVER (PARTITION BY f) AS tn FROM {prefix}_g WINDOW w AS (PARTITION BY f ORDER BY x)""")
    CTES[f"{prefix}_cut"] = (f"{prefix}_c", f"""
SELECT f, x + 0.5 AS cut, ls / ln AS low, (ts - ls) / (tn - ln) AS high FROM {prefix}_c WHERE ln < tn ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC LIMIT 1""")


_LEAF = "CASE WHEN CASE c.f WHEN 'hour' THEN {h} ELSE {w} END <= c.cut THEN c.low ELSE c.high END"
CTES["lf_rows"] = ("ev_zero", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS back FROM ev_zero")
CTES["lf_train"] = ("lf_rows", f"SELECT series_id, t, y FROM lf_rows WHERE back > {TEST}")
_stump_ctes("lf", "lf_train")
_stump_ctes("lb", "ev_zero")
CTES["lf_points"] = ("lf_rows lf_cut", f"""
SELECT series_id, t, back, y AS actual, {_LEAF.format(h='hour(t)', w='isodow(t) - 1')} AS predicted FROM lf_rows, lf_cut c WHERE back <= {TEST}""")


@query("lag_forest_leaderboard", with_ctes("lf_points lf_rows", f"""
, a AS (SELECT series_id, 'lag_forest' AS model_id, actual, predicted FROM lf_points
 UNION ALL SELECT p.series_id, 'naive', p.actual, r.y FROM lf_points p JOIN lf_rows r ON r.series_id = p.series_id AND r.back = {TEST} + 1),
m AS (SELECT series_id, model_id, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse FROM a GROUP BY 1, 2)
SELECT series_id, model_id, {near_sql('mae')} AS mae, {near_sql('rmse')} AS rmse, row_number() OVER (PARTITION BY series_id ORDER BY mae, model_id) AS rank FROM m""".replace("\n, a AS", ", a AS", 1)))
def _(t):
    train, test = split(t)
    trees = L.recursive_predict(stump(train), with_clock(train), TEST, "H", clock_ahead(train, TEST))
    base = naive(train, TEST, "H")
    points = pair_predictions(test, trees.unionByName(base))
    expected = model_grid(train.select("series_id").distinct(), ["lag_forest", "naive"])
    board = leaderboard_of(points, expected, TEST)
    return board.select("series_id", "model_id", near("mae").alias("mae"), near("rmse").alias("rmse"), "rank")


@query("lag_boosting_forecast", with_ctes("lb_v lb_cut ehf_axis", f"""
, r AS (SELECT series_id, stddev_samp(y - {_LEAF.format(h='hour', w='weekday')}) AS s FROM lb_v, lb_cut c GROUP BY 1),
p AS (SELECT series_id, step, t, {_LEAF.format(h='hour(t)', w='isodow(t) - 1')} AS predicted FROM ehf_axis, lb_cut c WHERE step <= 12)
SELECT series_id, step, t, {near_sql('predicted')} AS predicted, {near_sql('predicted - 1.96 * s')} AS lower, {near_sql('predicted + 1.96 * s')} AS upper FROM p JOIN r USING (series_id)""".replace("\n, r AS", ", r AS", 1)))
def _(t):
    p = with_clock(hourly_zero(t))
    model = L.lag_boosting(p, ONLY.covariates, ONLY, trees=1, depth=1, share=1.0)
    out = residual_interval(L.fitted_residuals(model, p), L.recursive_predict(model, p, 12, "H", clock_ahead(p, 12)))
    return out.select("series_id", "step", "t", *[near(c).alias(c) for c in ("predicted", "lower", "upper")])


@query("feature_importance", with_ctes("lf_cut", """
SELECT 'lag_forest' AS model_id, n AS feature, CASE WHEN n = f THEN 1.0 ELSE 0.0 END::DOUBLE AS importance, CASE WHEN n = f THEN 1 ELSE 2 END::BIGINT AS rank
FROM lf_cut, (VALUES ('hour'), ('weekday')) AS v(n)"""))
def _(t):
    return L.feature_importance(t.spark, stump(split(t)[0]))


# a stump's contributions: all of the step from the mean row's leaf to the row's own goes to the one feature it looks at
CTES["lf_base"] = ("lf_v lf_cut", f"SELECT {_LEAF.format(h='m.h', w='m.w')} AS base FROM lf_cut c, (SELECT avg(hour) AS h, avg(weekday) AS w FROM lf_v) m")


@query("shapley_drivers", with_ctes("lf_v lf_cut lf_base", f"""
, l AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS back FROM lf_v),
d AS (SELECT c.f, {_LEAF.format(h='hour', w='weekday')} - base AS x FROM l, lf_cut c, lf_base WHERE back <= 128),
a AS (SELECT n AS feature, avg(CASE WHEN n = f THEN abs(x) ELSE 0 END) AS mean_abs, avg(CASE WHEN n = f THEN x ELSE 0 END) AS signed FROM d, (VALUES ('hour'), ('weekday')) AS v(n) GROUP BY 1)
SELECT 'lag_forest' AS model_id, feature, {near_sql('mean_abs')} AS mean_abs, CASE WHEN signed > 1e-9 THEN 'positive' WHEN signed < -1e-9 THEN 'negative' ELSE 'neutral' END AS direction,
 rank() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM a""".replace("\n, l AS", ", l AS", 1)))
def _(t):
    train = split(t)[0]
    out = L.shapley_sampled(stump(train), with_clock(train))
    return out.select("model_id", "feature", near("mean_abs").alias("mean_abs"), "direction", "rank")


@query("single_point", with_ctes("lf_points lf_cut lf_base", f"""
, w AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(actual - predicted) DESC, t) AS r FROM lf_points)
SELECT series_id, t, n AS feature, {near_sql('CASE WHEN n = f THEN predicted - base ELSE 0 END')} AS contribution,
 CASE WHEN n <> f OR abs(predicted - base) <= 1e-9 THEN 'neutral' WHEN predicted > base THEN 'positive' ELSE 'negative' END AS direction
FROM w, lf_cut, lf_base, (VALUES ('hour'), ('weekday')) AS v(n) WHERE r = 1""".replace("\n, w AS", ", w AS", 1)))
def _(t):
    train, test = split(t)
    model = stump(train)
    rows = L.recursive_predict(model, with_clock(train), TEST, "H", clock_ahead(train, TEST), with_features=True)
    worst = largest_residual(pair_predictions(test, rows))
    told = rows.join(worst.select("series_id", "t"), ["series_id", "t"])
    out = L.single_point(worst, L.shapley_points(model, told, with_clock(train), ["series_id", "t"]))
    return out.select("series_id", "t", "feature", near("contribution").alias("contribution"), "direction")


@query("user_forecaster", with_ctes("ehf_end", f"""
SELECT m.series_id, 'last_median' AS model_id, g.k::BIGINT AS step, {near_sql('m.y')} AS predicted, NULL::VARCHAR AS error
FROM (SELECT series_id, median(y) AS y FROM ehf_end WHERE rb <= 24 GROUP BY 1) m, generate_series(1, 12) AS g(k)"""))
def _(t):
    def last_median(history: pd.DataFrame, horizon: int) -> pd.DataFrame:
        return pd.DataFrame({"predicted": [history["y"].tail(24).median()] * horizon})

    register_forecaster("last_median", last_median)
    out = run_forecaster("last_median", hourly_zero(t), 12)
    return out.select("series_id", "model_id", "step", near("predicted").alias("predicted"), "error")


# naive one-step residuals as the in-sample fit

CTES["ins"] = ("ord_m", "SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS residual FROM ord_m")


@query("residual_interval", with_ctes("ins omf_axis omf_end", f"""
, s AS (SELECT series_id, stddev_samp(residual) AS s FROM ins GROUP BY 1)
SELECT a.series_id, a.step, {near_sql('e.y - 1.96 * s.s', 1)} AS lower, {near_sql('e.y + 1.96 * s.s', 1)} AS upper FROM omf_axis a JOIN omf_end e ON e.series_id = a.series_id AND e.rb = 1 JOIN s ON s.series_id = a.series_id""".replace("\n, s AS", ", s AS", 1)))
def _(t):
    from ..operators.features import lag_features
    p = monthly(t)
    fit = lag_features(p, (1,)).select("series_id", F.lit("naive").alias("model_id"), "t", (F.col("y") - F.col("lag_1")).alias("residual"))
    return residual_interval(fit, naive(p, 12, "M")).select("series_id", "step", near("lower", 1).alias("lower"), near("upper", 1).alias("upper"))


# drivers: |correlation| of every feature with the target stands for its importance

CTES["imp"] = ("features", " UNION ALL ".join(f"SELECT series_id, '{n}' AS feature, abs(corr({n}, y)) AS importance, corr({n}, y) AS signed FROM features WHERE time_index >= 7 GROUP BY 1" for n in NAMES))
CTES["imp_rank"] = ("imp", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY importance DESC, feature) AS rank FROM imp")


def importance(t):
    m, _ = feature_matrix(hourly_zero(t))
    wide = m.groupBy("series_id").agg(*[F.corr(n, "y").alias(n) for n in NAMES])
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("signed")) for n in NAMES])
    return wide.select("series_id", F.explode(items).alias("c")).select("series_id", "c.*", F.abs("c.signed").alias("importance"))


def drivers(t):
    con = importance(t).select("series_id", "feature", F.col("importance").alias("mean_abs"), F.when(F.col("signed") > 0, "positive").otherwise("negative").alias("direction"))
    half = con.where(F.col("series_id") < "e")
    return N.driver_ranking(half, importance(t), 8, ["series_id"])


@query("top_features", with_ctes("imp_rank", f"SELECT series_id, feature, {near_sql('importance', 6)} AS importance, rank FROM imp_rank WHERE rank <= 5"))
def _(t):
    return N.top_features(importance(t), 5, by=["series_id"]).select("series_id", "feature", near("importance", 6).alias("importance"), "rank")


@query("driver_ranking", with_ctes("imp_rank", f"""
SELECT series_id, feature, {near_sql('importance', 6)} AS score, CASE WHEN series_id >= 'e' THEN 'mixed' WHEN signed > 0 THEN 'positive' ELSE 'negative' END AS direction,
 CASE WHEN series_id < 'e' THEN 'contribution' ELSE 'importance' END AS evidence, rank FROM imp_rank WHERE rank <= 8"""))
def _(t):
    return drivers(t).select("series_id", "feature", near("score", 6).alias("score"), "direction", "evidence", "rank")


@query("sensitivity", with_ctes("imp_rank", f"SELECT series_id, feature, rank, {near_sql('10 * importance / sum(importance) OVER (PARTITION BY series_id)', 4)} AS plus10 FROM imp_rank WHERE rank <= 5"))
def _(t):
    return N.sensitivity(drivers(t), 5, ["series_id"]).select("series_id", "feature", "rank", near("plus10").alias("plus10"))


@query("waterfall", with_ctes("imp_rank", f"SELECT series_id, feature, rank, {near_sql('CASE WHEN series_id >= chr(101) THEN importance * 0.5 WHEN signed > 0 THEN importance ELSE -importance END', 6)} AS value FROM imp_rank WHERE rank <= 6"))
def _(t):
    return N.waterfall(drivers(t), 6, ["series_id"]).select("series_id", "feature", "rank", near("value", 6).alias("value"))


@query("importance_by_name", with_ctes("imp", f"""
SELECT replace(feature, '_', '') AS feature, {near_sql('max(importance)', 6)} AS importance, {near_sql("max(importance) FILTER (series_id <> 'click')", 6)} AS contribution FROM imp GROUP BY 1"""))
def _(t):
    imp = importance(t).withColumn("target", F.lit("y"))
    con = imp.where(F.col("series_id") != "click").withColumnRenamed("importance", "mean_abs")
    return importance_by_name(imp, con).select("feature", near("importance", 6).alias("importance"), near("contribution", 6).alias("contribution"))


# -- whole experiments: raw rows in, leaderboard and forecast out

CTES["ex_best"] = ("om_board om_points", """
SELECT b.series_id, b.model_id, s FROM om_board b JOIN (SELECT series_id, model_id, stddev_samp(residual) AS s FROM om_points GROUP BY 1, 2) p USING (series_id, model_id) WHERE b.rank = 1""")
MONTHLY = PanelSpec(("series_id",), "o_orderdate", "o_totalprice", "M", "o_orderkey")


def order_rows(t):
    return t.orders.withColumnRenamed("o_orderpriority", "series_id")


def monthly_experiment(t, models=BASELINES, **more):
    return run_experiment(order_rows(t), MONTHLY, models, 6, 6, CleaningConfig(missing="drop", fill_steps=False), "sum", **more)


@query("experiment_leaderboard", with_ctes("om_board", f"SELECT series_id, model_id, {near_sql('mae', 2)} AS mae, {near_sql('wape', 6)} AS wape, rank, 'success' AS status FROM om_board"))
def _(t):
    return monthly_experiment(t).leaderboard.select("series_id", "model_id", near("mae", 2).alias("mae"), near("wape", 6).alias("wape"), "rank", "status")


@query("experiment_forecast", with_ctes("om_rows ex_best", f"""
, p AS (SELECT a.series_id, b.model_id, a.step, a.t, b.s, CASE b.model_id WHEN 'naive' THEN n.y WHEN 'seasonal_naive' THEN s.y ELSE m.m END AS predicted
 FROM (SELECT series_id, k::BIGINT AS step, (t + k * INTERVAL 1 MONTH)::TIMESTAMP AS t FROM om_rows, generate_series(1, 6) AS g(k) WHERE back = 1) a
 JOIN ex_best b ON b.series_id = a.series_id JOIN om_rows n ON n.series_id = a.series_id AND n.back = 1 JOIN om_rows s ON s.series_id = a.series_id AND s.back = 12 - (a.step - 1) % 12
 JOIN (SELECT series_id, avg(y) AS m FROM om_rows WHERE back <= 7 GROUP BY 1) m ON m.series_id = a.series_id)
SELECT series_id, model_id, step, t, {near_sql('predicted', 2)} AS predicted, {near_sql('predicted - 1.96 * s', 1)} AS lower, {near_sql('predicted + 1.96 * s', 1)} AS upper FROM p""".replace("\n, p AS", ", p AS", 1)))
def _(t):
    out = monthly_experiment(t).forecast
    return out.select("series_id", "model_id", "step", "t", near("predicted", 2).alias("predicted"), near("lower", 1).alias("lower"), near("upper", 1).alias("upper"))


@query("experiment_tuned", with_ctes("trials om_test om_train", f"""
, best AS (SELECT series_id, model_id, param::INT AS p FROM (SELECT *, row_number() OVER (PARTITION BY series_id, model_id ORDER BY round(mae, 4), round) AS r FROM trials) WHERE r = 1),
e AS (SELECT s.series_id, b.model_id, b.p, abs(s.actual - CASE b.model_id WHEN 'moving_average' THEN (SELECT avg(h.y) FROM om_train h WHERE h.series_id = s.series_id AND h.rb <= b.p)
  ELSE (SELECT max(h.y) FROM om_train h WHERE h.series_id = s.series_id AND h.rb = b.p - (s.step - 1) % b.p) END) AS err FROM om_test s JOIN best b USING (series_id))
SELECT series_id, model_id, p::VARCHAR AS param, {near_sql('avg(err)', 2)} AS mae, row_number() OVER (PARTITION BY series_id ORDER BY avg(err), model_id) AS rank FROM e GROUP BY 1, 2, 3""".replace("\n, best AS", ", best AS", 1)))
def _(t):
    board = monthly_experiment(t, ("moving_average", "seasonal_naive"), tune="all").leaderboard
    return board.select("series_id", "model_id", "param", near("mae", 2).alias("mae"), "rank")


# a covariate that comes as text, known ahead from the calendar, drives a tree of one split
CTES["wk_train"] = ("lf_train", "SELECT * FROM lf_train QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t) > 1")
_stump_ctes("wk", "wk_train", ("weekday",))
CTES["wk_points"] = ("lf_rows wk_cut", f"SELECT r.series_id, t, back, y AS actual, {_LEAF.format(h='0', w='isodow(t) - 1')} AS predicted FROM lf_rows r, wk_cut c WHERE back <= {TEST}")


@query("experiment_with_covariates", with_ctes("wk_points lf_rows", f"""
, a AS (SELECT series_id, 'lag_forest' AS model_id, actual, predicted FROM wk_points
 UNION ALL SELECT p.series_id, 'naive', p.actual, r.y FROM wk_points p JOIN lf_rows r ON r.series_id = p.series_id AND r.back = {TEST} + 1)
SELECT series_id, model_id, {near_sql('avg(abs(actual - predicted))')} AS mae, row_number() OVER (PARTITION BY series_id ORDER BY avg(abs(actual - predicted)), model_id DESC) AS rank FROM a GROUP BY 1, 2""".replace("\n, a AS", ", a AS", 1)))
def _(t):
    rows = hourly_zero(t).select("series_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("y").cast("string").alias("value"),
                                 F.concat(F.lit(" "), F.weekday("t").cast("string")).alias("weekday"))
    plain = replace(ONLY, covariates=())
    run = run_experiment(rows, PanelSpec(("series_id",), "time", "value", "H"), ["naive", ("lag_forest", {"trees": 1, "depth": 1, "bootstrap": False})], 12, TEST,
                         roles=[CovariateRole("weekday", "known_future")], features=plain)
    return run.leaderboard.select("series_id", "model_id", near("mae").alias("mae"), "rank")
