"""Forecasters, back-tests, metrics, ranking, parameter search and residual reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import SEASON
from ..operators import forecasters as M
from ..operators import scoring as S
from ..operators.additive import trend_season
from ..plans import backtest as B
from .base import CTES, daily, daily_grid, hourly_zero, monthly, near, near_sql, query, with_ctes

TEST = 6
BASELINES = ("naive", "seasonal_naive", "moving_average")


def _backtest_ctes(prefix: str, source: str, test: int, period: int, window: int = 7):
    CTES[f"{prefix}_rows"] = (source, f"SELECT series_id, t, y, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS back FROM {source}")
    CTES[f"{prefix}_test"] = (f"{prefix}_rows", f"SELECT series_id, t, y AS actual, {test} - back + 1 AS step FROM {prefix}_rows WHERE back <= {test}")
    CTES[f"{prefix}_train"] = (f"{prefix}_rows", f"SELECT series_id, t, y, back - {test} AS rb, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i FROM {prefix}_rows WHERE back > {test}")
    CTES[f"{prefix}_points"] = (f"{prefix}_test {prefix}_train", f"""
SELECT p.*, actual - predicted AS residual, abs(actual - predicted) AS abs_error, (actual - predicted) * (actual - predicted) AS sq_error FROM (
 SELECT s.series_id, 'naive' AS model_id, 0 AS selection, s.step, s.t, s.actual, r.y AS predicted FROM {prefix}_test s JOIN {prefix}_train r ON r.series_id = s.series_id AND r.rb = 1
 UNION ALL SELECT s.series_id, 'seasonal_naive', 1, s.step, s.t, s.actual, r.y FROM {prefix}_test s JOIN {prefix}_train r ON r.series_id = s.series_id AND r.rb = {period} - (s.step - 1) % {period}
 UNION ALL SELECT s.series_id, 'moving_average', 2, s.step, s.t, s.actual, r.m FROM {prefix}_test s JOIN (SELECT series_id, avg(y) AS m FROM {prefix}_train WHERE rb <= {window} GROUP BY 1) r ON r.series_id = s.series_id) p""")
    CTES[f"{prefix}_metrics"] = (f"{prefix}_points", f"""
SELECT series_id, model_id, selection, avg(abs_error) AS mae, avg(sq_error) AS mse, sqrt(avg(sq_error)) AS rmse, sum(abs_error) / nullif(sum(abs(actual)), 0) AS wape FROM {prefix}_points GROUP BY 1, 2, 3""")
    CTES[f"{prefix}_board"] = (f"{prefix}_metrics", f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, selection) AS rank FROM {prefix}_metrics")


_backtest_ctes("om", "ord_m", TEST, 12)
_backtest_ctes("eh", "ev_zero", 48, 24)
CTES["od_zero"] = ("ord_grid", "SELECT series_id, t, coalesce(y, 0.0) AS y FROM ord_grid")
_backtest_ctes("od", "od_zero", 14, 7)

BOARD = "SELECT series_id, model_id, {mae} AS mae, {rmse} AS rmse, {wape} AS wape, rank FROM {p}_board"


def board_sql(prefix: str, digits: int) -> str:
    return with_ctes(f"{prefix}_board", BOARD.format(p=prefix, mae=near_sql("mae", digits), rmse=near_sql("rmse", digits), wape=near_sql("wape", 6)))


def board_rows(board, digits: int):
    return board.select("series_id", "model_id", near("mae", digits).alias("mae"), near("rmse", digits).alias("rmse"), near("wape", 6).alias("wape"), "rank")


def monthly_run(t):
    return B.backtest(monthly(t), BASELINES, TEST, "M")


def hourly_run(t):
    return B.backtest(hourly_zero(t), BASELINES, 48, "H")


@query("leaderboard_monthly", board_sql("om", 2))
def _(t):
    return board_rows(monthly_run(t)[0], 2)


@query("leaderboard_hourly", board_sql("eh", 4))
def _(t):
    return board_rows(hourly_run(t)[0], 4)


@query("leaderboard_daily", board_sql("od", 2))
def _(t):
    from ..operators.fill import fill_value
    p = fill_value(daily_grid(t), "zero").drop("is_gap")
    return board_rows(B.backtest(p, BASELINES, 14, "D")[0], 2)


@query("backtest_points", with_ctes("eh_points", f"SELECT series_id, model_id, step, t, {near_sql('actual')} AS actual, {near_sql('predicted')} AS predicted, {near_sql('residual')} AS residual FROM eh_points"))
def _(t):
    return hourly_run(t)[1].select("series_id", "model_id", "step", "t", near("actual").alias("actual"), near("predicted").alias("predicted"), near("residual").alias("residual"))


# one model at a time, on all history
def _last(prefix, source, freq_step, h):
    CTES[f"{prefix}_end"] = (source, f"SELECT series_id, t, y, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS rb FROM {source}")
    CTES[f"{prefix}_axis"] = (f"{prefix}_end", f"SELECT series_id, k::BIGINT AS step, (t + k * INTERVAL 1 {freq_step})::TIMESTAMP AS t FROM {prefix}_end, generate_series(1, {h}) AS g(k) WHERE rb = 1")


_last("omf", "ord_m", "MONTH", 12)
_last("ehf", "ev_zero", "HOUR", 36)


@query("future_axis", with_ctes("omf_axis", "SELECT * FROM omf_axis"))
def _(t):
    return M.future_axis(monthly(t), 12, "M")


@query("naive", with_ctes("omf_axis", f"SELECT a.*, {near_sql('e.y', 2)} AS predicted FROM omf_axis a JOIN omf_end e ON e.series_id = a.series_id AND e.rb = 1"))
def _(t):
    return M.naive(monthly(t), 12, "M").select("series_id", "step", "t", near("predicted", 2).alias("predicted"))


@query("seasonal_naive", with_ctes("ehf_axis", f"SELECT a.*, {near_sql('e.y')} AS predicted FROM ehf_axis a JOIN ehf_end e ON e.series_id = a.series_id AND e.rb = 24 - (a.step - 1) % 24"))
def _(t):
    return M.seasonal_naive(hourly_zero(t), 36, "H").select("series_id", "step", "t", near("predicted").alias("predicted"))


@query("moving_average", with_ctes("ehf_axis", f"SELECT a.*, {near_sql('m.m')} AS predicted FROM ehf_axis a JOIN (SELECT series_id, avg(y) AS m FROM ehf_end WHERE rb <= 24 GROUP BY 1) m USING (series_id)"))
def _(t):
    return M.moving_average(hourly_zero(t), 36, "H", 24).select("series_id", "step", "t", near("predicted").alias("predicted"))


_grid = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a in M.ALPHAS for b in M.BETAS)
CTES["sm_in"] = ("ord_m", "SELECT series_id, t, y, row_number() OVER (PARTITION BY series_id ORDER BY t) AS i, lead(y) OVER (PARTITION BY series_id ORDER BY t) AS nxt, count(*) OVER (PARTITION BY series_id) AS n FROM ord_m")
CTES["sm"] = ("sm_in", f"""
SELECT s.series_id, g.a, g.b, 1::BIGINT AS i, s.y AS level, s.nxt - s.y AS slope, 0.0::DOUBLE AS sse FROM sm_in s, (VALUES {_grid}) AS g(a, b) WHERE s.i = 1
UNION ALL
SELECT r.series_id, r.a, r.b, r.i + 1, r.level + r.slope + r.a * (s.y - (r.level + r.slope)), r.slope + (r.a * r.b) * (s.y - (r.level + r.slope)),
 r.sse + (s.y - (r.level + r.slope)) * (s.y - (r.level + r.slope)) FROM sm r JOIN sm_in s ON s.series_id = r.series_id AND s.i = r.i + 1""")
CTES["sm_best"] = ("sm sm_in omf_axis", """
SELECT * FROM (SELECT r.*, s.n, row_number() OVER (PARTITION BY r.series_id ORDER BY sse, a, b) AS pick FROM sm r JOIN sm_in s ON s.series_id = r.series_id AND s.i = r.i AND s.n = r.i) WHERE pick = 1""")


@query("exp_smoothing", with_ctes("sm_best", f"""
SELECT x.series_id, x.step, x.t, {near_sql('level + slope * step', 1)} AS predicted, {near_sql('level + slope * step - 1.96 * sqrt(sse / (n - 1))', 1)} AS lower,
 {near_sql('level + slope * step + 1.96 * sqrt(sse / (n - 1))', 1)} AS upper FROM omf_axis x JOIN sm_best b USING (series_id)"""))
def _(t):
    return M.exp_smoothing(monthly(t), 12, "M").select("series_id", "step", "t", *[near(c, 1).alias(c) for c in ("predicted", "lower", "upper")])


# (1,0,0): deviations from the mean decay by the lag-one coefficient; (1,1,0): the same for changes, which are then summed
CTES["ar_z"] = ("ord_m", """
SELECT series_id, t, y, z, lag(z) OVER w AS z1, c, lag(c) OVER w AS c1, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS rb
FROM (SELECT series_id, t, y, y - avg(y) OVER (PARTITION BY series_id) AS z, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS c FROM ord_m)
WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
CTES["ar_fit"] = ("ar_z", """
SELECT series_id, sum(z * z1) / sum(z1 * z1) AS a, sum(c * c1) FILTER (c1 IS NOT NULL) / sum(c1 * c1) AS b, avg(y) AS mean, max(z) FILTER (rb = 1) AS z,
 max(c) FILTER (rb = 1) AS c, max(y) FILTER (rb = 1) AS y, max(t) AS t FROM ar_z GROUP BY 1""")


@query("arima", with_ctes("ar_fit", f"""
SELECT series_id, '1,0,0' AS pdq, k::BIGINT AS step, (t + k * INTERVAL 1 MONTH)::TIMESTAMP AS t, {near_sql('mean + z * pow(a, k)', 1)} AS predicted FROM ar_fit, generate_series(1, 12) AS g(k)
UNION ALL SELECT series_id, '1,1,0', k::BIGINT, (t + k * INTERVAL 1 MONTH)::TIMESTAMP, {near_sql('y + c * list_sum(list_transform(generate_series(1, k), lambda i: pow(b, i)))', 1)} FROM ar_fit, generate_series(1, 12) AS g(k)"""))
def _(t):
    p = monthly(t)
    plain = M.arima(p, 12, "M", p=1, d=0, q=0).withColumn("pdq", F.lit("1,0,0"))
    changes = M.arima(p, 12, "M", p=1, d=1, q=0).withColumn("pdq", F.lit("1,1,0"))
    return plain.unionByName(changes).select("series_id", "pdq", "step", "t", near("predicted", 1).alias("predicted"))


@query("trend_regression", with_ctes("sm_in omf_axis", f"""
, r AS (SELECT series_id, regr_slope(y, k) AS s, regr_intercept(y, k) AS c, max(k) AS n FROM (SELECT series_id, y, year(t) * 12 + month(t) - 23940 AS k FROM sm_in) GROUP BY 1)
SELECT x.series_id, x.step, x.t, {near_sql('c + s * (n + step)', 1)} AS predicted FROM omf_axis x JOIN r USING (series_id)""".replace("\n, r AS", ", r AS", 1)))
def _(t):
    return trend_season(monthly(t), 12, "M", seasons=()).select("series_id", "step", "t", near("predicted", 1).alias("predicted"))


# one daily wave and a trend, by making the terms orthogonal one after the other
CTES["ts_x"] = ("ehf_end", """
SELECT series_id, rb, y, sin(h * pi() / 12) AS s, cos(h * pi() / 12) AS c, h AS x, h FROM (SELECT series_id, rb, y, (epoch(t) / 3600)::DOUBLE - 473352 AS h FROM ehf_end)""")
CTES["ts_1"] = ("ts_x", "SELECT series_id, avg(s) AS ms, avg(c) AS mc, avg(x) AS mx, avg(y) AS my, count(*) AS n, max(h) AS last FROM ts_x GROUP BY 1")
CTES["ts_2"] = ("ts_x ts_1", """
SELECT series_id, sum((c - mc) * (s - ms)) / sum((s - ms) * (s - ms)) AS cs, sum((x - mx) * (s - ms)) / sum((s - ms) * (s - ms)) AS xs,
 sum((y - my) * (s - ms)) / sum((s - ms) * (s - ms)) AS bs FROM ts_x JOIN ts_1 USING (series_id) GROUP BY 1""")
CTES["ts_3"] = ("ts_x ts_1 ts_2", """
SELECT series_id, sum((x - mx) * u) / sum(u * u) AS xc, sum((y - my) * u) / sum(u * u) AS bc
FROM (SELECT *, c - mc - cs * (s - ms) AS u FROM ts_x JOIN ts_1 USING (series_id) JOIN ts_2 USING (series_id)) GROUP BY 1""")
_TS_V = "(x - mx - xs * (s - ms) - xc * (c - mc - cs * (s - ms)))"
_TS_FIT = f"(my + bs * (s - ms) + bc * (c - mc - cs * (s - ms)) + bx * {_TS_V})"
CTES["ts_4"] = ("ts_x ts_1 ts_2 ts_3", f"""
SELECT series_id, sum((y - my) * {_TS_V}) / sum({_TS_V} * {_TS_V}) AS bx FROM ts_x JOIN ts_1 USING (series_id) JOIN ts_2 USING (series_id) JOIN ts_3 USING (series_id) GROUP BY 1""")
CTES["ts_5"] = ("ts_x ts_1 ts_2 ts_3 ts_4", f"""
SELECT series_id, sqrt(sum((y - {_TS_FIT}) * (y - {_TS_FIT})) / (any_value(n) - 4)) AS sigma
FROM ts_x JOIN ts_1 USING (series_id) JOIN ts_2 USING (series_id) JOIN ts_3 USING (series_id) JOIN ts_4 USING (series_id) GROUP BY 1""")


@query("trend_season", with_ctes("ts_1 ts_2 ts_3 ts_4 ts_5", f"""
, f AS (SELECT *, last + k AS x, sin((last + k) * pi() / 12) AS s, cos((last + k) * pi() / 12) AS c
 FROM ts_1 JOIN ts_2 USING (series_id) JOIN ts_3 USING (series_id) JOIN ts_4 USING (series_id) JOIN ts_5 USING (series_id), generate_series(1, 48) AS g(k))
SELECT series_id, k::BIGINT AS step, {near_sql(_TS_FIT, 2)} AS predicted, {near_sql(f'{_TS_FIT} - 1.2816 * sigma', 2)} AS lower, {near_sql(f'{_TS_FIT} + 1.2816 * sigma', 2)} AS upper FROM f""".replace("\n, f AS", ", f AS", 1)))
def _(t):
    out = trend_season(hourly_zero(t), 48, "H", seasons=((24, 1),))
    return out.select("series_id", "step", *[near(c, 2).alias(c) for c in ("predicted", "lower", "upper")])


CTES["ab_z"] = ("om_train", """
SELECT series_id, z, lag(z) OVER (PARTITION BY series_id ORDER BY t) AS z1, mean, rb FROM (SELECT series_id, t, rb, y - avg(y) OVER (PARTITION BY series_id) AS z, avg(y) OVER (PARTITION BY series_id) AS mean FROM om_train)""")
CTES["ab_fit"] = ("ab_z", "SELECT series_id, sum(z * z1) / sum(z1 * z1) AS a, any_value(mean) AS mean, max(z) FILTER (rb = 1) AS z FROM ab_z GROUP BY 1")
CTES["ab_points"] = ("om_rows ab_fit", f"""
SELECT series_id, y AS actual, mean + z * pow(a, {TEST} + 1 - back) AS predicted FROM om_rows JOIN ab_fit USING (series_id) WHERE back <= {TEST}""")


@query("backtest_all_models", with_ctes("om_board ab_points", f"""
, b AS (SELECT series_id, model_id, selection, mae, rmse, wape FROM om_board UNION ALL SELECT series_id, 'arima', 3, avg(abs(actual - predicted)), sqrt(avg((actual - predicted) * (actual - predicted))),
 sum(abs(actual - predicted)) / sum(abs(actual)) FROM ab_points GROUP BY 1)
SELECT series_id, model_id, {near_sql('mae', 2)} AS mae, {near_sql('rmse', 2)} AS rmse, {near_sql('wape', 6)} AS wape, row_number() OVER (PARTITION BY series_id ORDER BY mae, selection) AS rank, 'success' AS status FROM b""".replace("\n, b AS", ", b AS", 1)))
def _(t):
    board = B.backtest(monthly(t), (*BASELINES, ("arima", {"p": 1, "d": 0, "q": 0})), TEST, "M")[0]
    return board.select("series_id", "model_id", near("mae", 2).alias("mae"), near("rmse", 2).alias("rmse"), near("wape", 6).alias("wape"), "rank", "status")


@query("final_forecast", with_ctes("om_board ehf_axis", "SELECT 1").replace("SELECT 1", "") + f"""
SELECT a.series_id, b.model_id, a.step, a.t, {near_sql('''CASE b.model_id WHEN 'naive' THEN n.y WHEN 'seasonal_naive' THEN s.y ELSE m.m END''', 2)} AS predicted
FROM (SELECT series_id, k::BIGINT AS step, (t + k * INTERVAL 1 MONTH)::TIMESTAMP AS t FROM om_rows, generate_series(1, 6) AS g(k) WHERE back = 1) a
JOIN om_board b ON b.series_id = a.series_id AND b.rank = 1
JOIN om_rows n ON n.series_id = a.series_id AND n.back = 1
JOIN om_rows s ON s.series_id = a.series_id AND s.back = 12 - (a.step - 1) % 12
JOIN (SELECT series_id, avg(y) AS m FROM om_rows WHERE back <= 7 GROUP BY 1) m ON m.series_id = a.series_id""")
def _(t):
    p = monthly(t)
    out = B.final_by_series(p, monthly_run(t)[0], BASELINES, 6, "M")
    return out.select("series_id", "model_id", "step", "t", near("predicted", 2).alias("predicted"))


# -- split, metrics, ranking

@query("holdout_split", with_ctes("od_rows", "SELECT series_id, t, back <= 14 AS is_test, CASE WHEN back <= 14 THEN 15 - back END AS step FROM od_rows"))
def _(t):
    return S.holdout_split(daily_grid(t), 14).select("series_id", "t", "is_test", "step")


@query("part_windows", with_ctes("od_rows", """
SELECT series_id, min(t) AS time_start, max(t) AS time_end, min(t) FILTER (back > 14) AS train_start, max(t) FILTER (back > 14) AS train_end,
 min(t) FILTER (back <= 14) AS test_start, max(t) FILTER (back <= 14) AS test_end FROM od_rows GROUP BY 1"""))
def _(t):
    return S.part_windows(S.holdout_split(daily_grid(t), 14))


@query("split_eligible", """
WITH c AS (SELECT 'c' || o_custkey AS series_id, date_trunc('month', o_orderdate) AS t FROM orders GROUP BY 1, 2), n AS (SELECT series_id, count(*) AS points FROM c GROUP BY 1)
SELECT series_id, points, CASE WHEN points < 3 THEN 'fewer than three points' WHEN points <= 10 THEN 'test size not below length' END AS reason,
 (points > 10 AND points - 10 < 30) AS unstable FROM n""")
def _(t):
    from ..operators.rows import bucket_aggregate
    from ..spec import PanelSpec
    o = t.orders.withColumn("series_id", F.concat(F.lit("c"), "o_custkey"))
    return S.split_eligible(bucket_aggregate(o, PanelSpec(("series_id",), "o_orderdate", "o_totalprice", "M"), "sum"), 10)[1]


@query("pair_predictions", with_ctes("od_points", f"SELECT series_id, model_id, step, t, {near_sql('residual', 2)} AS residual, {near_sql('abs_error', 2)} AS abs_error FROM od_points WHERE model_id = 'moving_average'"))
def _(t):
    from ..operators.fill import fill_value
    split = S.holdout_split(fill_value(daily_grid(t), "zero"), 14)
    pred = M.moving_average(split.where(~F.col("is_test")), 14, "D")
    return S.pair_predictions(split.where("is_test"), pred).select("series_id", "model_id", "step", "t", near("residual", 2).alias("residual"), near("abs_error", 2).alias("abs_error"))


@query("error_metrics", with_ctes("eh_metrics", "SELECT series_id, model_id, " + ", ".join(f"{near_sql(m)} AS {m}" for m in S.METRICS) + " FROM eh_metrics"))
def _(t):
    return S.error_metrics(hourly_run(t)[1]).select("series_id", "model_id", *[near(m).alias(m) for m in S.METRICS])


@query("successful_only", with_ctes("eh_points", "SELECT series_id, model_id, count(*) AS n FROM eh_points WHERE NOT (model_id = 'naive' AND series_id IN ('click', 'error')) GROUP BY 1, 2"))
def _(t):
    pts = hourly_run(t)[1]
    broken = (F.col("model_id") == "naive") & (((F.col("series_id") == "click") & (F.col("step") == 7)) | ((F.col("series_id") == "error") & (F.col("step") == 1)))
    pts = pts.withColumn("predicted", F.when(broken & (F.col("series_id") == "click"), float("nan")).otherwise(F.col("predicted"))).where(~(broken & (F.col("series_id") == "error")))
    return S.successful_only(pts, 48).groupBy("series_id", "model_id").agg(F.count("*").alias("n"))


@query("ranked_plus_failed", with_ctes("om_board", """
SELECT series_id, model_id, rank, CASE WHEN rank IS NULL THEN 'failed' ELSE 'success' END AS status, row_number() OVER (PARTITION BY series_id ORDER BY rank NULLS LAST, model_id) AS place
FROM (SELECT series_id, model_id, rank FROM om_board UNION ALL SELECT DISTINCT series_id, 'unavailable', NULL FROM om_board)"""))
def _(t):
    board = monthly_run(t)[0].select("series_id", "model_id", "rank")
    failed = board.where("rank = 1").select("series_id", F.lit("unavailable").alias("model_id"))
    return S.ranked_plus_failed(board, failed)


@query("model_grid", with_ctes("ord_m", """
SELECT s.series_id, m.model_id, m.selection::BIGINT AS selection FROM (SELECT DISTINCT series_id FROM ord_m) s, (VALUES ('naive', 0), ('seasonal_naive', 1), ('moving_average', 2)) m(model_id, selection)"""))
def _(t):
    return B.model_grid(monthly(t).select("series_id").distinct(), BASELINES)


@query("runner_up_gap", with_ctes("om_board", f"""
SELECT a.series_id, a.model_id AS best_model, b.model_id AS runner_up, {near_sql('b.mae - a.mae', 2)} AS mae_gap FROM om_board a JOIN om_board b ON a.series_id = b.series_id AND a.rank = 1 AND b.rank = 2"""))
def _(t):
    return S.runner_up_gap(monthly_run(t)[0]).select("series_id", "best_model", "runner_up", near("mae_gap", 2).alias("mae_gap"))


@query("visible_models", with_ctes("od_board", "SELECT series_id, model_id FROM od_board WHERE rank <= 3"))
def _(t):
    from ..operators.fill import fill_value
    p = fill_value(daily_grid(t), "zero").drop("is_gap")
    return S.visible_models(B.backtest(p, BASELINES, 14, "D")[0], 3).select("series_id", "model_id")


@query("metric_views", with_ctes("om_board", f"""
SELECT series_id, model_id, {near_sql('mae / greatest(max(mae) OVER w, 1)', 6)} AS mae_share, {near_sql('rmse / greatest(max(rmse) OVER w, 1)', 6)} AS rmse_share,
 {near_sql('wape / greatest(max(wape) OVER w, 1)', 6)} AS wape_share,
 CASE WHEN mae = min(mae) OVER w THEN 'best' WHEN mae = max(mae) OVER w THEN 'worst' END AS mae_mark,
 CASE WHEN wape = min(wape) OVER w THEN 'best' WHEN wape = max(wape) OVER w THEN 'worst' END AS wape_mark FROM om_board WINDOW w AS (PARTITION BY series_id)"""))
def _(t):
    board = monthly_run(t)[0]
    a = S.normalise_metrics(board).select("series_id", "model_id", *[near(c, 6).alias(c) for c in ("mae_share", "rmse_share", "wape_share")])
    return a.join(S.metric_extremes(board).select("series_id", "model_id", "mae_mark", "wape_mark"), ["series_id", "model_id"])


# -- residual and series reports

@query("top_residuals", with_ctes("eh_points", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs_error DESC, model_id, t) AS place FROM eh_points)
SELECT series_id, place, model_id, t, {near_sql('residual')} AS residual FROM r WHERE place <= 12""".replace("\n, r AS", ", r AS", 1)))
def _(t):
    return S.top_residuals(hourly_run(t)[1]).select("series_id", "place", "model_id", "t", near("residual").alias("residual"))


@query("largest_residual", with_ctes("eh_points", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, model_id ORDER BY abs_error DESC, t) AS place FROM eh_points)
SELECT series_id, model_id, t, {near_sql('actual')} AS actual, {near_sql('residual')} AS residual FROM r WHERE place = 1""".replace("\n, r AS", ", r AS", 1)))
def _(t):
    return S.largest_residual(hourly_run(t)[1]).select("series_id", "model_id", "t", near("actual").alias("actual"), near("residual").alias("residual"))


@query("seasonality_means", with_ctes("ord_d", f"""
, c AS (SELECT series_id, month(t)::BIGINT AS month, (isodow(t) - 1)::BIGINT AS weekday, avg(y) AS mean, count(*) AS n FROM ord_d GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean DESC, month, weekday) AS place FROM c)
SELECT series_id, month, weekday, {near_sql('mean', 2)} AS mean, n, place FROM r WHERE place <= 12""".replace("\n, c AS", ", c AS", 1)))
def _(t):
    return S.seasonality_means(daily(t)).select("series_id", "month", "weekday", near("mean", 2).alias("mean"), "n", "place")


@query("residual_heatmap", with_ctes("od_points", f"SELECT series_id, (isodow(t) - 1)::BIGINT AS weekday, month(t)::BIGINT AS month, {near_sql('avg(residual)', 2)} AS mean_residual FROM od_points GROUP BY 1, 2, 3"))
def _(t):
    from ..operators.fill import fill_value
    p = fill_value(daily_grid(t), "zero").drop("is_gap")
    return S.residual_heatmap(B.backtest(p, BASELINES, 14, "D")[1]).select("series_id", "weekday", "month", near("mean_residual", 2).alias("mean_residual"))


@query("residual_pattern", with_ctes("eh_points", f"""
SELECT series_id, model_id, count(*) FILTER (residual > 0) AS positive, count(*) FILTER (residual < 0) AS negative, {near_sql('avg(residual) FILTER (step <= 16)')} AS first_third_mean,
 {near_sql('avg(residual) FILTER (step > 32)')} AS last_third_mean, {near_sql('avg(abs_error)')} AS mean_abs_error FROM eh_points GROUP BY 1, 2"""))
def _(t):
    return S.residual_pattern(hourly_run(t)[1]).select("series_id", "model_id", "positive", "negative", *[near(c).alias(c) for c in ("first_third_mean", "last_third_mean", "mean_abs_error")])


@query("forecast_summary", with_ctes("sm_best", f"""
, f AS (SELECT x.series_id, x.step, x.t, level + slope * step AS p, 2 * 1.96 * sqrt(sse / (n - 1)) AS w FROM omf_axis x JOIN sm_best b USING (series_id))
SELECT series_id, count(*) AS horizon, {near_sql('arg_min(p, t)', 1)} AS first_predicted, {near_sql('arg_max(p, t)', 1)} AS last_predicted, {near_sql('min(p)', 1)} AS min_predicted,
 {near_sql('max(p)', 1)} AS max_predicted, {near_sql('avg(p)', 1)} AS avg_predicted, true AS has_interval, {near_sql('avg(w)', 1)} AS avg_interval_width FROM f GROUP BY 1""".replace("\n, f AS", ", f AS", 1)))
def _(t):
    s = S.forecast_summary(M.exp_smoothing(monthly(t), 12, "M"))
    return s.select("series_id", "horizon", *[near(c, 1).alias(c) for c in ("first_predicted", "last_predicted", "min_predicted", "max_predicted", "avg_predicted")],
                    "has_interval", near("avg_interval_width", 1).alias("avg_interval_width"))


@query("timeline", with_ctes("omf_axis", f"""
SELECT series_id, t, 'history' AS part, {near_sql('y', 2)} AS value FROM ord_m
UNION ALL SELECT a.series_id, a.t, 'forecast', {near_sql('e.y', 2)} FROM omf_axis a JOIN omf_end e ON e.series_id = a.series_id AND e.rb = 1"""))
def _(t):
    p = monthly(t)
    return S.timeline(p, M.naive(p, 12, "M")).select("series_id", "t", "part", near("value", 2).alias("value"))


# -- parameter search on the training part of the monthly panel

CTES["cand"] = ("", """SELECT * FROM (VALUES ('moving_average', 1, 7), ('moving_average', 2, 3), ('moving_average', 3, 5), ('moving_average', 4, 14), ('moving_average', 5, 21), ('moving_average', 6, 28),
 ('seasonal_naive', 1, 12), ('seasonal_naive', 2, 6), ('seasonal_naive', 3, 11), ('seasonal_naive', 4, 13), ('seasonal_naive', 5, 24), ('seasonal_naive', 6, 1), ('seasonal_naive', 7, 3)) c(model_id, round, p)""")
CTES["tune_rows"] = ("om_train", "SELECT series_id, t, y, rb FROM om_train")
CTES["tune_size"] = ("tune_rows", f"SELECT series_id, count(*) AS points, least(greatest({TEST}, 4), greatest(4, count(*) // 4)) AS validation FROM tune_rows GROUP BY 1")
CTES["tune_pred"] = ("tune_rows tune_size cand", """
SELECT v.series_id, c.model_id, c.round, c.p, v.rb, v.y AS actual,
 CASE WHEN c.model_id = 'moving_average' THEN (SELECT avg(h.y) FROM tune_rows h WHERE h.series_id = v.series_id AND h.rb > z.validation AND h.rb <= z.validation + c.p)
  ELSE (SELECT max(h.y) FROM tune_rows h WHERE h.series_id = v.series_id AND h.rb = z.validation + c.p - (z.validation - v.rb) % c.p) END AS predicted
FROM tune_rows v JOIN tune_size z ON z.series_id = v.series_id AND v.rb <= z.validation CROSS JOIN cand c""")
CTES["trials"] = ("tune_pred", """
SELECT series_id, model_id, round::BIGINT AS round, p::VARCHAR AS param, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse FROM tune_pred GROUP BY 1, 2, 3, 4""")


def tuned(t):
    train = S.holdout_split(monthly(t), TEST).where(~F.col("is_test")).drop("is_test", "step")
    return B.evaluate_candidates(train, ("moving_average", "seasonal_naive"), TEST, "M")


@query("tuning_split", with_ctes("tune_size", "SELECT series_id, points, validation, points - validation AS n FROM tune_size"))
def _(t):
    train = S.holdout_split(monthly(t), TEST).where(~F.col("is_test"))
    return B.tuning_split(train, TEST).select("series_id", "points", "validation", "n")


@query("candidate_grid", with_ctes("tune_size cand", "SELECT s.series_id, c.model_id, c.round::BIGINT AS round, c.p::VARCHAR AS param FROM tune_size s, cand c"))
def _(t):
    train = S.holdout_split(monthly(t), TEST).where(~F.col("is_test"))
    meta = B.tuning_split(train, TEST).withColumn("freq", F.lit("M"))
    grid = B.candidate_grid(meta, "moving_average").unionByName(B.candidate_grid(meta, "seasonal_naive"))
    return B.dedupe_candidates(grid).select("series_id", "model_id", "round", "param")


@query("evaluate_candidates", with_ctes("trials", f"SELECT series_id, model_id, round, param, {near_sql('mae', 2)} AS mae, {near_sql('rmse', 2)} AS rmse FROM trials"))
def _(t):
    return tuned(t).select("series_id", "model_id", "round", "param", near("mae", 2).alias("mae"), near("rmse", 2).alias("rmse"))


@query("select_candidate", with_ctes("trials", """
SELECT series_id, model_id, round, param, row_number() OVER (PARTITION BY series_id, model_id ORDER BY floor(mae * 100.0::DOUBLE + 0.500001::DOUBLE), round) = 1 AS selected FROM trials"""))
def _(t):
    # to the cent: two windows can give the same MAE up to the order of a sum
    return B.select_candidate(tuned(t).withColumn("mae", near("mae", 2))).select("series_id", "model_id", "round", "param", "selected")


@query("best_so_far", with_ctes("trials", f"""
SELECT series_id, model_id, round, min(m) OVER w AS best_metric,
 coalesce(m < min(m) OVER (PARTITION BY series_id, model_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
FROM (SELECT *, {near_sql('mae', 2)} AS m FROM trials) WINDOW w AS (PARTITION BY series_id, model_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def _(t):
    return S.best_so_far(tuned(t).withColumn("mae", near("mae", 2))).select("series_id", "model_id", "round", "best_metric", "improved")


@query("trial_summary", with_ctes("trials", f"""
SELECT series_id, model_id, count(*) AS trials, count(*) AS succeeded, 0::BIGINT AS failed, {near_sql('arg_min(mae, round)', 2)} AS first_mae, {near_sql('min(mae)', 2)} AS best_mae,
 {near_sql('arg_min(mae, round) - min(mae)', 2)} AS improvement FROM trials GROUP BY 1, 2"""))
def _(t):
    return S.trial_summary(tuned(t)).select("series_id", "model_id", "trials", "succeeded", "failed", *[near(c, 2).alias(c) for c in ("first_mae", "best_mae", "improvement")])
