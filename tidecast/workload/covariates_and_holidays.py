"""Covariates, holidays, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariates as V
from ..operators import forecasters as M
from ..operators import holidays as H
from ..operators import scenario as N
from ..operators.rows import annotate_rows
from ..operators.scoring import holdout_split
from ..spec import CovariateRole, PanelSpec
from .base import CTES, daily, monthly, near, near_sql, query, weekly, with_ctes
from .models_and_scores import hourly_run, monthly_run

# -- a holiday calendar taken from the order dates: two countries, fixed month-days

DAYS = {"01-01": "new year", "05-01": "labour day", "10-01": "autumn day", "12-25": "winter day"}
_names = " ".join(f"WHEN '{d}' THEN '{n}'" for d, n in DAYS.items())
CTES["holidays"] = ("", f"""
SELECT c.country, d.day AS date, CASE strftime(d.day, '%m-%d') {_names} END AS name FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) d, (VALUES ('AA'), ('BB')) c(country)
WHERE strftime(d.day, '%m-%d') IN ('05-01', '12-25') OR (c.country = 'AA' AND strftime(d.day, '%m-%d') IN ('01-01', '10-01'))""")
CTES["od_country"] = ("ord_d", "SELECT series_id, t, y, CASE WHEN series_id < '4' THEN 'AA' ELSE 'BB' END AS country FROM ord_d")
CTES["sw_country"] = ("ship_w", "SELECT series_id, t, y, CASE WHEN series_id = 'A' THEN 'AA' ELSE 'BB' END AS country FROM ship_w")


def calendar(t):
    md = F.date_format("date", "MM-dd")
    names = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("date")).distinct().where(md.isin(*DAYS))
    both = days.withColumn("country", F.explode(F.array(F.lit("AA"), F.lit("BB"))))
    return both.where((F.col("country") == "AA") | md.isin("05-01", "12-25")).withColumn("name", names[md])


def daily_country(t):
    return daily(t).withColumn("country", F.when(F.col("series_id") < "4", "AA").otherwise("BB"))


def weekly_country(t):
    return weekly(t).withColumn("country", F.when(F.col("series_id") == "A", "AA").otherwise("BB"))


@query("holiday_range", with_ctes("sw_country holidays", """
, c AS (SELECT p.series_id, p.t, (SELECT count(*) FROM holidays h WHERE h.country = p.country AND h.date >= p.t::DATE AND h.date < p.t::DATE + 7) AS n FROM sw_country p)
SELECT series_id, t, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS holiday_is_period, n::DOUBLE AS holiday_count FROM c""".replace("\n, c AS", ", c AS", 1)))
def _(t):
    return H.holiday_range(weekly_country(t), calendar(t), "W", ["country"]).select("series_id", "t", "holiday_is_period", "holiday_count")


@query("holiday_distance", with_ctes("od_country holidays", """
, c AS (SELECT p.series_id, p.t, coalesce(least(p.t::DATE - (SELECT max(date) FROM holidays h WHERE h.country = p.country AND h.date <= p.t::DATE), 366), 366) AS a,
 coalesce(least((SELECT min(date) FROM holidays h WHERE h.country = p.country AND h.date >= p.t::DATE) - p.t::DATE, 366), 366) AS b FROM od_country p)
SELECT series_id, t, a::DOUBLE AS holiday_days_since_previous, b::DOUBLE AS holiday_days_to_next, CASE WHEN least(a, b) <= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS holiday_is_window FROM c""".replace("\n, c AS", ", c AS", 1)))
def _(t):
    return H.holiday_distance(daily_country(t), calendar(t), 2, "D", ["country"]).select("series_id", "t", *H.FEATURES[2:])


@query("holiday_markers", with_ctes("od_country holidays", """
, r AS (SELECT series_id, country, min(t) AS a, max(t) AS z FROM od_country GROUP BY 1, 2)
SELECT r.series_id, r.country, h.date::TIMESTAMP AS t, h.name FROM r JOIN holidays h ON h.country = r.country AND h.date >= r.a AND h.date <= r.z""".replace("\n, r AS", ", r AS", 1)))
def _(t):
    return H.holiday_markers(daily_country(t), calendar(t), "D", ["country"])


# -- covariates of the weekly shipments: the last eight weeks have no target yet

CTES["sw_flag"] = ("ship_w", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) > 8 AS known FROM ship_w")
ROLES = [CovariateRole("discount", "static", "historical_mean"), CovariateRole("tax", "static", "use_test_values"),
         CovariateRole("load", "known_future"), CovariateRole("Is Weekend", "known_future"), CovariateRole("month", "known_future")]


def parts(t):
    """(history, test) of the weekly panel with a made-up known input called load."""
    p = weekly(t).withColumn("load", F.when(F.weekofyear("t") != 40, F.col("discount") * 100))
    s = holdout_split(p, 8)
    return s.where(~F.col("is_test")), s.where("is_test")


CTES["sw_long"] = ("sw_flag", """
SELECT series_id, t, known, 'discount' AS name, discount AS value FROM sw_flag UNION ALL SELECT series_id, t, known, 'tax', tax FROM sw_flag
UNION ALL SELECT series_id, t, known, 'load', CASE WHEN weekofyear(t) <> 40 THEN discount * 100 END FROM sw_flag""")
CTES["sw_past"] = ("sw_long", "SELECT series_id, name, arg_max(value, t) AS last, avg(value) AS mean FROM sw_long WHERE known GROUP BY 1, 2")


@query("attach_covariates", with_ctes("ship_w", f"SELECT series_id, t, {near_sql('y')} AS y, {near_sql('discount', 6)} AS discount, {near_sql('tax', 6)} AS tax FROM ship_w"))
def _(t):
    w = weekly(t)
    joined = V.attach_covariates(w.select("series_id", "t", "y"), w.select("series_id", "t", "discount", "tax"))
    return joined.select("series_id", "t", near("y").alias("y"), near("discount", 6).alias("discount"), near("tax", 6).alias("tax"))


@query("historical_mean", with_ctes("sw_past", f"SELECT series_id, name, {near_sql('mean', 6)} AS mean FROM sw_past"))
def _(t):
    past, _ = parts(t)
    return V.historical_mean(V.to_long(past, ["discount", "tax", "load"])).select("series_id", "name", near("mean", 6).alias("mean"))


@query("future_covariates", with_ctes("sw_flag sw_past sw_long", f"""
, ax AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) AS step FROM sw_flag WHERE NOT known),
v AS (SELECT a.series_id, a.step, a.t, p.name, CASE p.name WHEN 'discount' THEN p.mean WHEN 'tax' THEN o.value ELSE o.value END AS value
 FROM ax a JOIN sw_past p USING (series_id) JOIN sw_long o ON o.series_id = a.series_id AND o.t = a.t AND o.name = p.name
 UNION ALL SELECT series_id, step, t, 'Is Weekend', CASE WHEN isodow(t) >= 6 THEN 1.0 ELSE 0.0 END FROM ax
 UNION ALL SELECT series_id, step, t, 'month', month(t) FROM ax)
SELECT series_id, step, t, name, {near_sql('value', 6)} AS value, value IS NULL AS missing FROM v""".replace("\n, ax AS", ", ax AS", 1)))
def _(t):
    past, test = parts(t)
    seen = test.select("series_id", "step", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("tax", "load")])).alias("c")).select("series_id", "step", "c.*")
    out = V.future_covariates(V.to_long(past, ["discount", "tax", "load"]), test.select("series_id", "step", "t"), ROLES, "backtest", seen)
    return out.select("series_id", "step", "t", "name", near("value", 6).alias("value"), "missing")


@query("covariate_roles", with_ctes("sw_long", """
SELECT series_id, name, count(*) AS points, count(*) FILTER (value IS NULL) AS missing,
 CASE WHEN name = 'load' THEN 'known_future' ELSE 'static' END AS kind, CASE WHEN name = 'load' THEN 'use_future_rows' ELSE 'repeat_last_known' END AS forecast_strategy,
 CASE name WHEN 'load' THEN 'use_test_timeline' WHEN 'tax' THEN 'use_test_values' ELSE 'historical_mean' END AS backtest_strategy, name = 'tax' AS leakage_risk FROM sw_long GROUP BY 1, 2"""))
def _(t):
    past, test = parts(t)
    long = V.to_long(past.unionByName(test), ["discount", "tax", "load"])
    return V.covariate_roles(long, ROLES).drop("note")


@query("leakage_count", with_ctes("sw_long", "SELECT series_id, count(DISTINCT name) AS covariates, count(DISTINCT name) FILTER (name = 'tax') AS at_risk FROM sw_long GROUP BY 1"))
def _(t):
    past, test = parts(t)
    return V.leakage_count(V.covariate_roles(V.to_long(past.unionByName(test), ["discount", "tax", "load"]), ROLES))


@query("future_rows", f"""
WITH e AS (SELECT event_type AS series_id, ts, value, CASE WHEN date_trunc('day', ts) >= TIMESTAMP '2024-01-25' THEN NULL ELSE value END AS y FROM events),
h AS (SELECT series_id, max(date_trunc('day', ts)) AS z FROM e WHERE y IS NOT NULL GROUP BY 1)
SELECT e.series_id, date_trunc('day', ts)::TIMESTAMP AS t, {near_sql('avg(e.value)', 6)} AS value FROM e JOIN h USING (series_id) WHERE y IS NULL AND ts > z GROUP BY 1, 2""")
def _(t):
    e = t.events.select(F.col("event_type").alias("series_id"), "ts", "event_id", "value",
                        F.when(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"), F.col("value")).alias("target"))
    spec = PanelSpec(("series_id",), "ts", "target", "D", "event_id")
    out = V.future_rows(annotate_rows(e, spec, keep=("value",)), spec, ["value"])
    return out.select("series_id", "t", near("value", 6).alias("value"))


# -- scenarios on the monthly forecast and the hourly back-test

@query("scenarios", with_ctes("sm_best", " UNION ALL ".join(
    f"SELECT x.series_id, x.step, '{n}' AS scenario, {near_sql(f'(level + slope * step) * {f}', 1)} AS scenario_value FROM omf_axis x JOIN sm_best b USING (series_id)"
    for n, f in (("baseline", "1.0::DOUBLE"), ("upside", "1.08::DOUBLE"), ("downside", "0.92::DOUBLE")))))
def _(t):
    return N.scenarios(M.exp_smoothing(monthly(t), 12, "M")).select("series_id", "step", "scenario", near("scenario_value", 1).alias("scenario_value"))


@query("residual_band", with_ctes("om_points omf_axis omf_end", f"""
, d AS (SELECT series_id, stddev_pop(abs_error) AS s FROM om_points WHERE model_id = 'naive' GROUP BY 1)
SELECT a.series_id, a.step, {near_sql('e.y - d.s', 1)} AS p10, {near_sql('e.y', 1)} AS p50, {near_sql('e.y + d.s', 1)} AS p90
FROM omf_axis a JOIN omf_end e ON e.series_id = a.series_id AND e.rb = 1 JOIN d ON d.series_id = a.series_id""".replace("\n, d AS", ", d AS", 1)))
def _(t):
    out = N.residual_band(M.naive(monthly(t), 12, "M"), monthly_run(t)[1])
    return out.select("series_id", "step", *[near(c, 1).alias(c) for c in ("p10", "p50", "p90")])


@query("residual_histogram", with_ctes("eh_points", "SELECT series_id, model_id, floor(residual * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS residual, count(*) AS n FROM eh_points GROUP BY 1, 2, 3"))
def _(t):
    return N.residual_histogram(hourly_run(t)[1])


@query("chart_wide", with_ctes("eh_points", f"""
SELECT series_id, t, {near_sql("max(predicted) FILTER (model_id = 'naive')")} AS naive, {near_sql("max(predicted) FILTER (model_id = 'seasonal_naive')")} AS seasonal_naive,
 {near_sql("max(predicted) FILTER (model_id = 'moving_average')")} AS moving_average FROM eh_points GROUP BY 1, 2"""))
def _(t):
    wide = N.chart_wide(hourly_run(t)[1], models=["naive", "seasonal_naive", "moving_average"])
    return wide.select("series_id", "t", *[near(m).alias(m) for m in ("naive", "seasonal_naive", "moving_average")])


@query("recommendation", with_ctes("om_board", f"""
, m AS (SELECT series_id, model_id, rank, {near_sql('mae', 2)} AS mae FROM om_board)
SELECT a.series_id, a.model_id, b.model_id AS runner_up, {near_sql('b.mae - a.mae', 2)} AS mae_gap, 3 + (b.mae > a.mae)::BIGINT AS reasons, (b.mae = a.mae)::BIGINT AS caveats
FROM m a JOIN m b ON a.series_id = b.series_id AND a.rank = 1 AND b.rank = 2""".replace("\n, m AS", ", m AS", 1)))
def _(t):
    r = N.recommendation(monthly_run(t)[0].withColumn("mae", near("mae", 2)))
    return r.select("series_id", "model_id", "runner_up", near("mae_gap", 2).alias("mae_gap"), F.size("reasons").alias("reasons"), F.size("caveats").alias("caveats"))


# seconds of a model run, from its place in the selection
_FIT = "(selection + 1) * 0.25"


@query("model_costs", with_ctes("eh_board", f"""
SELECT series_id, model_id, {near_sql('(selection + 1) * 0.25 + 0.125')} AS seconds, {near_sql('mae')} AS mae, {near_sql('greatest(8, 36 - least(mae * 5, 24))')} AS size FROM eh_board"""))
def _(t):
    board = hourly_run(t)[0].withColumns({"fit_seconds": F.expr(_FIT).cast("double"), "predict_seconds": F.lit(0.125)})
    gaps = N.model_gap_table(board)
    pts = N.cost_error_points(gaps)
    return pts.select("series_id", "model_id", near("seconds").alias("seconds"), near("mae").alias("mae"), near("size").alias("size"))
