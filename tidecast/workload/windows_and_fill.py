"""Features, fills and outliers over the series of a panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import (chunked_features, feature_matrix, lag_features, leakage_checks, matrix_profile, position,
                                  rolling_features, trim_warmup)
from ..operators.fill import fill_forward_back, fill_value, interpolate
from ..operators.outliers import hampel, iqr_outliers, period_change, zscore_anomalies
from .base import CTES, daily_grid, hourly, hourly_grid, hourly_zero, near, near_sql, query, weekly, with_ctes

W_ = "(PARTITION BY series_id ORDER BY t"

CTES["features"] = ("ev_zero", f"""
SELECT series_id, t, y, row_number() OVER {W_}) - 1 AS time_index,
 lag(y, 1) OVER {W_}) AS lag_1, lag(y, 2) OVER {W_}) AS lag_2, lag(y, 3) OVER {W_}) AS lag_3, lag(y, 7) OVER {W_}) AS lag_7,
 avg(y) OVER {W_} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mean_3, avg(y) OVER {W_} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
 coalesce(stddev_pop(y) OVER {W_} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS rolling_std_7 FROM ev_zero""")
NAMES = ["lag_1", "lag_2", "lag_3", "lag_7", "rolling_mean_3", "rolling_mean_7", "rolling_std_7"]


@query("lag_features", with_ctes("features", "SELECT series_id, t, " + ", ".join(f"{near_sql(n)} AS {n}" for n in NAMES[:4]) + " FROM features"))
def _(t):
    return lag_features(hourly_zero(t)).select("series_id", "t", *[near(n).alias(n) for n in NAMES[:4]])


@query("rolling_features", with_ctes("features", "SELECT series_id, t, " + ", ".join(f"{near_sql(n)} AS {n}" for n in NAMES[4:]) + " FROM features"))
def _(t):
    return rolling_features(hourly_zero(t)).select("series_id", "t", *[near(n).alias(n) for n in NAMES[4:]])


@query("chunked_features", with_ctes("features", "SELECT series_id, t, " + ", ".join(f"{near_sql(n)} AS {n}" for n in NAMES) + " FROM features"))
def _(t):
    return chunked_features(hourly_zero(t), "H", chunk=128).select("series_id", "t", *[near(n).alias(n) for n in NAMES])


@query("feature_matrix", with_ctes("features", "SELECT series_id, t, time_index, " + ", ".join(f"{near_sql(n)} AS {n}" for n in NAMES)
       + ", (isodow(t) - 1)::DOUBLE AS day_of_week, month(t)::DOUBLE AS month FROM features WHERE time_index >= 7"))
def _(t):
    m, _ = feature_matrix(hourly_zero(t))
    return m.select("series_id", "t", "time_index", *[near(n).alias(n) for n in NAMES], "day_of_week", "month")


@query("trim_warmup", with_ctes("features", "SELECT series_id, count(*) AS n, min(time_index) AS first_index FROM features WHERE time_index >= 7 GROUP BY 1"))
def _(t):
    return trim_warmup(position(hourly_zero(t))).groupBy("series_id").agg(F.count("*").alias("n"), F.min("time_index").alias("first_index"))


@query("matrix_profile", with_ctes("features", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count({n}) AS non_null, count(*) - count({n}) AS nulls, {near_sql(f'min({n})')} AS minimum, {near_sql(f'max({n})')} AS maximum, "
    f"{near_sql(f'avg({n})')} AS mean, {near_sql(f'stddev_pop({n})')} AS std FROM features" for n in NAMES)))
def _(t):
    m = rolling_features(lag_features(hourly_zero(t)))
    return matrix_profile(m, NAMES).select("feature", "non_null", "nulls", *[near(c).alias(c) for c in ("minimum", "maximum", "mean", "std")])


@query("leakage_checks", with_ctes("features", "SELECT count(*) AS checked_rows, 0::BIGINT AS not_increasing, 0::BIGINT AS not_finite, 0::BIGINT AS missing_target FROM features WHERE time_index >= 7"))
def _(t):
    m, names = feature_matrix(hourly_zero(t))
    return leakage_checks(m, names)


# -- fills

CTES["gaps"] = ("ev_grid", f"SELECT series_id, t, y, row_number() OVER {W_}) AS i FROM ev_grid")
CTES["gap_ends"] = ("gaps", """
SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(y IGNORE NULLS) OVER p AS pv,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(y IGNORE NULLS) OVER n AS nv FROM gaps
WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")


@query("fill_forward_back", with_ctes("gap_ends", f"SELECT series_id, t, {near_sql('coalesce(y, pv, nv)')} AS ffilled, {near_sql('coalesce(y, nv, pv)')} AS bfilled FROM gap_ends"))
def _(t):
    g = hourly_grid(t)
    a = fill_forward_back(g, "ffill").select("series_id", "t", near("y").alias("ffilled"))
    return a.join(fill_forward_back(g, "bfill").select("series_id", "t", near("y").alias("bfilled")), ["series_id", "t"])


@query("interpolate_linear", with_ctes("gap_ends", f"""SELECT series_id, t, {near_sql('''CASE WHEN y IS NOT NULL THEN y
 WHEN pi IS NOT NULL AND ni IS NOT NULL AND (i - pi <= 1 OR ni - i <= 1) THEN pv + (nv - pv) * (i - pi)::DOUBLE / (ni - pi)
 WHEN pi IS NULL AND ni - i <= 1 THEN nv WHEN ni IS NULL AND i - pi <= 1 THEN pv END''')} AS y FROM gap_ends"""))
def _(t):
    return interpolate(hourly_grid(t), limit=1).select("series_id", "t", near("y").alias("y"))


# irregular months: interpolation weighted by days differs from interpolation by position
CTES["ship_m"] = ("", "SELECT l_linestatus AS series_id, date_trunc('month', l_shipdate)::TIMESTAMP AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2")
CTES["ship_gap"] = ("ship_m", "SELECT series_id, t, CASE WHEN month(t) NOT IN (2, 3, 8) THEN q END AS y FROM ship_m")
CTES["ship_ends"] = ("ship_gap", """
SELECT *, epoch(t) AS x, last_value(CASE WHEN y IS NOT NULL THEN epoch(t) END IGNORE NULLS) OVER p AS px, last_value(y IGNORE NULLS) OVER p AS pv,
 first_value(CASE WHEN y IS NOT NULL THEN epoch(t) END IGNORE NULLS) OVER n AS nx, first_value(y IGNORE NULLS) OVER n AS nv FROM ship_gap
WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")


@query("interpolate_time", with_ctes("ship_ends", f"""SELECT series_id, t, {near_sql('''CASE WHEN y IS NOT NULL THEN y
 WHEN px IS NOT NULL AND nx IS NOT NULL THEN pv + (nv - pv) * (x - px) / (nx - px) ELSE coalesce(nv, pv) END''', 3)} AS y FROM ship_ends"""))
def _(t):
    from ..operators.rows import bucket_aggregate
    from ..spec import PanelSpec
    p = bucket_aggregate(t.lineitem.withColumnRenamed("l_linestatus", "series_id"), PanelSpec(("series_id",), "l_shipdate", "l_quantity", "M"), "sum")
    holes = p.withColumn("y", F.when(~F.month("t").isin(2, 3, 8), F.col("y")))
    return interpolate(holes, by="time").select("series_id", "t", near("y", 3).alias("y"))


@query("fill_constant_median", with_ctes("ev_grid", f"""
SELECT series_id, t, {near_sql('coalesce(y, 0)')} AS zero, {near_sql('coalesce(y, median(y) OVER (PARTITION BY series_id))')} AS med FROM ev_grid"""))
def _(t):
    g = hourly_grid(t).withColumn("zero", F.col("y"))
    g = fill_value(fill_value(g, "median"), "zero", "zero")
    return g.select("series_id", "t", near("zero").alias("zero"), near("y").alias("med"))


# -- outliers

CTES["hampel_a"] = ("ev_h", """SELECT *, CASE WHEN count(y) OVER f >= 3 THEN quantile_cont(y, 0.5) OVER f END AS med FROM ev_h
WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
CTES["hampel_b"] = ("hampel_a", "SELECT *, abs(y - med) AS dev FROM hampel_a")
CTES["hampel_c"] = ("hampel_b", """SELECT *, 1.4826 * 3.0 * CASE WHEN count(dev) OVER f >= 3 THEN quantile_cont(dev, 0.5) OVER f END AS cut FROM hampel_b
WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")


@query("hampel_filter", with_ctes("hampel_c", f"""SELECT series_id, t, {near_sql('CASE WHEN cut > 0 AND dev > cut THEN med ELSE y END')} AS y,
 coalesce(cut > 0 AND dev > cut, false) AS is_outlier FROM hampel_c"""))
def _(t):
    return hampel(hourly(t)).select("series_id", "t", near("y").alias("y"), "is_outlier")


@query("iqr_outliers", with_ctes("ev_h", f"""
, q AS (SELECT *, quantile_cont(y, 0.25) OVER p AS q1, quantile_cont(y, 0.75) OVER p AS q3 FROM ev_h WINDOW p AS (PARTITION BY series_id))
SELECT series_id, t, {near_sql('greatest(least(y, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1))')} AS y,
 (y > q3 + 1.5 * (q3 - q1) OR y < q1 - 1.5 * (q3 - q1)) AS is_outlier FROM q""".replace("\n, q AS", ", q AS", 1)))
def _(t):
    return iqr_outliers(hourly(t), clip=True).select("series_id", "t", near("y").alias("y"), "is_outlier")


@query("zscore_anomalies", with_ctes("ev_h", f"""
, z AS (SELECT *, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS zscore FROM ev_h WINDOW p AS (PARTITION BY series_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(zscore) DESC, t) AS place FROM z WHERE abs(zscore) >= 2)
SELECT series_id, t, {near_sql('y')} AS y, {near_sql('zscore')} AS zscore, place FROM r WHERE place <= 12""".replace("\n, z AS", ", z AS", 1)))
def _(t):
    return zscore_anomalies(hourly(t)).select("series_id", "t", near("y").alias("y"), near("zscore").alias("zscore"), "place")


@query("period_change", with_ctes("ev_zero", f"""
, c AS (SELECT *, lag(y) OVER {W_}) AS p FROM ev_zero),
d AS (SELECT *, (y - p) / abs(p) AS change FROM c WHERE p <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(change) DESC, t) AS place FROM d)
SELECT series_id, t, {near_sql('change')} AS change, place FROM r WHERE place <= 10""".replace("\n, c AS", ", c AS", 1)))
def _(t):
    return period_change(hourly_zero(t)).select("series_id", "t", near("change").alias("change"), "place")
