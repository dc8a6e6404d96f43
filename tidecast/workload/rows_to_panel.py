"""Raw rows to panels: aggregation, duplicates, frequency, grid, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import period_no
from ..operators.diagnostics import cleaning_diagnostics, data_health
from ..operators.fill import reindex, time_index
from ..operators.quantiles import exact_quantiles
from ..operators.rows import (annotate_rows, bucket_aggregate, bucket_covariates, detect_frequency, duplicate_count,
                              fill_rows, resolve_duplicates)
from ..plans.build import build_panel
from ..spec import CleaningConfig, PanelSpec
from .base import CTES, Tables, daily_grid, hourly_grid, near, near_sql, query, with_ctes
from .text_and_time import dirty

EVENTS = PanelSpec(("series_id",), "ts", "value", "H", "event_id")


def events(t: Tables):
    return t.events.withColumnRenamed("event_type", "series_id")


@query("bucket_aggregate", f"""
SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS t, {near_sql('sum(value)')} AS sum_y, {near_sql('avg(value)', 6)} AS mean_y,
 count(value)::DOUBLE AS count_y, max(value) AS max_y, min(value) AS min_y FROM events GROUP BY 1, 2""")
def _(t):
    # the five aggregations side by side; one shuffle each is what a user of a single one pays
    from ..operators.rows import aggregate_of
    from ..functions.calendar import time_bucket
    g = events(t).groupBy("series_id", time_bucket("ts", "H").alias("t"))
    a = g.agg(*[aggregate_of(h, "value").alias(h) for h in ("sum", "mean", "count", "max", "min")])
    return a.select("series_id", "t", near("sum").alias("sum_y"), near("mean", 6).alias("mean_y"),
                    F.col("count").alias("count_y"), F.col("max").alias("max_y"), F.col("min").alias("min_y"))


@query("daily_counts", """
SELECT event_type AS series_id, date_trunc('day', ts)::TIMESTAMP AS t, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2""")
def _(t):
    spec = PanelSpec(("series_id",), "ts", "value", "D", "event_id")
    rows = annotate_rows(events(t), spec, count_mode=True)
    return bucket_aggregate(rows, PanelSpec(("series_id",), "t", "y", "D"), "count")


@query("resolve_duplicates", f"""
SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS t, {near_sql('avg(value)', 6)} AS mean_y,
 arg_min(value, (ts, event_id)) AS first_y, arg_max(value, (ts, event_id)) AS last_y FROM events GROUP BY 1, 2""")
def _(t):
    e = events(t)
    by = ["series_id", "t"]
    mean = resolve_duplicates(e, EVENTS, "mean").select(*by, near("y", 6).alias("mean_y"))
    first = resolve_duplicates(e, EVENTS, "first").withColumnRenamed("y", "first_y")
    last = resolve_duplicates(e, EVENTS, "last").withColumnRenamed("y", "last_y")
    return mean.join(first, by).join(last, by)


@query("bucket_covariates", f"""
SELECT l_returnflag AS series_id, date_trunc('week', l_shipdate)::TIMESTAMP AS t, {near_sql('avg(l_discount)', 6)} AS discount, {near_sql('avg(l_tax)', 6)} AS tax
FROM lineitem GROUP BY 1, 2""")
def _(t):
    spec = PanelSpec(("series_id",), "l_shipdate", "l_quantity", "W")
    out = bucket_covariates(t.lineitem.withColumnRenamed("l_returnflag", "series_id"), spec, ["l_discount", "l_tax"])
    return out.select("series_id", "t", near("l_discount", 6).alias("discount"), near("l_tax", 6).alias("tax"))


@query("duplicate_count", """
SELECT event_type AS series_id, count(*) AS row_count, count(DISTINCT date_trunc('hour', ts)) AS buckets,
 count(*) - count(DISTINCT date_trunc('hour', ts)) AS duplicates FROM events GROUP BY 1""")
def _(t):
    return duplicate_count(events(t), EVENTS)


# series whose gaps are hours, days, weeks, months, quarters, years or irregular, from real order dates
_FREQ_SERIES = """
SELECT 'daily ' || o_orderpriority AS series_id, o_orderdate AS t FROM orders
UNION ALL SELECT 'weekly ' || o_orderpriority, date_trunc('week', o_orderdate)::TIMESTAMP FROM orders
UNION ALL SELECT 'monthly ' || o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP FROM orders
UNION ALL SELECT 'quarterly ' || o_orderpriority, date_trunc('quarter', o_orderdate)::TIMESTAMP FROM orders
UNION ALL SELECT 'yearly ' || o_orderpriority, date_trunc('year', o_orderdate)::TIMESTAMP FROM orders
UNION ALL SELECT 'customer ' || o_custkey, o_orderdate FROM orders
UNION ALL SELECT 'event ' || event_type, ts FROM events
UNION ALL SELECT 'user ' || user_id, ts FROM events"""


@query("detect_frequency", f"""
WITH s AS ({_FREQ_SERIES}),
d AS (SELECT DISTINCT series_id, t FROM s),
g AS (SELECT series_id, epoch(t) - epoch(lag(t) OVER (PARTITION BY series_id ORDER BY t)) AS gap FROM d),
m AS (SELECT series_id, median(gap) AS step, count(gap) AS n FROM g GROUP BY 1)
SELECT series_id, CASE WHEN n = 0 THEN 'D' WHEN step <= 5400 THEN 'H' WHEN step BETWEEN 64800 AND 129600 THEN 'D' WHEN step BETWEEN 475200 AND 734400 THEN 'W'
  WHEN step BETWEEN 2160000 AND 3024000 THEN 'M' WHEN step BETWEEN 6912000 AND 8640000 THEN 'Q' WHEN step BETWEEN 29376000 AND 33696000 THEN 'Y' ELSE 'D' END AS freq,
 (n > 0 AND NOT (step <= 5400 OR step BETWEEN 64800 AND 129600 OR step BETWEEN 475200 AND 734400 OR step BETWEEN 2160000 AND 3024000
   OR step BETWEEN 6912000 AND 8640000 OR step BETWEEN 29376000 AND 33696000)) AS irregular FROM m""")
def _(t):
    row = lambda word, c, time: F.struct(F.concat(F.lit(f"{word} "), F.col(c).cast("string")).alias("series_id"), time.cast("timestamp_ntz").alias("t"))
    day = F.col("o_orderdate")
    own = [row("daily", "o_orderpriority", day), *[row(f"{w}ly", "o_orderpriority", F.date_trunc(w, day)) for w in ("week", "month", "quarter", "year")], row("customer", "o_custkey", day)]
    # every table is read once, each row for all the series it is in
    every = t.orders.select(F.inline(F.array(*own))).unionByName(t.events.select(F.inline(F.array(row("event", "event_type", F.col("ts")), row("user", "user_id", F.col("ts"))))))
    return detect_frequency(every, PanelSpec(("series_id",), "t", None, "D")).select("series_id", "freq", "irregular")


@query("reindex_calendar", with_ctes("ev_grid", f"SELECT series_id, t, {near_sql('y')} AS y, is_gap FROM ev_grid"))
def _(t):
    return hourly_grid(t).select("series_id", "t", near("y").alias("y"), "is_gap")


@query("time_index", with_ctes("ord_grid", "SELECT series_id, t, (row_number() OVER (PARTITION BY series_id ORDER BY t) - 1) AS time_index FROM ord_grid"))
def _(t):
    return time_index(daily_grid(t), "D").select("series_id", "t", "time_index")


@query("user_value_quantiles", f"""
SELECT user_id, {near_sql('quantile_cont(value, 0.5)')} AS median, {near_sql('quantile_cont(value, 0.9)')} AS p90 FROM events GROUP BY 1""")
def _(t):
    found = exact_quantiles(t.events, ["user_id"], "value", (0.5, 0.9))
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("quantile")))
    return found.groupBy("user_id").agg(near(at(0.5)).alias("median"), near(at(0.9)).alias("p90"))


# row-level fill in time order, before bucketing
CTES["fillrows"] = ("", """
SELECT event_id, event_type AS series_id, ts, CASE WHEN event_id % 5 < 2 OR event_id % 113 > 100 THEN NULL ELSE value END AS y,
 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events""")
CTES["fillnext"] = ("fillrows", """
SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(y IGNORE NULLS) OVER p AS pv,
 last_value(CASE WHEN y IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER p AS px,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(y IGNORE NULLS) OVER n AS nv,
 first_value(CASE WHEN y IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER n AS nx FROM fillrows
WINDOW p AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")


@query("fill_raw_rows", with_ctes("fillnext", f"""
SELECT event_id, {near_sql('coalesce(y, pv, nv)')} AS ffilled,
 {near_sql('''CASE WHEN y IS NOT NULL THEN y
  WHEN pi IS NOT NULL AND ni IS NOT NULL AND (i - pi <= 2 OR ni - i <= 2) THEN pv + (nv - pv) * CASE WHEN nx = px THEN 0 ELSE (epoch_us(ts) - px)::DOUBLE / (nx - px) END
  WHEN pi IS NULL AND ni - i <= 2 THEN nv WHEN ni IS NULL AND i - pi <= 2 THEN pv END''')} AS by_time FROM fillnext"""))
def _(t):
    raw = t.events.select(F.col("event_type").alias("series_id"), F.col("ts").alias("t"), "event_id",
                          F.when((F.col("event_id") % 5 >= 2) & (F.col("event_id") % 113 <= 100), F.col("value")).alias("y"))
    spec = PanelSpec(("series_id",), "t", "y", "H", "event_id")
    a = fill_rows(raw, spec, "ffill").select("event_id", near("y").alias("ffilled"))
    b = fill_rows(raw, spec, "time", 2).select("event_id", near("y").alias("by_time"))
    return a.join(b, "event_id")


# the dirty rows built into a daily panel with conservative cleaning
DIRTY = PanelSpec(("series_id",), "time_text", "value_text", "D", "event_id")
CTES["dirty_p"] = ("parsed", "SELECT series_id, date_trunc('day', value)::TIMESTAMP AS t, avg(y) AS y FROM parsed WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2")
CTES["dirty_q"] = ("dirty_p", "SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY series_id) AS q1, quantile_cont(y, 0.75) OVER (PARTITION BY series_id) AS q3 FROM dirty_p")
CTES["dirty_diag"] = ("parsed dirty_q", """
SELECT r.series_id, r.original_rows, p.valid_points, r.original_rows - r.used AS dropped_rows, r.used - p.valid_points AS duplicate_time,
 p.span - p.valid_points AS missing_time, r.invalid_time, r.missing_target, r.invalid_target, 0::BIGINT AS filled, p.outliers, 0::BIGINT AS outliers_adjusted, p.time_start, p.time_end
FROM (SELECT series_id, count(*) AS original_rows, count(*) FILTER (value IS NULL) AS invalid_time,
  count(*) FILTER (value IS NOT NULL AND v IS NULL) AS missing_target, count(*) FILTER (value IS NOT NULL AND v IS NOT NULL AND y IS NULL) AS invalid_target,
  count(*) FILTER (value IS NOT NULL AND y IS NOT NULL) AS used FROM parsed GROUP BY 1) r
JOIN (SELECT series_id, count(*) AS valid_points, datediff('day', min(t), max(t)) + 1 AS span, min(t) AS time_start, max(t) AS time_end,
  count(*) FILTER (q3 > q1 AND (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1))) AS outliers FROM dirty_q GROUP BY 1) p USING (series_id)""")


def dirty_panel(t):
    cfg = CleaningConfig(missing="drop", limit=None, fill_steps=False)
    return build_panel(dirty(t), DIRTY, cfg)


@query("cleaning_diagnostics", with_ctes("dirty_diag", "SELECT * FROM dirty_diag"))
def _(t):
    return dirty_panel(t).diagnostics


@query("data_health", with_ctes("dirty_diag", """
, h AS (SELECT *, greatest(valid_points - least(14, valid_points), 0) AS train_points, least(14, valid_points) AS test_points,
 round_even(invalid_time / greatest(original_rows, 1)::DOUBLE, 4) AS invalid_time_rate,
 round_even((missing_target + invalid_target) / greatest(original_rows, 1)::DOUBLE, 4) AS target_missing_rate,
 round_even(duplicate_time / greatest(valid_points, 1)::DOUBLE, 4) AS duplicate_time_rate,
 round_even(missing_time / greatest(valid_points + missing_time, 1)::DOUBLE, 4) AS missing_time_rate,
 round_even(outliers / greatest(valid_points, 1)::DOUBLE, 4) AS outlier_rate,
 round_even(valid_points / greatest(valid_points + missing_time, 1)::DOUBLE, 4) AS continuity FROM dirty_diag),
s AS (SELECT *, train_points >= 42 AS train_sufficient, (test_points >= 3 AND test_points <= greatest(8, valid_points // 3)) AS test_reasonable FROM h),
c AS (SELECT *, greatest(0, least(100, 100 - round_even(invalid_time_rate * 500, 0) - round_even(target_missing_rate * 400, 0) - round_even(duplicate_time_rate * 300, 0) - round_even(outlier_rate * 200, 0)
 - CASE WHEN missing_time > 0 THEN least(15, greatest(5, round_even(missing_time_rate * 100, 0))) ELSE 0 END
 - CASE WHEN valid_points < 30 THEN 20 WHEN NOT train_sufficient THEN 10 ELSE 0 END - CASE WHEN test_reasonable THEN 0 ELSE 8 END))::BIGINT AS score FROM s)
SELECT series_id, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS level,
 invalid_time_rate, target_missing_rate, duplicate_time_rate, missing_time_rate, outlier_rate, continuity, train_sufficient, test_reasonable,
 ((invalid_time > 0)::BIGINT + (missing_target + invalid_target > 0)::BIGINT + (duplicate_time > 0)::BIGINT + (missing_time > 0)::BIGINT + (outliers > 0)::BIGINT
  + (valid_points < 30)::BIGINT + (valid_points >= 30 AND NOT train_sufficient)::BIGINT + (NOT test_reasonable)::BIGINT) AS warning_count FROM c""".replace("\n, h AS", ", h AS", 1)))
def _(t):
    h = data_health(dirty_panel(t).diagnostics, 14, 14)
    return h.select("series_id", "score", "level", "invalid_time_rate", "target_missing_rate", "duplicate_time_rate", "missing_time_rate",
                    "outlier_rate", "continuity", "train_sufficient", "test_reasonable", F.size("warnings").alias("warning_count"))


# the standard build: time interpolation of rows, then of days, then the Hampel filter

def _near_cte(source: str) -> str:
    return f"""SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER p AS px,
 last_value(y IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER n AS nx,
 first_value(y IGNORE NULLS) OVER n AS nv FROM {source} WINDOW p AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


_FILLED = """CASE WHEN y IS NOT NULL THEN y WHEN pi IS NOT NULL AND ni IS NOT NULL AND (i - pi <= 7 OR ni - i <= 7)
 THEN pv + (nv - pv) * CASE WHEN nx = px THEN 0 ELSE (x - px)::DOUBLE / (nx - px) END WHEN pi IS NULL AND ni - i <= 7 THEN nv WHEN ni IS NULL AND i - pi <= 7 THEN pv END"""
_FRAME = "(PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"

CTES["std_rows"] = ("parsed", "SELECT series_id, value AS t, y, epoch_us(value) AS x, row_number() OVER (PARTITION BY series_id ORDER BY value, event_id) AS i FROM parsed WHERE value IS NOT NULL")
CTES["std_near"] = ("std_rows", _near_cte("std_rows"))
CTES["std_day"] = ("std_near", f"SELECT series_id, date_trunc('day', t)::TIMESTAMP AS t, avg({_FILLED}) AS y, count({_FILLED}) AS used_rows FROM std_near WHERE ({_FILLED}) IS NOT NULL GROUP BY 1, 2")
CTES["std_axis"] = ("std_day", "SELECT series_id, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM std_day GROUP BY 1")
CTES["std_grid"] = ("std_axis", "SELECT a.series_id, a.t, d.y, d.used_rows, d.t IS NULL AS is_gap, epoch_us(a.t) AS x, row_number() OVER (PARTITION BY a.series_id ORDER BY a.t) AS i FROM std_axis a LEFT JOIN std_day d ON d.series_id = a.series_id AND d.t = a.t")
CTES["std_grid_near"] = ("std_grid", _near_cte("std_grid"))
CTES["std_full"] = ("std_grid_near", f"SELECT series_id, t, {_FILLED} AS y, used_rows, is_gap FROM std_grid_near WHERE ({_FILLED}) IS NOT NULL")
CTES["std_a"] = ("std_full", f"SELECT *, CASE WHEN count(y) OVER f >= 3 THEN quantile_cont(y, 0.5) OVER f END AS med FROM std_full WINDOW f AS {_FRAME}")
CTES["std_b"] = ("std_a", "SELECT *, abs(y - med) AS dev FROM std_a")
CTES["std_c"] = ("std_b", f"SELECT *, 1.4826 * 3.0 * CASE WHEN count(dev) OVER f >= 3 THEN quantile_cont(dev, 0.5) OVER f END AS cut FROM std_b WINDOW f AS {_FRAME}")


@query("build_panel_standard", with_ctes("std_c", f"""
SELECT series_id, t, {near_sql('CASE WHEN cut > 1e-9 AND dev > cut THEN med ELSE y END', 3)} AS y, used_rows, is_gap, coalesce(cut > 1e-9 AND dev > cut, false) AS is_outlier FROM std_c"""))
def _(t):
    """Row-level and grid-level time interpolation plus Hampel, end to end."""
    cfg = CleaningConfig(missing="time", limit=7, outliers="hampel")
    p = build_panel(dirty(t), DIRTY, cfg).panel
    return p.select("series_id", "t", near("y", 3).alias("y"), "used_rows", "is_gap", "is_outlier")
