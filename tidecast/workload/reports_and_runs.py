"""Run histories derived from events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators.scoring import holdout_split, part_windows, suite_summary
from .base import CTES, hourly, hourly_zero, monthly, near, near_sql, query, with_ctes
from .models_and_scores import hourly_run, monthly_run
from .rows_to_panel import dirty_panel

# -- run events: a user is a run, an event type a model

_STAGE = "CASE event_id % 6 WHEN 0 THEN 'loading' WHEN 1 THEN 'cleaning' WHEN 2 THEN 'feature_engineering' WHEN 3 THEN 'training' WHEN 4 THEN 'forecast' ELSE 'finished' END"
_STATUS = "CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 6 = 5 THEN 'success' ELSE 'running' END"
CTES["rev"] = ("", f"""
SELECT 'run' || user_id AS run_id, event_id AS sequence, ts, 'y' || (event_id % 2) AS target, event_type AS model_id, {_STAGE} AS stage, {_STATUS} AS status,
 CASE WHEN event_id % 6 = 3 THEN value / 10 END AS fit_seconds, CASE WHEN event_id % 6 = 4 THEN value / 100 END AS predict_seconds FROM events""")


def run_events(t):
    return t.events.selectExpr(
        "concat('run', user_id) AS run_id", "event_id AS sequence", "ts", "concat('y', event_id % 2) AS target", "event_type AS model_id",
        f"{_STAGE} AS stage", f"{_STATUS} AS status", "IF(event_id % 6 = 3, value / 10, NULL) AS fit_seconds", "IF(event_id % 6 = 4, value / 100, NULL) AS predict_seconds")


CTES["state"] = ("rev", """
SELECT run_id, target, model_id, max(sequence) AS sequence, arg_max(stage, sequence) AS stage, arg_max(status, sequence) AS status,
 arg_max(fit_seconds, sequence) FILTER (fit_seconds IS NOT NULL) AS fit_seconds, arg_max(predict_seconds, sequence) FILTER (predict_seconds IS NOT NULL) AS predict_seconds FROM rev GROUP BY 1, 2, 3""")


@query("latest_model_state", with_ctes("state", f"SELECT *, {near_sql('coalesce(fit_seconds, 0) + coalesce(predict_seconds, 0)', 6)} AS elapsed FROM state"))
def _(t):
    s = R.latest_model_state(run_events(t))
    return s.drop("ts").withColumn("elapsed", near("elapsed", 6))


@query("completed_models", with_ctes("state", "SELECT run_id, count(*) AS models, count(*) FILTER (status IN ('success', 'failed')) AS completed FROM state GROUP BY 1"))
def _(t):
    return R.completed_models(run_events(t))


@query("events_after", with_ctes("rev", "SELECT run_id, sequence, stage, status FROM rev WHERE sequence > 500"))
def _(t):
    return R.events_after(run_events(t), 500).select("run_id", "sequence", "stage", "status")


_seen = ("loading", "cleaning", "feature_engineering", "training", "forecast", "finished")


@query("stage_durations", with_ctes("rev", f"""
, o AS (SELECT *, list_position({list(R.STAGES)!r}, stage) - 1 AS place FROM rev),
k AS (SELECT DISTINCT run_id, p.place, p.stage FROM rev, (SELECT unnest(range(0, 10)) AS place, unnest({list(R.STAGES)!r}) AS stage) p),
s AS (SELECT k.run_id, k.place, k.stage, min(o.ts) FILTER (o.place >= k.place) AS started, min(o.ts) FILTER (o.place > k.place) AS ended, max(o.ts) AS last FROM k JOIN o USING (run_id) GROUP BY 1, 2, 3)
SELECT run_id, place, stage, started, ended,
 {near_sql("greatest(epoch(coalesce(ended, CASE WHEN stage = 'finished' THEN started ELSE last END)) - epoch(started), 0.0)", 3)} AS elapsed FROM s WHERE started IS NOT NULL""".replace("\n, o AS", ", o AS", 1)))
def _(t):
    return R.stage_durations(run_events(t)).withColumn("elapsed", near("elapsed", 3))


@query("events_from_logs", with_ctes("rev", """
SELECT run_id, sequence AS log_id, CASE WHEN status = 'failed' THEN 'failed' WHEN stage = 'finished' THEN 'completed' ELSE 'running' END AS status,
 CASE WHEN model_id <> 'click' THEN 'model' WHEN stage = 'finished' THEN 'terminal' ELSE 'log' END AS event_type,
 row_number() OVER (PARTITION BY run_id ORDER BY ts, sequence) AS sequence FROM rev"""))
def _(t):
    logs = run_events(t).select(
        "run_id", F.col("sequence").alias("log_id"), "ts", "stage", F.when(F.col("status") == "failed", "error").otherwise("info").alias("level"),
        F.when(F.col("model_id") != "click", F.col("model_id")).alias("model_id"))
    return R.events_from_logs(logs).select("run_id", "log_id", "status", "event_type", "sequence")


@query("remaining_time", with_ctes("state", f"""
SELECT run_id, target, model_id, {near_sql('greatest(9.5 - (coalesce(fit_seconds, 0) + coalesce(predict_seconds, 0)), 0.0)', 6)} AS remaining FROM state"""))
def _(t):
    s = R.latest_model_state(run_events(t))
    e = s.select(*R.RUN_KEYS, F.lit(9.5).alias("estimate"))
    return R.remaining_time(s, e).select(*R.RUN_KEYS, near("remaining", 6).alias("remaining"))


# -- runs: an order is a run, its line items are model runs

CTES["rn"] = ("", """
SELECT o_orderkey AS run_id, o_orderdate AS created_at, 'Run ' || o_orderpriority AS name, 'file_' || (o_orderkey % 100) || '.csv' AS file_name, 'Sheet' || (o_orderkey % 3) AS sheet_name,
 o_orderstatus AS target, o_custkey AS user_id, o_custkey % 25 AS workspace_id, o_custkey % 400 AS experiment_id FROM orders""")
CTES["logs"] = ("", """
SELECT l_orderkey AS run_id, 'y' || l_linenumber AS target, CASE l_suppkey % 5 WHEN 0 THEN 'naive' WHEN 1 THEN 'arima' WHEN 2 THEN 'lag_forest' WHEN 3 THEN 'lag_boosting' ELSE 'exp_smoothing' END AS model_id,
 CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status, l_quantity AS fit_seconds, l_discount AS predict_seconds, CASE WHEN l_linestatus = 'O' THEN l_tax * 10 END AS tuning_seconds,
 CASE WHEN l_partkey % 2 = 0 THEN 'auto' ELSE 'default' END AS strategy, CASE l_partkey % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'accurate' END AS profile FROM lineitem""")
CTES["prof"] = ("", """
SELECT DISTINCT l_orderkey AS run_id, 'y' || l_linenumber AS target, 100 + l_orderkey % 5000 AS row_count, l_linenumber % 4 AS covariates, 23 + l_linenumber % 4 AS features, 'cpu' AS device FROM lineitem""")


def sql_table(t, name: str, table: str):
    """The derived tables are the same text in both engines."""
    text = CTES[name][1].replace(f"FROM {table}", f"FROM {{{table}}}")
    return t.spark.sql(text, **{table: getattr(t, table)})


def runs(t):
    return sql_table(t, "rn", "orders")


@query("list_runs", with_ctes("rn", """
SELECT r.run_id, r.created_at, n.n_name AS workspace, c.c_name AS owner FROM rn r JOIN nation n ON n.n_nationkey = r.workspace_id JOIN customer c ON c.c_custkey = r.user_id"""))
def _(t):
    spaces = t.nation.select(F.col("n_nationkey").cast("bigint").alias("workspace_id"), F.col("n_name").alias("workspace"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("owner"))
    return R.list_runs(runs(t), spaces, users).select("run_id", "created_at", "workspace", "owner")


@query("latest_runs", with_ctes("rn", "SELECT run_id, created_at FROM rn ORDER BY created_at DESC, run_id DESC LIMIT 200"))
def _(t):
    return R.latest_runs(runs(t)).select("run_id", "created_at")


@query("latest_runs_each", with_ctes("rn", """
SELECT experiment_id, run_id, place FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY created_at DESC, run_id DESC) AS place FROM rn) WHERE place <= 20"""))
def _(t):
    return R.latest_runs_each(runs(t)).select("experiment_id", "run_id", "place")


@query("search_runs", with_ctes("rn", "SELECT run_id FROM rn WHERE contains(lower(concat_ws(' ', name, file_name, sheet_name, target)), 'urgent file_7')"))
def _(t):
    return R.search_runs(runs(t), " Urgent File_7", ("name", "file_name", "sheet_name", "target")).select("run_id")


def samples(t, latest=None):
    """Past runs, all or the ``latest`` ones."""
    logs = sql_table(t, "logs", "lineitem")
    prof = sql_table(t, "prof", "lineitem")
    listed = runs(t) if latest is None else R.latest_runs(runs(t), latest)
    return R.history_samples(logs.join(listed.select("run_id"), "run_id"), prof)


CTES["samples"] = ("rn logs prof", """
SELECT l.*, p.row_count, p.covariates, p.features, p.device, fit_seconds + predict_seconds + coalesce(tuning_seconds, 0) AS seconds FROM logs l JOIN prof p ON p.run_id = l.run_id AND p.target = l.target
WHERE l.status = 'success' AND fit_seconds + predict_seconds + coalesce(tuning_seconds, 0) > 0 AND l.run_id IN (SELECT run_id FROM rn)""")


# the estimate looks at the newest 200 runs, as its specification says
CTES["samples_200"] = ("samples rn", "SELECT * FROM samples WHERE run_id IN (SELECT run_id FROM rn ORDER BY created_at DESC, run_id DESC LIMIT 200)")


@query("history_samples", with_ctes("samples", f"SELECT run_id, target, model_id, {near_sql('seconds', 4)} AS seconds, row_count, covariates::BIGINT AS covariates FROM samples"))
def _(t):
    return samples(t).select("run_id", "target", "model_id", near("seconds").alias("seconds"), "row_count", "covariates")


def _case(values: dict, key: str, default: float) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


def _ff(p: str) -> str:
    return f"CASE WHEN r.model_id IN ('lag_boosting', 'lag_forest') THEN 1 + least(4.0, {p}.features / 45.0::DOUBLE + {p}.covariates / 180.0::DOUBLE) ELSE 1.0 END::DOUBLE"


def _sf(p: str) -> str:
    return f"CASE WHEN {p}.strategy = 'auto' THEN {_case(R.TUNING_FACTOR, 'r.model_id', 1.4)} ELSE 1.0 END"


CTES["req"] = ("", """
SELECT c_custkey AS request_id, CASE c_custkey % 6 WHEN 0 THEN 'naive' WHEN 1 THEN 'arima' WHEN 2 THEN 'lag_forest' WHEN 3 THEN 'lag_boosting' WHEN 4 THEN 'exp_smoothing' ELSE 'trend_season' END AS model_id,
 50 + c_custkey * 3 AS row_count, c_custkey % 7 AS covariates, 20 + c_custkey % 9 AS features, CASE WHEN c_custkey % 3 = 0 THEN 'fast' ELSE 'balanced' END AS profile,
 CASE WHEN c_custkey % 4 = 0 THEN 'auto' ELSE 'default' END AS strategy, 'cpu' AS device, 1 + c_custkey % 2 AS targets FROM customer""")


@query("runtime_estimate", with_ctes("req samples_200", f"""
, j AS (SELECT r.*, s.seconds, 1.0 / (1.0 + abs(ln((r.row_count + 1) / (s.row_count + 1)::DOUBLE)) * 0.55 + abs(r.covariates - s.covariates) / greatest(16.0, r.covariates, s.covariates)::DOUBLE * 0.25
  + abs(r.features - s.features) / greatest(8.0, r.features, s.features)::DOUBLE * 0.2 + CASE WHEN r.profile <> s.profile THEN 0.18 ELSE 0 END + CASE WHEN r.strategy <> s.strategy THEN 0.28 ELSE 0 END)::DOUBLE AS alike,
  s.seconds * pow((r.row_count + 1) / (s.row_count + 1)::DOUBLE, {_case(R.ROW_EXPONENT, 'r.model_id', 0.65)}) * {_ff('r')} / {_ff('s')} * {_case(R.PROFILE_FACTOR, 'r.profile', 1.0)} / {_case(R.PROFILE_FACTOR, 's.profile', 1.0)}
   * {_sf('r')} / {_sf('s')} AS scaled,
  {_case(R.BASE_SECONDS, 'r.model_id', 20.0)} * pow(r.row_count / 1000.0::DOUBLE, {_case(R.ROW_EXPONENT, 'r.model_id', 0.65)}) * {_ff('r')} * {_case(R.PROFILE_FACTOR, 'r.profile', 1.0)} * {_sf('r')} AS formula
 FROM req r LEFT JOIN samples_200 s ON s.model_id = r.model_id),
g AS (SELECT request_id, model_id, targets, count(seconds) AS samples, max(alike) AS best, sum(scaled * (alike + 0.35)) / sum(alike + 0.35) AS mean, max(formula) AS formula FROM j GROUP BY 1, 2, 3)
SELECT request_id, model_id, samples, CASE WHEN samples >= 4 AND best >= 0.72 THEN 'high' WHEN samples > 0 THEN 'medium' ELSE 'low' END AS confidence,
 {near_sql('CASE WHEN samples > 0 THEN mean ELSE formula END', 4)} AS per_target FROM g""".replace("\n, j AS", ", j AS", 1)))
def _(t):
    req = sql_table(t, "req", "customer")
    return R.runtime_estimate(req, samples(t, 200)).select("request_id", "model_id", "samples", "confidence", near("per_target").alias("per_target"))


# -- summaries and comparisons of back-tests

@query("workflow_summary", with_ctes("om_board om_rows", """
, w AS (SELECT series_id, min(t) FILTER (back > 6) AS train_start, max(t) FILTER (back <= 6) AS test_end FROM om_rows GROUP BY 1)
SELECT b.series_id, count(*) AS succeeded, 0::BIGINT AS failed, string_agg(model_id, '|' ORDER BY model_id) AS successful_models, max(model_id) FILTER (rank = 1) AS recommended,
 max(train_start) AS train_start, max(test_end) AS test_end FROM om_board b JOIN w USING (series_id) GROUP BY 1""".replace("\n, w AS", ", w AS", 1)))
def _(t):
    s = R.workflow_summary(monthly_run(t)[0], part_windows(holdout_split(monthly(t), 6)))
    return s.select("series_id", "succeeded", "failed", F.array_join("successful_models", "|").alias("successful_models"), "recommended", "train_start", "test_end")


@query("compare_golden", f"""
WITH e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t, sum(value) AS y FROM events GROUP BY 1, 2),
a AS (SELECT series_id, t, CASE WHEN hour(t) = 7 THEN y + 0.5 ELSE y END AS y FROM e WHERE NOT (series_id = 'click' AND hour(t) = 3))
SELECT series_id, count(a.t) AS actual_points, count(e.t) AS expected_points, count(*) - count(a.t) AS unmatched, {near_sql('max(abs(a.y - e.y))')} AS max_abs_diff,
 (count(*) = count(a.t) AND max(abs(a.y - e.y)) <= 0.6) AS passed FROM e LEFT JOIN a USING (series_id, t) GROUP BY 1""")
def _(t):
    e = hourly(t)
    a = e.where(~((F.col("series_id") == "click") & (F.hour("t") == 3))).withColumn("y", F.col("y") + F.when(F.hour("t") == 7, 0.5).otherwise(0.0))
    return R.compare_golden(a, e, 0.6).withColumn("max_abs_diff", near("max_abs_diff"))


@query("compare_runs", with_ctes("eh_board", """
SELECT series_id, 12::BIGINT AS checks, 11::BIGINT AS passed, 'naive.mae' AS drift, floor(11 / 12.0::DOUBLE * 1e6::DOUBLE + 0.500001::DOUBLE) / 1e6::DOUBLE AS score FROM (SELECT DISTINCT series_id FROM eh_board)"""))
def _(t):
    board = hourly_run(t)[0].select("series_id", "model_id", "mae", "mse", "rmse", "wape")
    other = board.withColumn("mae", F.when(F.col("model_id") == "naive", F.col("mae") + 1).otherwise(F.col("mae")))
    return R.compare_runs(board, other, 1e-6).select("series_id", "checks", "passed", F.array_join("drift", "|").alias("drift"), near("score", 6).alias("score"))


@query("attribution_snapshot", with_ctes("eh_board eh_points", f"""
, w AS (SELECT *, row_number() OVER (PARTITION BY series_id, model_id ORDER BY abs_error DESC, t) AS k FROM eh_points)
SELECT a.series_id, a.model_id AS best_model, b.model_id AS runner_up, {near_sql('b.mae - a.mae')} AS mae_gap, w.t AS worst_t, {near_sql('w.residual')} AS worst_residual
FROM eh_board a JOIN eh_board b ON b.series_id = a.series_id AND a.rank = 1 AND b.rank = 2 JOIN w ON w.series_id = a.series_id AND w.model_id = a.model_id AND w.k = 1""".replace("\n, w AS", ", w AS", 1)))
def _(t):
    board, points = hourly_run(t)
    s = R.attribution_snapshot(board, points, dirty_panel(t).diagnostics)
    return s.select("series_id", "best_model", "runner_up", near("mae_gap").alias("mae_gap"), "worst_t", near("worst_residual").alias("worst_residual"))


@query("series_hash", with_ctes("ev_h", r"""
, m AS (SELECT series_id, date_trunc('month', t) AS m, count(*) AS n, sha256(string_agg(strftime(t, '%Y-%m-%d %H:%M:%S') || '=' || y::DECIMAL(38,4)::VARCHAR, chr(10) ORDER BY t)) AS h FROM ev_h GROUP BY 1, 2)
SELECT series_id, sha256(string_agg(h, chr(10) ORDER BY m)) AS series_hash, sum(n)::BIGINT AS points FROM m GROUP BY 1""".replace("\n, m AS", ", m AS", 1)))
def _(t):
    return R.series_hash(hourly(t), 4)


@query("suite_summary", """
SELECT count(*) AS total_cases, count(*) FILTER (o_orderstatus <> 'F' AND o_orderstatus <> 'P') AS successful_runs, count(*) FILTER (o_orderstatus = 'F') AS failed_runs,
 count(*) FILTER (o_orderkey % 10 = 0)::BIGINT AS failed_assertions, count(*) FILTER (o_orderkey % 4 = 0)::BIGINT AS warning_assertions FROM orders""")
def _(t):
    def check(name, cond, bad):
        return F.struct(F.lit(name).alias("name"), F.when(cond, bad).otherwise("passed").alias("status"))

    cases = t.orders.select(
        F.col("o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("200").alias("run_status"),
        F.array(check("a", F.col("o_orderkey") % 10 == 0, "failed"), check("b", F.col("o_orderkey") % 4 == 0, "warning")).alias("assertions"))
    return suite_summary(cases).select("total_cases", "successful_runs", "failed_runs", "failed_assertions", "warning_assertions")
