"""Holdout split, error metrics, ranking and residual reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import seconds_of
from ..spec import KEYS
from ._common import START, backward, forward, whole

METRICS = ("mae", "mse", "rmse", "wape")


def holdout_split(panel: DataFrame, test_size: int, keys=KEYS) -> DataFrame:
    """Mark the last ``test_size`` points: ``is_test`` and 1-based ``step`` inside the test part."""
    if test_size < 1:
        raise ValueError("test_size must be at least 1")
    back = F.row_number().over(backward(keys))
    rows = panel.withColumn("_back", back)
    test = F.col("_back") <= test_size
    return rows.withColumn("is_test", test).withColumn("step", F.when(test, test_size - F.col("_back") + 1)).drop("_back")


def split_eligible(panel: DataFrame, test_size: int, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Panel of the series long enough to test, and (keys, points, reason, unstable) of all series.

    ``reason`` is null for eligible series; ``unstable`` marks training parts under 30 points.
    """
    n = F.count("*").over(whole(keys))
    counted = panel.withColumn("_n", n)
    ok = counted.where((F.col("_n") >= 3) & (F.col("_n") > test_size)).drop("_n")
    sizes = panel.groupBy(*keys).agg(F.count("*").alias("points"))
    reason = (F.when(F.col("points") < 3, "fewer than three points")
              .when(F.col("points") <= test_size, "test size not below length"))
    skipped = sizes.select(*keys, "points", reason.alias("reason"),
                           (reason.isNull() & (F.col("points") - test_size < 30)).alias("unstable"))
    return ok, skipped


def part_windows(split: DataFrame, keys=KEYS) -> DataFrame:
    """Start and end of all, training and test points."""
    def edge(fn, cond=None):
        return fn("t") if cond is None else fn(F.when(cond, F.col("t")))

    test = F.col("is_test")
    return split.groupBy(*keys).agg(
        edge(F.min).alias("time_start"), edge(F.max).alias("time_end"),
        edge(F.min, ~test).alias("train_start"), edge(F.max, ~test).alias("train_end"),
        edge(F.min, test).alias("test_start"), edge(F.max, test).alias("test_end"))


def with_residuals(points: DataFrame) -> DataFrame:
    r = F.col("actual") - F.col("predicted")
    return points.withColumns({"residual": r, "abs_error": F.abs(r), "sq_error": r * r})


def pair_predictions(test: DataFrame, predictions: DataFrame, keys=KEYS) -> DataFrame:
    """Join test points (keys, step, t, y) with predictions (keys, model_id, step, predicted)."""
    actual = test.select(*keys, "step", "t", F.col("y").alias("actual"))
    wanted = predictions.select(*keys, "model_id", "step", "predicted")
    return with_residuals(wanted.join(actual, [*keys, "step"]))


def successful_only(backtest: DataFrame, test_size: int, keys=KEYS) -> DataFrame:
    """Points of the models with exactly ``test_size`` finite predictions."""
    p = F.col("predicted")
    good = F.count_if(p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")))
    w = whole([*keys, "model_id"])
    return (backtest.withColumn("_g", good.over(w)).withColumn("_n", F.count("*").over(w))
            .where((F.col("_g") == test_size) & (F.col("_n") == test_size)).drop("_g", "_n"))


def error_metrics(backtest: DataFrame, by=None, keys=KEYS) -> DataFrame:
    by = [*keys, "model_id"] if by is None else list(by)
    err = F.abs(F.col("actual") - F.col("predicted"))
    total = F.sum(F.abs("actual"))
    mse = F.avg(err * err)
    return backtest.groupBy(*by).agg(
        F.avg(err).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        F.when(total > 0, F.sum(err) / F.when(total > 0, total)).alias("wape"))


def rank_models(metrics: DataFrame, by: str = "mae", keys=KEYS, tie: str = "selection") -> DataFrame:
    """Rank by metric, ties by selection order; rows without a metric are last and unranked."""
    order = [F.col(by).asc_nulls_last(), F.col(tie) if tie in metrics.columns else F.col("model_id")]
    pos = F.row_number().over(whole(keys).orderBy(*order))
    return metrics.withColumn("_pos", pos).withColumn("rank", F.when(F.col(by).isNotNull(), F.col("_pos"))).drop("_pos")


def ranked_plus_failed(ranked: DataFrame, failed: DataFrame, keys=KEYS) -> DataFrame:
    """Ranked models followed by the failed ones, numbered by ``place``."""
    both = (ranked.withColumn("status", F.lit("success"))
            .unionByName(failed.withColumn("status", F.lit("failed")), allowMissingColumns=True))
    order = [F.col("rank").asc_nulls_last(), F.col("model_id")]
    return both.withColumn("place", F.row_number().over(whole(keys).orderBy(*order)))


def runner_up_gap(leaderboard: DataFrame, keys=KEYS) -> DataFrame:
    """Best and second model of each series with the difference of their MAE."""
    def at(rank, c):
        return F.max(F.when(F.col("rank") == rank, F.col(c)))

    out = leaderboard.where(F.col("rank") <= 2).groupBy(*keys).agg(
        at(1, "model_id").alias("best_model"), at(1, "mae").alias("best_mae"),
        at(2, "model_id").alias("runner_up"), at(2, "mae").alias("runner_up_mae"))
    return out.withColumn("mae_gap", F.col("runner_up_mae") - F.col("best_mae"))


def visible_models(leaderboard: DataFrame, k: int = 3) -> DataFrame:
    return leaderboard.where(F.col("rank") <= k)


def top_residuals(backtest: DataFrame, k: int = 12, keys=KEYS, best_only: DataFrame | None = None) -> DataFrame:
    """The ``k`` largest absolute residuals per series over all models, or of the rank-1 model."""
    rows = backtest
    if best_only is not None:
        rows = rows.join(best_only.where(F.col("rank") == 1).select(*keys, "model_id"), [*keys, "model_id"])
    pos = F.row_number().over(whole(keys).orderBy(F.abs("residual").desc(), "model_id", "t"))
    return rows.withColumn("place", pos).where(F.col("place") <= k)


def largest_residual(backtest: DataFrame, by=None, keys=KEYS) -> DataFrame:
    by = [*keys, "model_id"] if by is None else list(by)
    point = F.struct("t", "actual", "predicted", "residual")
    # ties: the earliest point
    worst = F.max_by(point, F.struct(F.abs("residual"), -seconds_of("t")))
    return backtest.groupBy(*by).agg(worst.alias("_w")).select(*by, "_w.*")


def normalise_metrics(leaderboard: DataFrame, metrics=("mae", "rmse", "wape"), keys=KEYS) -> DataFrame:
    w = whole(keys)
    ok = leaderboard.where(F.col("rank").isNotNull())
    return ok.select(*keys, "model_id", *[
        (F.coalesce(F.col(m), F.lit(0.0)) / F.greatest(F.max(F.coalesce(F.col(m), F.lit(0.0))).over(w), F.lit(1.0))).alias(f"{m}_share")
        for m in metrics])


def metric_extremes(leaderboard: DataFrame, metrics=METRICS, keys=KEYS) -> DataFrame:
    """'best' and 'worst' marks per metric; none if fewer than two values or all equal."""
    w = whole(keys)
    ok = leaderboard.where(F.col("rank").isNotNull())
    marks = []
    for m in metrics:
        low, high, n = F.min(m).over(w), F.max(m).over(w), F.count(m).over(w)
        comparable = (n >= 2) & (low < high)
        marks.append(F.when(comparable & (F.col(m) == low), "best")
                     .when(comparable & (F.col(m) == high), "worst").alias(f"{m}_mark"))
    return ok.select(*keys, "model_id", *marks)


def seasonality_means(panel: DataFrame, k: int = 12, keys=KEYS) -> DataFrame:
    """Mean and count per (month, weekday), the ``k`` highest means of each series."""
    cells = (panel.where(F.col("y").isNotNull())
             .groupBy(*keys, F.month("t").alias("month"), F.weekday("t").alias("weekday"))
             .agg(F.avg("y").alias("mean"), F.count("*").alias("n")))
    pos = F.row_number().over(whole(keys).orderBy(F.col("mean").desc(), "month", "weekday"))
    return cells.withColumn("place", pos).where(F.col("place") <= k)


def residual_heatmap(backtest: DataFrame, keys=KEYS, wide: bool = False) -> DataFrame:
    """Mean residual per weekday and month; ``wide`` pivots the twelve months into columns."""
    cells = backtest.where(F.col("residual").isNotNull()).withColumns(
        {"weekday": F.weekday("t"), "month": F.month("t")})
    if wide:
        return cells.groupBy(*keys, "weekday").pivot("month", list(range(1, 13))).agg(F.avg("residual"))
    return cells.groupBy(*keys, "weekday", "month").agg(F.avg("residual").alias("mean_residual"))


def residual_pattern(backtest: DataFrame, keys=KEYS) -> DataFrame:
    """Signs, first-third and last-third means and mean absolute error per series and model."""
    by = [*keys, "model_id"]
    rows = backtest.withColumn("_i", F.row_number().over(forward(by))).withColumn("_n", F.count("*").over(whole(by)))
    third = F.greatest(F.floor(F.col("_n") / 3), F.lit(1))
    r = F.col("residual")
    return rows.groupBy(*by).agg(
        F.count_if(r > 0).alias("positive"), F.count_if(r < 0).alias("negative"),
        F.avg(F.when(F.col("_i") <= third, r)).alias("first_third_mean"),
        F.avg(F.when(F.col("_i") > F.col("_n") - third, r)).alias("last_third_mean"),
        F.avg("abs_error").alias("mean_abs_error"))


def forecast_summary(forecast: DataFrame, by=None, keys=KEYS) -> DataFrame:
    by = [*keys, "model_id"] if by is None else list(by)
    width = F.col("upper") - F.col("lower")
    return forecast.groupBy(*by).agg(
        F.count("*").alias("horizon"),
        F.min_by("predicted", "t").alias("first_predicted"), F.max_by("predicted", "t").alias("last_predicted"),
        F.min("predicted").alias("min_predicted"), F.max("predicted").alias("max_predicted"),
        F.avg("predicted").alias("avg_predicted"),
        F.bool_or(F.col("lower").isNotNull() | F.col("upper").isNotNull()).alias("has_interval"),
        F.avg(width).alias("avg_interval_width"))


def timeline(history: DataFrame, forecast: DataFrame, keys=KEYS) -> DataFrame:
    """History and forecast under one time axis."""
    band = [F.col(c) if c in forecast.columns else F.lit(None).cast("double").alias(c) for c in ("lower", "upper")]
    past = history.select(*keys, "t", F.lit("history").alias("part"), F.col("y").alias("value"))
    ahead = forecast.select(*keys, "t", F.lit("forecast").alias("part"), F.col("predicted").alias("value"), *band)
    return past.unionByName(ahead, allowMissingColumns=True)


def best_so_far(trials: DataFrame, keys=KEYS, metric: str = "mae") -> DataFrame:
    """Running best metric over the rounds of each (series, model), and which trials improved on it."""
    by = [*keys, "model_id"]
    w = forward(by, "round")
    ok = F.when(F.col("status") == "success", F.col(metric))
    best = F.min(ok).over(w.rowsBetween(START, 0))
    before = F.min(ok).over(w.rowsBetween(START, -1))
    improved = ok.isNotNull() & (before.isNull() | (ok < before))
    return trials.withColumn("best_metric", best).withColumn("improved", improved)


def trial_summary(trials: DataFrame, keys=KEYS) -> DataFrame:
    by = [*keys, "model_id"]
    ok = F.col("status") == "success"
    first = F.min_by("mae", F.when(ok & F.col("mae").isNotNull(), F.col("round")))
    best = F.min(F.when(ok, F.col("mae")))
    return trials.groupBy(*by).agg(
        F.count("*").alias("trials"), F.count_if(ok).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        first.alias("first_mae"), best.alias("best_mae"), (first - best).alias("improvement"))


def suite_summary(cases: DataFrame) -> DataFrame:
    """One row over benchmark cases(name, run_status, assertions ARRAY<STRUCT<name, status>>)."""
    ok, skipped = F.col("run_status") == "200", F.col("run_status") == "skipped"

    def hits(status):
        return F.coalesce(F.sum(F.size(F.filter("assertions", lambda a: a["status"] == status))), F.lit(0))

    out = cases.agg(F.count("*").alias("total_cases"), F.count_if(ok).alias("successful_runs"),
                    F.count_if(~ok & ~skipped).alias("failed_runs"),
                    hits("failed").alias("failed_assertions"), hits("warning").alias("warning_assertions"))
    n = F.when(F.col("total_cases") > 0, F.col("total_cases"))
    return (out.withColumn("success_rate", F.coalesce(F.col("successful_runs") / n, F.lit(0.0)))
            .withColumn("failure_rate", F.coalesce(F.col("failed_runs") / n, F.lit(0.0))))
