"""Scenarios, residual bands and the tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import texts
from ..spec import KEYS
from ._common import whole


def scenarios(forecast: DataFrame, up: float = 1.08, down: float = 0.92, value: str = "predicted") -> DataFrame:
    """Three rows per point: baseline, upside and downside."""
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), (F.col(value) * f).alias("scenario_value"))
                      for n, f in (("baseline", 1.0), ("upside", up), ("downside", down))])
    return forecast.withColumn("_c", F.explode(cases)).select(*forecast.columns, "_c.*")


def residual_band(forecast: DataFrame, backtest: DataFrame, keys=KEYS) -> DataFrame:
    """p10/p50/p90 labels: the prediction and one population deviation of |residual| either side."""
    by = [*keys, "model_id"]
    spread = F.when(F.count("residual") > 1, F.stddev_pop(F.abs("residual"))).otherwise(F.avg(F.abs("residual")))
    dev = backtest.groupBy(*by).agg(spread.alias("_s"))
    s = F.coalesce(F.col("_s"), F.lit(0.0))
    return (forecast.join(dev, by, "left").withColumns({
        "p10": F.col("predicted") - s, "p50": F.col("predicted"), "p90": F.col("predicted") + s}).drop("_s"))


def model_gap_table(leaderboard: DataFrame, k: int = 6, keys=KEYS) -> DataFrame:
    """The first ``k`` models of each series with their error and times."""
    return leaderboard.where(F.col("rank") <= k).select(
        *[c for c in leaderboard.columns if c in (*keys, "model_id", "rank", "mae")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("fit_seconds", "predict_seconds")])


def cost_error_points(leaderboard: DataFrame, keys=KEYS) -> DataFrame:
    cost = F.coalesce("fit_seconds", F.lit(0.0)) + F.coalesce("predict_seconds", F.lit(0.0))
    size = F.greatest(F.lit(8.0), F.lit(36.0) - F.least(F.col("mae") * 5, F.lit(24.0)))
    return leaderboard.where(F.col("mae").isNotNull()).select(
        *keys, "model_id", cost.alias("seconds"), "mae", size.alias("size"))


def residual_histogram(backtest: DataFrame, digits: int = 2, keys=KEYS) -> DataFrame:
    """Counts of residuals rounded half up."""
    scale = float(10 ** digits)
    return backtest.groupBy(*keys, "model_id", (F.floor(F.col("residual") * scale + 0.5) / scale).alias("residual")).agg(F.count("*").alias("n"))


def chart_wide(backtest: DataFrame, value: str = "predicted", models=None, keys=KEYS) -> DataFrame:
    """One row per time with a column per model; give ``models`` to spare the pass that lists them."""
    grouped = backtest.groupBy(*keys, "t")
    pivot = grouped.pivot("model_id", list(models)) if models else grouped.pivot("model_id")
    return pivot.agg(F.first(value))


def recommendation(leaderboard: DataFrame, roles: DataFrame | None = None, keys=KEYS, trials: DataFrame | None = None, features=()) -> DataFrame:
    """Recommended model, runner-up, gap, reasons and caveats per series.

    ``trials`` of a parameter search tell how the recommended model was tuned; ``features`` are those that tree models were given.  Up to
    three warnings of the model, where the leaderboard has them, are caveats.
    """
    def at(rank, c):
        return F.max(F.when(F.col("rank") == rank, F.col(c)))

    best = leaderboard.groupBy(*keys).agg(
        at(1, "model_id").alias("model_id"), at(2, "model_id").alias("runner_up"),
        *[at(1, m).alias(m) for m in ("mae", "rmse", "wape")], at(2, "mae").alias("_mae2"))
    gap = F.col("_mae2") - F.col("mae")
    out = best.withColumn("mae_gap", gap)
    searched, warned = [], F.array().cast("array<string>")
    if "warnings" in leaderboard.columns:
        told = leaderboard.where("rank = 1").groupBy(*keys).agg(F.first("warnings").alias("_warnings"))
        out = out.join(told, list(keys), "left")
        warned = F.slice(F.coalesce("_warnings", warned), 1, 3)
    if trials is not None:
        tried = trials.groupBy(*keys, "model_id").agg(F.count(F.lit(1)).alias("_tried"), F.min(F.when(F.col("status") == "success", F.col("mae"))).alias("_reached"))
        out = out.join(tried, [*keys, "model_id"], "left")
        searched = [F.when(F.col("_tried").isNotNull(), F.format_string("a search tried %d candidates, the best with MAE %.4f", "_tried", "_reached"))
                    .when(F.col("model_id").isNotNull(), "no search: default or given parameters")]
    if features:
        searched.append(F.when(F.col("model_id").isin("lag_forest", "lag_boosting"), "uses the features " + ", ".join(features)))
    risk = F.lit(0)
    if roles is not None:
        out = out.join(roles.groupBy(*keys).agg(F.count_if("leakage_risk").alias("_risk")), list(keys), "left")
        risk = F.coalesce("_risk", F.lit(0))
    reasons = texts(
        F.when(F.col("mae").isNotNull(), F.format_string("lowest MAE of the successful models: %.4f", "mae")),
        F.when(F.col("rmse").isNotNull(), F.format_string("RMSE %.4f", "rmse")),
        F.when(F.col("wape").isNotNull(), F.format_string("WAPE %.4f", "wape")),
        F.when(F.col("mae_gap") > 0, F.format_string("MAE lower than %s by %.4f", "runner_up", "mae_gap")), *searched)
    caveats = texts(
        F.when(F.col("model_id").isNull(), "no model succeeded"),
        F.when(F.col("mae_gap") == 0, F.format_string("same MAE as %s", "runner_up")),
        F.when(risk > 0, F.format_string("%d covariates may leak the future", risk)))
    return out.select(*keys, "model_id", "runner_up", "mae", "rmse", "wape", "mae_gap", reasons.alias("reasons"), F.concat(caveats, warned).alias("caveats"))


# -- drivers ------------------------------------------------------------------

def top_features(importance: DataFrame, k: int = 20, score: str = "importance", by=("model_id",)) -> DataFrame:
    pos = F.row_number().over(whole(by).orderBy(F.col(score).desc(), "feature"))
    return importance.withColumn("rank", pos).where(F.col("rank") <= k)


def driver_ranking(contributions: DataFrame | None, importance: DataFrame, k: int = 8, by=("model_id",)) -> DataFrame:
    """Contributions where a model has them, else importance: by, feature, score, direction, evidence, rank."""
    by = list(by)
    imp = importance.select(*by, "feature", F.col("importance").alias("score"), F.lit("mixed").alias("direction"),
                            F.lit("importance").alias("evidence"))
    if contributions is not None:
        con = contributions.select(*by, "feature", F.col("mean_abs").alias("score"), "direction", F.lit("contribution").alias("evidence"))
        both = imp.withColumn("_p", F.lit(1)).unionByName(con.withColumn("_p", F.lit(0)))
        imp = both.withColumn("_best", F.min("_p").over(whole(by))).where(F.col("_p") == F.col("_best")).drop("_p", "_best")
    return top_features(imp, k, "score", by)


def sensitivity(drivers: DataFrame, k: int = 5, by=("model_id",)) -> DataFrame:
    """Share of |score| among the first ``k`` drivers, times minus and plus ten percent."""
    top = drivers.where(F.col("rank") <= k)
    total = F.sum(F.abs("score")).over(whole(by))
    weight = F.abs("score") / F.when(total > 0, total).otherwise(1.0)
    return top.select(*by, "feature", "rank", (weight * -10).alias("minus10"), (weight * 10).alias("plus10"))


def waterfall(drivers: DataFrame, k: int = 6, by=("model_id",)) -> DataFrame:
    """Signed scores of the first ``k`` drivers; without a clear direction half the score."""
    s = F.abs("score")
    signed = F.when(F.col("direction") == "positive", s).when(F.col("direction") == "negative", -s).otherwise(s * 0.5)
    return drivers.where(F.col("rank") <= k).select(*by, "feature", "rank", "direction", signed.alias("value"))
