"""Tree models on the feature matrix of a whole panel, recursive forecasts and explanations.

One MLlib model is trained on all series at once.  MLlib grows trees from
per-partition histograms, so training spreads over the rows, and the driver
only holds the trees.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import next_period
from ..session import stage
from ..spec import KEYS, FeatureConfig
from . import packed as P
from ._common import backward, whole
from .forecasters import series_tail
from .packed import node_table

SEED = 42  # fixed value
TASK_ROWS = 20_000


@dataclass(frozen=True)
class TreeModel:
    model_id: str
    model: object
    names: tuple[str, ...]
    cfg: FeatureConfig
    held: dict = field(default_factory=dict, compare=False, repr=False)  # the packed nodes, once read

    def predict(self, df: DataFrame, out: str = "predicted", columns: Iterable[str] | None = None) -> DataFrame:
        vec = VectorAssembler(inputCols=list(columns or self.names), outputCol=f"_vec_{out}").transform(df)
        fitted = self.model.copy({self.model.featuresCol: f"_vec_{out}", self.model.predictionCol: out})
        return fitted.transform(vec).drop(f"_vec_{out}")


def _fit(estimator, model_id: str, features: DataFrame, names, cfg: FeatureConfig, target: str, at_once: int = 1) -> TreeModel:
    data = VectorAssembler(inputCols=list(names), outputCol="_vec", handleInvalid="error").transform(features)
    data = data.select("_vec", F.col(target).alias("_label"))
    # every level of every tree is a job over the partitions: a small matrix must not be in many
    parts = max(1, -(-features.count() * at_once // TASK_ROWS))
    if parts < features.sparkSession.sparkContext.defaultParallelism:
        data = data.coalesce(parts)
    fitted = estimator.setFeaturesCol("_vec").setLabelCol("_label").fit(data)
    return TreeModel(model_id, fitted, tuple(names), cfg)


def lag_forest(features: DataFrame, names, cfg: FeatureConfig = FeatureConfig(), trees: int = 120, depth: int = 18,
               leaf: int = 2, target: str = "y", seed: int = SEED, bootstrap: bool = True) -> TreeModel:
    """Random forest; runs one Spark job per tree level.  Trees of more than 30 levels are refused: the learner has no more."""
    if depth > 30:
        raise ValueError(f"depth {depth} is above 30")
    est = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, bootstrap=bootstrap)
    return _fit(est, "lag_forest", features, names, cfg, target, max(1, trees // 10))


def lag_boosting(features: DataFrame, names, cfg: FeatureConfig = FeatureConfig(), trees: int = 200, depth: int = 3,
                 rate: float = 0.05, target: str = "y", seed: int = SEED, share: float = 0.9) -> TreeModel:
    """Gradient boosting; trees grow one after the other, each over a random ``share`` of the rows."""
    est = GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed)
    return _fit(est, "lag_boosting", features, names, cfg, target)


def fitted_residuals(model: TreeModel, features: DataFrame, keys=KEYS) -> DataFrame:
    """In-sample residuals, for ``residual_interval``."""
    out = model.predict(features)
    return out.select(*keys, F.lit(model.model_id).alias("model_id"), "t", (F.col("y") - F.col("predicted")).alias("residual"))


def packed(model: TreeModel, spark) -> DataFrame:
    """One record a tree (see ``packed``), staged once a model."""
    if "table" not in model.held:
        model.held["table"] = stage(node_table(model.model, spark, model.model_id == "lag_forest"))
        model.held["bytes"] = model.held["table"].agg(F.coalesce(F.sum("nodes"), F.lit(0))).head()[0] * P.NODE_BYTES
    return model.held["table"]


def _everywhere(model: TreeModel, spark):
    """A broadcast of the node arrays, or None where they are larger than ``MOST_BYTES``."""
    table = packed(model, spark)
    if model.held["bytes"] > P.MOST_BYTES:
        return None
    if "sent" not in model.held:
        model.held["sent"] = spark.sparkContext.broadcast(P.unpacked(r.asDict() for r in table.orderBy("tree").collect()))
    return model.held["sent"]


def _blocks(model: TreeModel) -> int:
    return max(1, -(-model.held["bytes"] // P.BLOCK_BYTES))


def _trailing(past: np.ndarray, cfg: FeatureConfig) -> list[np.ndarray]:
    """Lags, means and deviations of rows of history; NaN marks points before a short series began."""
    out = [np.where(np.isnan(past[:, -k]), past[:, -1], past[:, -k]) for k in cfg.lags]
    out += [np.nanmean(past[:, -k:], axis=1) for k in cfg.means]
    return out + [np.nanstd(past[:, -k:], axis=1) for k in cfg.stds]


def recursive_predict(model: TreeModel, panel: DataFrame, horizon: int, freq: str, future: DataFrame | None = None,
                      keys=KEYS, with_features: bool = False) -> DataFrame:
    """Feed each prediction back as history: keys, model_id, step, t, predicted.

    One row per series holds its last few values and the known inputs of every
    step; an Arrow batch of such rows walks through the horizon together, all
    series and trees at once.  So the plan does not grow with the horizon,
    nothing is checkpointed, and a lost task only repeats its own series.
    ``future`` has keys, step and the covariate columns; a series without a row
    for a step repeats its last known covariates.
    """
    cfg, keys = model.cfg, list(keys)
    reach = max([1, *cfg.lags, *cfg.means, *cfg.stds])
    tail = series_tail(panel, reach, keys)
    sizes = panel.where(F.col("y").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.max_by(c, "t").cast("double").alias(f"_last_{c}") for c in cfg.covariates])
    state = tail.join(sizes, keys).withColumn("_end", F.element_at("pts", -1)["t"])
    if cfg.covariates and future is not None:
        given = future.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
            F.col("step").cast("int").alias("step"), F.struct(*cfg.covariates).alias("c")))).alias("_future"))
        state = state.join(given, keys, "left")

    def known(k: Column) -> list[Column]:
        t = next_period("_end", freq, k)
        row = []
        if cfg.calendar:
            row += [(F.col("_n") + (k - 1)).cast("double"), F.weekday(t).cast("double"), F.month(t).cast("double")]
        for c in cfg.covariates:
            ahead = F.try_element_at("_future", k)[c].cast("double") if "_future" in state.columns else F.lit(None).cast("double")
            row.append(F.coalesce(ahead, F.col(f"_last_{c}"), F.lit(0.0)))
        return row

    # the inputs of a step are written once, for a step number that runs; the plan is as long for any horizon
    inputs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.array(*known(k)).cast("array<double>")))
    state = state.select(*keys, "_end", F.transform("pts", lambda p: p["y"]).alias("_past"), inputs.alias("_ahead"))
    width = len(model.names) if with_features else 0
    trees = _everywhere(model, panel.sparkSession)
    if trees is None:
        walked = _walk_in_blocks(model, state, keys, reach, horizon, width)
    else:
        walked = _walk(model, state, keys, reach, horizon, width, trees)
    flat = walked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    first = (F.col("step") - 1) * (1 + width)
    cols = [*keys, F.lit(model.model_id).alias("model_id"), "step", next_period("_end", freq, F.col("step")).alias("t"),
            F.col("_w")[first].alias("predicted")]
    if with_features:
        cols += [F.col("_w")[first + i].alias(n) for i, n in enumerate(model.names, start=1)]
    return flat.select(*cols)


def _window(history, reach: int) -> np.ndarray:
    """The last ``reach`` values of every history as rows; NaN before a short one began."""
    past = np.full((len(history), reach), np.nan)
    for i, h in enumerate(history):
        past[i, reach - len(h):] = h
    return past


def _walk(model: TreeModel, state: DataFrame, keys, reach: int, horizon: int, width: int, trees) -> DataFrame:
    """All steps of every series inside one task, with all trees at hand."""
    cfg = model.cfg

    @F.pandas_udf("array<double>")
    def walk(history: pd.Series, ahead: pd.Series) -> pd.Series:
        past = _window(history, reach)
        fixed = np.stack([np.asarray(a, dtype=float) for a in ahead]).reshape(len(history), horizon, -1)
        out = np.empty((len(history), horizon, 1 + width))
        for k in range(horizon):
            x = np.column_stack([*_trailing(past, cfg), fixed[:, k, :]])
            y = P.tree_values(trees.value, x)
            out[:, k, 0] = y
            if width:
                out[:, k, 1:] = x
            past = np.column_stack([past[:, 1:], y])
        return pd.Series(list(out.reshape(len(history), -1)))

    return state.select(*keys, "_end", walk("_past", "_ahead").alias("_w"))


def _walk_in_blocks(model: TreeModel, state: DataFrame, keys, reach: int, horizon: int, width: int) -> DataFrame:
    """Step after step: rows of all series meet the blocks of trees, whose parts are added; every step is staged."""
    cfg, table, blocks = model.cfg, packed(model, state.sparkSession), _blocks(model)

    @F.pandas_udf("array<double>")
    def row(history: pd.Series, fixed: pd.Series) -> pd.Series:
        fixed = np.stack([np.asarray(a, dtype=float) for a in fixed])
        return pd.Series(list(np.column_stack([*_trailing(_window(history, reach), cfg), fixed])))

    now = stage(state.withColumn("_id", F.monotonically_increasing_id()).withColumn("_w", F.array().cast("array<double>")))
    for k in range(horizon):
        per = F.expr(f"size(_ahead) div {horizon}")
        asked = stage(now.select(F.col("_id").alias("id"), row("_past", F.slice("_ahead", per * k + 1, per)).alias("x")))
        got = P.over_blocks(asked, table, blocks, P.tree_values).join(asked, "id").select(F.col("id").alias("_id"), F.col("out")[0].alias("_y"), "x")
        more = F.concat("_w", F.array("_y"), "x") if width else F.concat("_w", F.array("_y"))
        past = F.concat("_past", F.array("_y"))
        now = stage(now.join(got, "_id").select(*keys, "_end", "_id", "_ahead", F.slice(past, F.greatest(F.size(past) - reach + 1, F.lit(1)), F.lit(reach)).alias("_past"), more.alias("_w")))
    return now.select(*keys, "_end", "_w")


# -- explanations -------------------------------------------------------------

def feature_importance(spark, model: TreeModel, k: int = 20) -> DataFrame:
    """model_id, feature, importance (sums to one), rank; a row per feature of the model."""
    values = model.model.featureImportances.toArray()
    total = float(values.sum())
    rows = [(model.model_id, n, float(v) / total if total > 0 else float(v)) for n, v in zip(model.names, values)]
    rows.sort(key=lambda r: -r[2])
    ranked = [(*r, i) for i, r in enumerate(rows[:k], start=1)]
    return spark.createDataFrame(ranked, "model_id string, feature string, importance double, rank int")


def last_rows(features: DataFrame, k: int = 128, keys=KEYS) -> DataFrame:
    """The rows a model is explained on: the last ``k`` of each series."""
    pos = F.row_number().over(backward(keys))
    return features.withColumn("_r", pos).where(F.col("_r") <= k).drop("_r")


def shapley_points(model: TreeModel, rows: DataFrame, background: DataFrame | None, ids) -> DataFrame:
    """Exact Shapley values: ids, feature, value, contribution.

    An absent feature takes its mean over ``background``; without one it follows both branches of a cut by the shares of the training
    rows.  The contributions of a row add up to its prediction minus that of the mean row, or minus the mean over all leaves by their shares.  One
    Arrow pass, a row of numbers for each row; only its result is exploded, a row per feature.  Forests beyond ``MOST_BYTES`` pass block by block.
    """
    names, ids = list(model.names), list(ids)
    base = None
    if background is not None:
        means = background.agg(*[F.avg(n).alias(n) for n in names]).first()
        base = np.array([float("nan") if means[n] is None else float(means[n]) for n in names])
    values = F.array(*[F.col(n).cast("double") for n in names])
    trees = _everywhere(model, rows.sparkSession)
    if trees is None:
        asked = stage(rows.select(*ids, values.alias("x")).withColumn("id", F.monotonically_increasing_id()))
        told = P.over_blocks(asked.select("id", "x"), packed(model, rows.sparkSession), _blocks(model), lambda t, x: P.tree_shapley(P.leaf_paths(t), x, base)).withColumnRenamed("out", "_phi")
        told = asked.join(told, "id").select(*ids, F.col("x").alias("_x"), "_phi")
    else:
        @F.pandas_udf("array<double>")
        def explain(x: pd.Series) -> pd.Series:
            if "paths" not in trees.value:
                trees.value["paths"] = P.leaf_paths(trees.value)
            return pd.Series(list(P.tree_shapley(trees.value["paths"], np.stack([np.asarray(r, dtype=float) for r in x]), base))) if len(x) else pd.Series([], dtype=object)

        told = rows.select(*ids, values.alias("_x")).withColumn("_phi", explain("_x"))
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_x").alias("value"), F.col("_phi").alias("contribution"))
    return told.select(*ids, F.inline(named)).toDF(*ids, "feature", "value", "contribution")


def _direction(c: Column) -> Column:
    return F.when(c > 1e-9, "positive").when(c < -1e-9, "negative").otherwise("neutral")


def shapley_sampled(model: TreeModel, features: DataFrame, last: int = 128, k: int = 20, keys=KEYS, paths: bool = False) -> DataFrame:
    """model_id, feature, mean_abs, direction, rank over the last rows of each series.

    Absent features take their mean over ``features``, or with ``paths`` follow the trees by shares of rows.
    """
    points = shapley_points(model, last_rows(features, last, keys), None if paths else features, [*keys, "t"])
    out = points.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("_signed"))
    pos = F.row_number().over(_one_partition().orderBy(F.col("mean_abs").desc(), "feature"))
    return (out.withColumn("model_id", F.lit(model.model_id)).withColumn("direction", _direction(F.col("_signed")))
            .withColumn("rank", pos).where(F.col("rank") <= k).select("model_id", "feature", "mean_abs", "direction", "rank"))


def _one_partition():
    return whole([F.lit(1)])  # one row per feature


def single_point(backtest: DataFrame, contributions: DataFrame, k: int = 5, keys=KEYS) -> DataFrame:
    """The worst back-test point of each series with its ``k`` largest contributions.

    ``contributions``: keys, t, feature, value, contribution.
    """
    from .scoring import largest_residual
    worst = largest_residual(backtest, keys=keys)
    hit = worst.join(contributions, [*keys, "t"], "left")
    pos = F.row_number().over(whole([*keys, "model_id"]).orderBy(F.abs("contribution").desc_nulls_last(), "feature"))
    return hit.withColumn("place", pos).where(F.col("place") <= k).withColumn("direction", _direction(F.col("contribution")))
