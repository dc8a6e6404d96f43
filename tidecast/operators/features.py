"""Leak-free feature matrix of a panel: lags, trailing statistics, calendar.

One window specification (series, t) serves every feature, so Spark plans one
exchange and one sort for all of them, and reuses the panel's partitioning
where it is already by series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_no
from ..spec import KEYS, FeatureConfig
from ._common import forward, whole


def lag_features(panel: DataFrame, lags=(1, 2, 3, 7), value: str = "y", keys=KEYS) -> DataFrame:
    w = forward(keys)
    return panel.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def rolling_features(panel: DataFrame, means=(3, 7), stds=(7,), value: str = "y", keys=KEYS) -> DataFrame:
    """Trailing means and population deviations; the current row is never inside the frame."""
    w = forward(keys)
    out = {f"rolling_mean_{k}": F.avg(value).over(w.rowsBetween(-k, -1)) for k in means}
    out |= {f"rolling_std_{k}": F.coalesce(F.stddev_pop(value).over(w.rowsBetween(-k, -1)), F.lit(0.0)) for k in stds}
    return panel.withColumns(out)


def position(panel: DataFrame, keys=KEYS) -> DataFrame:
    """0-based row number, for panels without a regular grid."""
    return panel.withColumn("time_index", F.row_number().over(forward(keys)) - 1)


def trim_warmup(features: DataFrame, start: int = 7) -> DataFrame:
    return features.where(F.col("time_index") >= start)


def feature_matrix(panel: DataFrame, cfg: FeatureConfig = FeatureConfig(), keys=KEYS) -> tuple[DataFrame, list[str]]:
    """The merged matrix without its warm-up rows, and the feature names in order."""
    out = rolling_features(lag_features(position(panel, keys), cfg.lags, keys=keys), cfg.means, cfg.stds, keys=keys)
    names = [f"lag_{k}" for k in cfg.lags] + [f"rolling_mean_{k}" for k in cfg.means] + [f"rolling_std_{k}" for k in cfg.stds]
    if cfg.calendar:
        out = out.withColumns({"day_of_week": F.weekday("t").cast("double"), "month": F.month("t").cast("double")})
        names += ["time_index", "day_of_week", "month"]
    names += list(cfg.covariates)
    if not names:
        raise ValueError("at least one feature family must be enabled")
    return trim_warmup(out, cfg.warmup), names


def chunked_features(panel: DataFrame, freq: str, lags=(1, 2, 3, 7), means=(3, 7), stds=(7,),
                     chunk: int = 4096, keys=KEYS) -> DataFrame:
    """The same lags and trailing statistics for panels of few, very long, gap-free series.

    Each series is cut into chunks of ``chunk`` periods; a row close to the end
    of a chunk is also sent to the next one, where it only serves as history.
    A single series then fills as many tasks as it has chunks.
    """
    reach = max([*lags, *means, *stds])
    if chunk <= reach:
        raise ValueError("chunk must be longer than the longest lag or window")
    number = period_no("t", freq)
    home = F.floor(number / chunk)
    spill = F.when(number % chunk >= chunk - reach, F.array(home, home + 1)).otherwise(F.array(home))
    rows = panel.withColumn("_home", home).withColumn("_chunk", F.explode(spill))
    part = (*keys, "_chunk")
    out = rolling_features(lag_features(rows, lags, keys=part), means, stds, keys=part)
    return out.where(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk")


def matrix_profile(df: DataFrame, columns) -> DataFrame:
    """count, nulls, min, max, mean and population deviation per column, from one global aggregate."""
    def finite(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    aggs = []
    for i, c in enumerate(columns):
        v = finite(c)
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count(v).alias("non_null"),
                             (F.count("*") - F.count(v)).alias("nulls"), F.min(v).alias("minimum"),
                             F.max(v).alias("maximum"), F.avg(v).alias("mean"),
                             F.stddev_pop(v).alias("std")).alias(f"c{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("p")).select("p.*")


def leakage_checks(features: DataFrame, names, keys=KEYS) -> DataFrame:
    """One row of counters that must all be zero."""
    bad = None
    for n in names:
        v = F.col(n).cast("double")
        one = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        bad = one if bad is None else bad | one
    steps = features.withColumn("_p", F.lag("t").over(forward(keys)))
    return steps.agg(
        F.count("*").alias("checked_rows"),
        F.count_if(F.col("t") <= F.col("_p")).alias("not_increasing"),
        F.count_if(bad).alias("not_finite"),
        F.count_if(F.col("y").isNull()).alias("missing_target"))


def series_length(panel: DataFrame, keys=KEYS) -> DataFrame:
    return panel.withColumn("n", F.count("*").over(whole(keys)))
