"""Regular grid and gap filling of a panel (series length bounded by the calendar).

All windows share the series key and the order ``t``, so after the first
exchange Spark only adds local sorts.  "Next known value" is read by a
descending running window: a frame to the end of the partition would be
recomputed for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import micros_of, next_period, period_no
from ..spec import KEYS
from ._common import START, backward, forward, whole


def reindex(panel: DataFrame, freq: str, keys=KEYS) -> DataFrame:
    """Insert the missing periods between the first and last of each series.

    Every row explodes into itself and the gap that follows it, so the grid
    needs no self join.  ``is_gap`` marks inserted rows; their other columns
    are null.
    """
    steps = F.coalesce(period_no("_ahead", freq) - period_no("t", freq) - 1, F.lit(0))
    values = [c for c in panel.columns if c not in (*keys, "t")]
    grid = panel.withColumn("_ahead", F.lead("t").over(forward(keys))).withColumn("_gap", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap").cast("int"))))
    real = F.col("_k") == 0
    return grid.select(*keys, next_period("t", freq, F.col("_k")).alias("t"),
                       *[F.when(real, F.col(c)).alias(c) for c in values], (~real).alias("is_gap"))


def time_index(panel: DataFrame, freq: str, keys=KEYS) -> DataFrame:
    """0-based position on a gap-free grid, by calendar arithmetic."""
    first = F.min("t").over(whole(keys))
    return panel.withColumn("time_index", period_no("t", freq) - period_no(first, freq))


def neighbours(panel: DataFrame, value: str = "y", keys=KEYS) -> DataFrame:
    """Adds ``_i``, ``_x`` and the previous and next known point (``_prev``, ``_next``)."""
    rows = panel.withColumn("_i", F.row_number().over(forward(keys))).withColumn("_x", micros_of("t"))
    point = F.when(F.col(value).isNotNull(), F.struct(
        F.col("_i").alias("i"), F.col("_x").alias("x"), F.col(value).alias("v")))
    return (rows.withColumn("_prev", F.last(point, True).over(forward(keys).rowsBetween(START, 0)))
            .withColumn("_next", F.last(point, True).over(backward(keys).rowsBetween(START, 0))))


def filled_value(value: str, strategy: str, limit: int | None) -> Column:
    """The value, or what its neighbours say about it, after ``neighbours``."""
    known, prev, nxt = F.col(value), F.col("_prev"), F.col("_next")
    if strategy == "ffill":
        return F.coalesce(known, prev["v"], nxt["v"])
    if strategy == "bfill":
        return F.coalesce(known, nxt["v"], prev["v"])
    if strategy not in ("interpolate", "time"):
        raise ValueError(f"unknown fill strategy {strategy!r}")
    axis = "x" if strategy == "time" else "i"
    here = F.col("_x") if strategy == "time" else F.col("_i")
    span = nxt[axis] - prev[axis]
    share = F.when(span != 0, (here - prev[axis]) / F.when(span != 0, span)).otherwise(0.0)
    inner = prev["v"] + (nxt["v"] - prev["v"]) * share
    near_prev = F.lit(True) if limit is None else (F.col("_i") - prev["i"]) <= limit
    near_next = F.lit(True) if limit is None else (nxt["i"] - F.col("_i")) <= limit
    return (F.when(known.isNotNull(), known)
            .when(prev.isNotNull() & nxt.isNotNull() & (near_prev | near_next), inner)
            .when(prev.isNull() & nxt.isNotNull() & near_next, nxt["v"])
            .when(nxt.isNull() & prev.isNotNull() & near_prev, prev["v"]))


def _apply(panel: DataFrame, strategy: str, limit, value: str, keys) -> DataFrame:
    return (neighbours(panel, value, keys).withColumn(value, filled_value(value, strategy, limit))
            .drop("_i", "_x", "_prev", "_next"))


def fill_forward_back(panel: DataFrame, first: str = "ffill", value: str = "y", keys=KEYS) -> DataFrame:
    return _apply(panel, first, None, value, keys)


def interpolate(panel: DataFrame, by: str = "position", limit: int | None = None, value: str = "y", keys=KEYS) -> DataFrame:
    """Linear between known points, at most ``limit`` steps from either side; edges take the nearest value."""
    return _apply(panel, "time" if by == "time" else "interpolate", limit, value, keys)


def fill_value(panel: DataFrame, how: str = "zero", value: str = "y", keys=KEYS) -> DataFrame:
    if how == "zero":
        return panel.withColumn(value, F.coalesce(value, F.lit(0.0)))
    if how != "median":
        raise ValueError("fill_value takes 'zero' or 'median'")
    median = F.percentile(value, F.lit(0.5)).over(whole(keys))
    return panel.withColumn(value, F.coalesce(F.col(value), median, F.lit(0.0)))


def fill_missing(panel: DataFrame, strategy: str, limit: int | None = None, value: str = "y", keys=KEYS) -> DataFrame:
    """One of the seven strategies; rows that stay empty are kept (``drop`` removes them)."""
    if strategy == "drop":
        return panel.where(F.col(value).isNotNull())
    if strategy in ("zero", "median"):
        return fill_value(panel, strategy, value, keys)
    if strategy in ("ffill", "bfill"):
        return fill_forward_back(panel, strategy, value, keys)
    return interpolate(panel, "time" if strategy == "time" else "position", limit, value, keys)
