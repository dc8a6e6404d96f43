"""Cleaning counters and the data-health report of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_no, seconds_of
from ..functions.naming import percent, rate, texts
from ..spec import PanelSpec


def cleaning_diagnostics(rows: DataFrame, panel: DataFrame, spec: PanelSpec, adjusted: bool = False) -> DataFrame:
    """Counters of one series per row.

    ``rows`` are annotated raw rows; they are read once, as partial counts.
    Everything else comes from the finished ``panel``, which carries
    ``used_rows`` (raw rows per period), ``is_gap`` and ``is_outlier``: its
    periods that are not gaps are the distinct buckets, and the gaps are the
    rest of its calendar span.
    """
    keys = list(spec.keys)
    raw = rows.groupBy(*keys).agg(
        F.count("*").alias("original_rows"),
        F.count_if("invalid_time").alias("invalid_time"),
        F.count_if("missing_target").alias("missing_target"),
        F.count_if("invalid_target").alias("invalid_target"),
        F.count_if(F.col("y").isNotNull()).alias("known_rows"))
    span = period_no(F.max("t"), spec.freq) - period_no(F.min("t"), spec.freq) + 1
    done = panel.groupBy(*keys).agg(
        F.count("*").alias("valid_points"), F.sum("used_rows").alias("used_rows"),
        F.count_if(~F.col("is_gap")).alias("_buckets"), F.count_if("is_gap").alias("_filled_gaps"), span.alias("_span"),
        F.count_if("is_outlier").alias("outliers"), F.min("t").alias("time_start"), F.max("t").alias("time_end"))
    joined = raw.join(done, keys, "left")

    def n(c):
        return F.coalesce(F.col(c), F.lit(0))

    return joined.select(
        *keys, "original_rows", n("valid_points").alias("valid_points"),
        (F.col("original_rows") - n("used_rows")).alias("dropped_rows"),
        (n("used_rows") - n("_buckets")).alias("duplicate_time"),
        (n("_span") - n("_buckets")).alias("missing_time"), "invalid_time", "missing_target", "invalid_target",
        (n("used_rows") - F.least(F.col("known_rows"), n("used_rows")) + n("_filled_gaps")).alias("filled"),
        n("outliers").alias("outliers"), (n("outliers") if adjusted else F.lit(0).cast("bigint")).alias("outliers_adjusted"),
        "time_start", "time_end")


def data_health(diagnostics: DataFrame, horizon: int, test_size: int, keys=("series_id",)) -> DataFrame:
    """Score 0-100, level, rates, flags, warnings and suggestions; expressions over one row per series."""
    d = {c: F.col(c) for c in diagnostics.columns}
    points = F.greatest(d["valid_points"], F.lit(0))
    test = F.least(F.lit(max(test_size, 0)), points)
    train = points - test
    rows = F.greatest(d["original_rows"], F.lit(1))
    known = F.greatest(points, F.lit(1))
    span = F.greatest(points + d["missing_time"], F.lit(1))
    bad_target = d["missing_target"] + d["invalid_target"]
    rates = {
        "invalid_time_rate": rate(d["invalid_time"], rows),
        "target_missing_rate": rate(bad_target, rows),
        "duplicate_time_rate": rate(d["duplicate_time"], known),
        "missing_time_rate": rate(d["missing_time"], span),
        "outlier_rate": rate(d["outliers"], known),
        "dropped_row_rate": rate(d["dropped_rows"], rows),
        "continuity": rate(points, span),
    }
    wanted = max(24, max(test_size, 1) * 3)
    flags = {
        "train_points": train, "test_points": test,
        "continuous": d["missing_time"] == 0,
        "train_sufficient": train >= wanted,
        "test_reasonable": (points == 0) | ((test >= 3) & (test <= F.greatest(F.lit(8), F.floor(points / 3)))),
    }
    out = diagnostics.withColumns(rates | flags)

    def penalty(c, weight):
        return F.bround(F.col(c) * weight, 0)

    gap_cost = F.least(F.lit(15.0), F.greatest(F.lit(5.0), penalty("missing_time_rate", 100)))
    short = F.when(points < 30, 20).when(~F.col("train_sufficient"), 10).otherwise(0)
    score = (F.lit(100) - penalty("invalid_time_rate", 500) - penalty("target_missing_rate", 400)
             - penalty("duplicate_time_rate", 300) - penalty("outlier_rate", 200)
             - F.when(d["missing_time"] > 0, gap_cost).otherwise(0.0) - short
             - F.when(F.col("test_reasonable"), 0).otherwise(8))
    out = out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))
    s = F.col("score")
    level = F.when(s >= 90, "excellent").when(s >= 75, "good").when(s >= 60, "fair").otherwise("poor")

    def say(cond, template, *args):
        return F.when(cond, F.format_string(template, *args))

    few = points < 30
    thin = ~few & ~F.col("train_sufficient")
    odd = ~F.col("test_reasonable")
    warnings = texts(
        say(d["invalid_time"] > 0, "%d unreadable time values (%s)", d["invalid_time"], percent("invalid_time_rate")),
        say(bad_target > 0, "%d missing or unreadable targets (%s)", bad_target, percent("target_missing_rate")),
        say(d["duplicate_time"] > 0, "%d duplicate time points (%s)", d["duplicate_time"], percent("duplicate_time_rate")),
        say(d["missing_time"] > 0, "%d gaps on the regular axis, coverage %s", d["missing_time"], percent("continuity")),
        say(d["outliers"] > 0, "%d outliers (%s)", d["outliers"], percent("outlier_rate")),
        say(few, "only %d valid points", points),
        say(thin, "training part has %d points, fewer than " + str(wanted), train),
        say(odd, "test part of %d points does not suit %d points in all", test, points))
    suggestions = texts(
        F.when(d["invalid_time"] > 0, "use one time format"),
        F.when(bad_target > 0, "interpolate or forward-fill the target"),
        F.when(d["duplicate_time"] > 0, "check how duplicate times are aggregated"),
        F.when((d["missing_time"] > 0) & (d["filled"] == 0), "fill missing periods and compare"),
        F.when((d["missing_time"] > 0) & (d["filled"] > 0), "check that filled values keep season and peaks"),
        F.when((d["outliers"] > 0) & (d["outliers_adjusted"] == 0), "clip outliers"),
        F.when((d["outliers_adjusted"] > 0) & (d["outliers_adjusted"] < d["outliers"]), "review outliers left as they are"),
        F.when(few, "add history or use a coarser frequency"),
        F.when(thin, "train longer or test shorter"),
        F.when(odd, "keep the test part at 10-30 % and at least three points"))
    days = F.bround((seconds_of("time_end") - seconds_of("time_start")) / 86400, 2)
    return out.withColumns({"level": level, "warnings": warnings, "suggestions": suggestions,
                            "span_days": days, "horizon": F.lit(horizon)})
