"""Raw rows to a clean panel with diagnostics, in the fixed order of steps:
parse, row-level fill, bucket, grid, gap fill, outliers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diagnostics import cleaning_diagnostics
from ..operators.fill import fill_missing, reindex
from ..operators.outliers import handle_outliers
from ..operators.rows import annotate_rows, bucket_aggregate, drop_invalid_time, drop_missing_target, fill_rows
from ..session import stage
from ..spec import CleaningConfig, PanelSpec


@dataclass(frozen=True)
class BuiltPanel:
    """``rows`` annotated raw rows, ``panel`` the finished series (with ``is_gap``, ``is_outlier``, ``used_rows``), ``diagnostics``."""

    rows: DataFrame
    panel: DataFrame
    diagnostics: DataFrame


def build_panel(df: DataFrame, spec: PanelSpec, cfg: CleaningConfig = CleaningConfig(), how: str | None = None, fill_raw: bool = True,
                covariates: tuple[str, ...] = (), covariate_fill: str = "ffill", staged: bool = False) -> BuiltPanel:
    """``how`` is the aggregation of raw detail rows; None means the rows are already
    aggregated and only duplicates are resolved.  ``fill_raw`` switches the row-level
    fill that runs before bucketing; gaps of the grid are filled afterwards.
    ``staged`` writes the panel once (one job), for callers that read it often.
    """
    rows = annotate_rows(df, spec, cfg, count_mode=how == "count", keep=covariates)
    timed = drop_invalid_time(rows, cfg.on_invalid_time)
    inner = PanelSpec(spec.keys, "t", "y", spec.freq, spec.order)
    if fill_raw and cfg.missing != "drop" and how != "count":
        timed = fill_rows(timed, inner, cfg.missing, cfg.limit, ranged=staged)
    panel = bucket_aggregate(drop_missing_target(timed), inner, how or cfg.duplicates, covariates, "used_rows")
    grid = reindex(panel, spec.freq, spec.keys) if cfg.fill_steps else panel.withColumn("is_gap", F.lit(False))
    filled = fill_missing(grid, cfg.missing, cfg.limit, keys=spec.keys) if cfg.fill_steps else grid
    for c in covariates:
        filled = fill_missing(filled, covariate_fill, cfg.limit, c, spec.keys)
        filled = fill_missing(filled, "ffill", None, c, spec.keys).withColumn(c, F.coalesce(c, F.lit(0.0)))
    clean = handle_outliers(drop_missing_target(filled), cfg.outliers, cfg.iqr_k, cfg.hampel_window, cfg.hampel_sigma, spec.keys)
    if staged:
        clean = stage(clean)
    return BuiltPanel(rows, clean, cleaning_diagnostics(rows, clean, spec, adjusted=cfg.outliers != "none"))
