"""Settings records and the panel contract shared by every operator.

A *panel* is a DataFrame with one or more series key columns, a period start
``t`` (TIMESTAMP_NTZ) and a value ``y`` (DOUBLE).  After bucketing, a series
holds at most one row per period, so its length is bounded by the calendar
(the finest step is one hour, 8 766 rows a year) no matter how many raw rows
it was built from.  Operators that window over a whole series rely on that
bound; operators that read raw rows do not.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

KEYS = ("series_id",)

MISSING_STRATEGIES = ("drop", "zero", "ffill", "bfill", "interpolate", "time", "median")
OUTLIER_STRATEGIES = ("none", "clip_iqr", "hampel")
AGGREGATIONS = ("sum", "mean", "count", "max", "min", "first", "last")


@dataclass(frozen=True)
class PanelSpec:
    """Names the series keys, the time column, the target and the frequency.

    ``order`` breaks ties between raw rows with the same time stamp; Spark has
    no row order of its own, so ``first`` and ``last`` need it.
    """

    keys: tuple[str, ...] = KEYS
    time: str = "t"
    target: str | None = "y"
    freq: str = "D"
    order: str | None = None


@dataclass(frozen=True)
class CleaningConfig:
    trim: bool = True
    thousands: bool = True
    on_invalid_time: str = "drop"
    missing: str = "time"
    limit: int | None = 3
    fill_steps: bool = True
    duplicates: str = "mean"
    outliers: str = "none"
    iqr_k: float = 1.5
    hampel_window: int = 7
    hampel_sigma: float = 3.0
    extra_formats: tuple[str, ...] = ()  # further time patterns, tried after the built-in ones

    def __post_init__(self):
        if self.missing not in MISSING_STRATEGIES:
            raise ValueError(f"unknown missing-value strategy {self.missing!r}")
        if self.outliers not in OUTLIER_STRATEGIES:
            raise ValueError(f"unknown outlier strategy {self.outliers!r}")
        if self.on_invalid_time not in ("drop", "error"):
            raise ValueError("on_invalid_time is 'drop' or 'error'")


# The three cleaning presets.
CLEANING_PRESETS = {
    "conservative": CleaningConfig(missing="drop", limit=None, fill_steps=False),
    "standard": CleaningConfig(missing="time", limit=3),
    "strict": CleaningConfig(missing="time", limit=7, outliers="hampel"),
}


def cleaning_preset(name: str, **changes) -> CleaningConfig:
    return replace(CLEANING_PRESETS[name], **changes)


@dataclass(frozen=True)
class CovariateRole:
    name: str
    kind: str = "static"  # or "known_future"
    backtest: str = "repeat_last_known"  # or "historical_mean", "use_test_values"
    missing: str = "ffill"


@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 2, 3, 7)
    means: tuple[int, ...] = (3, 7)
    stds: tuple[int, ...] = (7,)
    calendar: bool = True
    holidays: bool = True
    covariates: tuple[str, ...] = ()

    @property
    def warmup(self) -> int:
        return 7 if (self.lags or self.means or self.stds) else 1
