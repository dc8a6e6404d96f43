"""Forecasting experiments on panels of time series, as Spark plans."""

from .plans.backtest import backtest, final_forecast
from .plans.build import build_panel
from .plans.experiment import melt_targets, run_experiment
from .spec import CleaningConfig, CovariateRole, FeatureConfig, PanelSpec, cleaning_preset

__all__ = ["CleaningConfig", "CovariateRole", "FeatureConfig", "PanelSpec", "backtest", "build_panel", "cleaning_preset",
           "final_forecast", "melt_targets", "run_experiment"]
