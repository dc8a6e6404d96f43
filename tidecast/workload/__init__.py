"""Registered queries over the test tables, each with SQL that must give the same rows."""

from .base import ORACLES, QUERIES
from . import text_and_time, rows_to_panel, windows_and_fill, models_and_scores, covariates_and_holidays  # noqa: F401
from . import reports_and_runs, learning, routing, full_models, files  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
