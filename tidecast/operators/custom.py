"""User forecasters: a function on the pandas frame of one series."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import KEYS

REGISTERED: dict[str, Callable[[pd.DataFrame, int], pd.DataFrame]] = {}


def register_forecaster(name: str, fn: Callable[[pd.DataFrame, int], pd.DataFrame]) -> None:
    """``fn(history, horizon)`` gets t and y of one series in order and returns ``predicted`` (optionally lower, upper)."""
    REGISTERED[name] = fn


def run_forecaster(name: str, panel: DataFrame, horizon: int, keys=KEYS) -> DataFrame:
    """keys, model_id, step, predicted, lower, upper, error.

    Series go to Arrow-backed tasks by key.  A series whose function fails
    gives one row with ``error`` set instead of failing the job.
    """
    fn, keys = REGISTERED[name], list(keys)
    key_types = ", ".join(f"{k} {dict(panel.dtypes)[k]}" for k in keys)
    schema = f"{key_types}, model_id string, step int, predicted double, lower double, upper double, error string"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        head = dict(zip(keys, key)) | {"model_id": name}
        try:
            out = fn(pdf.sort_values("t")[["t", "y"]].reset_index(drop=True), horizon)
            if len(out) != horizon:
                raise ValueError(f"{len(out)} predictions for a horizon of {horizon}")
            rows = pd.DataFrame({"step": range(1, horizon + 1), "predicted": out["predicted"].astype(float).to_numpy()})
            for c in ("lower", "upper"):
                rows[c] = out[c].astype(float).to_numpy() if c in out else float("nan")
            rows["error"] = None
        except Exception as exc:  # noqa: BLE001 - user code
            rows = pd.DataFrame([{"step": 0, "predicted": float("nan"), "lower": float("nan"), "upper": float("nan"), "error": str(exc)}])
        return rows.assign(**head)[[*keys, "model_id", "step", "predicted", "lower", "upper", "error"]]

    known = panel.where(F.col("y").isNotNull()).select(*keys, "t", "y")
    return known.groupBy(*keys).applyInPandas(one, schema)
