"""Outliers, anomalies and changes inside the series of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import KEYS
from ._common import forward, whole

# Fixed value: MAD of a normal distribution to its standard deviation.
MAD_SCALE = 1.4826


def hampel(panel: DataFrame, window: int = 7, sigma: float = 3.0, keys=KEYS) -> DataFrame:
    """Replace points far from their centred rolling median.

    The frame holds at most ``window`` rows, so ``percentile`` over it is
    bounded.  Adds ``is_outlier``.  Series under four points stay as they are.
    """
    width = max(3, int(window))
    width += 1 - width % 2
    need = max(3, width // 2)
    frame = forward(keys).rowsBetween(-(width // 2), width // 2)

    def rolling_median(c):
        return F.when(F.count(c).over(frame) >= need, F.percentile(c, F.lit(0.5)).over(frame))

    rows = panel.withColumn("_med", rolling_median("y"))
    rows = rows.withColumn("_dev", F.abs(F.col("y") - F.col("_med")))
    rows = rows.withColumn("_cut", rolling_median("_dev") * MAD_SCALE * float(sigma))
    enough = F.count("*").over(whole(keys)) >= 4
    spike = F.coalesce(enough & (F.col("_cut") > 0) & (F.col("_dev") > F.col("_cut")), F.lit(False))
    return (rows.withColumn("is_outlier", spike)
            .withColumn("y", F.when(F.col("is_outlier"), F.col("_med")).otherwise(F.col("y")))
            .drop("_med", "_dev", "_cut"))


def iqr_outliers(panel: DataFrame, k: float = 1.5, clip: bool = False, approximate: bool = False, keys=KEYS) -> DataFrame:
    """Quartile fences per series; adds ``is_outlier`` and optionally clips."""
    quart = F.array(F.lit(0.25), F.lit(0.75))
    q = F.percentile_approx("y", quart, 10000) if approximate else F.percentile("y", quart)
    rows = panel.withColumn("_q", q.over(whole(keys))).withColumn("_n", F.count("*").over(whole(keys)))
    spread = F.col("_q")[1] - F.col("_q")[0]
    low, high = F.col("_q")[0] - spread * k, F.col("_q")[1] + spread * k
    usable = (F.col("_n") >= 4) & (spread > 0)
    out = F.coalesce(usable & ((F.col("y") < low) | (F.col("y") > high)), F.lit(False))
    rows = rows.withColumn("is_outlier", out)
    if clip:
        rows = rows.withColumn("y", F.when(F.col("is_outlier"), F.least(F.greatest("y", low), high)).otherwise(F.col("y")))
    return rows.drop("_q", "_n")


def handle_outliers(panel: DataFrame, strategy: str, k: float = 1.5, window: int = 7, sigma: float = 3.0, keys=KEYS) -> DataFrame:
    """'none' counts by quartile fences, 'clip_iqr' also clips, 'hampel' replaces."""
    if strategy == "hampel":
        return hampel(panel, window, sigma, keys)
    return iqr_outliers(panel, k, clip=strategy == "clip_iqr", keys=keys)


def zscore_anomalies(panel: DataFrame, z: float = 2.0, k: int = 12, keys=KEYS) -> DataFrame:
    """The ``k`` points per series with the largest |z| of at least ``z``; nulls are ignored."""
    w = whole(keys)
    mean, dev = F.avg("y").over(w), F.stddev_pop("y").over(w)
    scored = panel.where(F.col("y").isNotNull()).withColumn("_m", mean).withColumn("_s", dev)
    scored = scored.where(F.col("_s") > 0).withColumn("zscore", (F.col("y") - F.col("_m")) / F.col("_s"))
    pos = F.row_number().over(w.orderBy(F.abs("zscore").desc(), "t"))
    return (scored.where(F.abs("zscore") >= z).withColumn("place", pos).where(F.col("place") <= k)
            .select(*keys, "t", "y", "zscore", "place"))


def period_change(panel: DataFrame, periods: int = 1, k: int | None = 10, keys=KEYS) -> DataFrame:
    """Relative change against the known value ``periods`` before; the ``k`` largest per series."""
    known = panel.where(F.col("y").isNotNull())
    prev = F.lag("y", periods).over(forward(keys))
    rows = known.withColumn("_p", prev).where(F.col("_p") != 0)
    rows = rows.withColumn("change", (F.col("y") - F.col("_p")) / F.abs("_p"))
    if k is None:
        return rows.select(*keys, "t", "y", "change")
    pos = F.row_number().over(whole(keys).orderBy(F.abs("change").desc(), "t"))
    return rows.withColumn("place", pos).where(F.col("place") <= k).select(*keys, "t", "y", "change", "place")
