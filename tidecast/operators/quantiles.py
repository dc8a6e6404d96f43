"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task.  That is fine
for a bucketed series and wrong for raw rows.  Here the rows are sorted once by
group and value over range partitions, so a hot group spreads over as many
tasks as it fills; the place of any rank then follows from the row counts of
(partition, group), whatever the distribution of the values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from ._common import START, forward, whole

PART_BITS = 33  # fixed value: monotonically_increasing_id counts rows below this bit and partitions above


def exact_quantiles(df: DataFrame, keys, value: str, qs: Iterable[float]) -> DataFrame:
    """keys, q, quantile: linear-interpolated quantiles per group, all in one pass (runs a job).

    The sorted rows are staged once, since their places must stay the same while they are looked up.  Null values are
    left out; null keys are groups of their own.
    """
    keys = list(keys)
    whole_row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")])
    data = df.select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"), whole_row.alias("_h")).where(F.col("_v").isNotNull())
    # rows of one value, however many, are cut by their hash
    ranged = data.repartitionByRange("_k", "_v", "_h").drop("_h").sortWithinPartitions("_k", "_v")
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy("_k", F.shiftright("_at", PART_BITS).alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(forward(["_k"], "_part").rowsBetween(START, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_all": F.sum("_n").over(whole(["_k"]))})
    asked = parts.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    place = (F.col("_all") - 1) * F.col("q")
    low = F.floor(place).cast("bigint")
    sides = F.array(F.struct(low.alias("rank"), (1 - (place - low)).alias("share")),
                    F.struct(F.least(low + 1, F.col("_all") - 1).alias("rank"), (place - low).alias("share")))
    ranks = asked.select("_k", "q", "_first", "_before", "_n", F.inline(sides)).where(
        (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
    hits = ranks.select("_k", "q", "share", (F.col("_first") + F.col("rank") - F.col("_before")).alias("_at"))
    found = hits.join(placed.select("_at", "_v"), "_at")
    # a + (b - a) * share keeps equal neighbours exact
    a, b = F.min("_v"), F.max("_v")
    out = found.groupBy("_k", "q").agg((a + (b - a) * F.max_by("share", F.struct("_v", "_at"))).alias("quantile"))
    return out.select("_k.*", "q", "quantile")


def exact_quantile(df: DataFrame, keys, value: str, q: float) -> DataFrame:
    """keys, quantile: one exact quantile per group."""
    return exact_quantiles(df, keys, value, (q,)).drop("q")
