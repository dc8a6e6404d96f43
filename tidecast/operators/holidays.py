"""Holiday features from a calendar table (``date``, ``name`` and any columns named in ``on``).

The range and as-of joins need no theta join: the holidays and the first day
and end day of every distinct period are put on one time line per calendar.
Running windows over it give the holiday before, the holiday after and the
number of holidays before each day; the difference between a period's end and
start is the count inside.  The line is bounded by the calendar: it grows with
the periods covered, not with the series or rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import EPOCH, next_period
from ..spec import KEYS
from ._common import START

FEATURES = ("holiday_is_period", "holiday_count", "holiday_days_since_previous", "holiday_days_to_next", "holiday_is_window")
FAR = 366  # fixed value: days reported when no holiday is that close


def holiday_features(panel: DataFrame, calendar: DataFrame, freq: str, window_days: int = 1, on=()) -> DataFrame:
    """The panel with the five holiday columns."""
    on = list(on)

    def day_no(c):
        return F.datediff(c.cast("date"), F.lit(EPOCH).cast("date"))

    edges = F.array(F.struct(day_no(F.col("t")).alias("day"), F.lit(0).alias("role")),
                    F.struct(day_no(next_period("t", freq)).alias("day"), F.lit(1).alias("role")))
    marks = panel.select(*on, "t").distinct().select(*on, "t", F.explode(edges).alias("_e")).select(*on, "t", "_e.*")
    named = calendar.select(*on, F.lit(None).cast("timestamp_ntz").alias("t"), day_no(F.col("date")).alias("day"), F.lit(2).alias("role")).distinct()
    by = list(on) or [F.lit("calendar")]
    hol = F.when(F.col("role") == 2, F.col("day"))
    ahead, back = W.partitionBy(*by).orderBy("day"), W.partitionBy(*by).orderBy(-F.col("day"))
    line = marks.unionByName(named).withColumns({
        "_prev": F.max(hol).over(ahead.rangeBetween(START, 0)), "_before": F.count(hol).over(ahead.rangeBetween(START, -1)),
        "_next": F.min(hol).over(back.rangeBetween(START, 0))})

    def at(role, value):
        return F.max(F.when(F.col("role") == role, value))

    since = F.coalesce(F.least(F.col("day") - F.col("_prev"), F.lit(FAR)), F.lit(FAR))
    until = F.coalesce(F.least(F.col("_next") - F.col("day"), F.lit(FAR)), F.lit(FAR))
    per_time = line.where(F.col("role") < 2).groupBy(*on, "t").agg(
        (at(1, F.col("_before")) - at(0, F.col("_before"))).cast("double").alias("_count"),
        at(0, since).cast("double").alias("_since"), at(0, until).cast("double").alias("_until"))
    values = (F.when(F.col("_count") > 0, 1.0).otherwise(0.0), F.col("_count"), F.col("_since"), F.col("_until"),
              F.when(F.least("_since", "_until") <= window_days, 1.0).otherwise(0.0))
    return panel.join(per_time.select(*on, "t", *[v.alias(n) for v, n in zip(values, FEATURES)]), [*on, "t"], "left")


def holiday_range(panel, calendar, freq, on=()):
    return holiday_features(panel, calendar, freq, on=on).drop(*FEATURES[2:])


def holiday_distance(panel, calendar, window_days: int = 1, freq: str = "D", on=()):
    return holiday_features(panel, calendar, freq, window_days, on).drop(*FEATURES[:2])


def holiday_markers(panel: DataFrame, calendar: DataFrame, freq: str = "D", on=(), keys=KEYS) -> DataFrame:
    """Named holidays between the first and the end of the last period of each series.

    Each series joins the calendar on the years it covers; the exact bounds
    are a filter after that equi join.
    """
    on = list(on)
    span = panel.groupBy(*keys, *on).agg(F.min("t").cast("date").alias("_a"), next_period(F.max("t"), freq).cast("date").alias("_z"))
    years = span.withColumn("_year", F.explode(F.sequence(F.year("_a"), F.year("_z"))))
    named = calendar.select(*on, F.col("date").cast("date").alias("date"), "name").withColumn("_year", F.year("date"))
    return (years.join(named, [*on, "_year"]).where((F.col("date") >= F.col("_a")) & (F.col("date") < F.col("_z")))
            .select(*keys, *on, F.col("date").cast("timestamp_ntz").alias("t"), "name"))
