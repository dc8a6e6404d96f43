"""Period arithmetic on TIMESTAMP_NTZ columns.

Nothing here passes through TIMESTAMP, so results do not depend on the session
time zone or on daylight-saving changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The frequencies from fine to coarse, and their default seasons.
FREQ_ORDER = {"H": 0, "D": 1, "W": 2, "M": 3, "Q": 4, "Y": 5}
SEASON = {"H": 24, "D": 7, "W": 52, "M": 12, "Q": 4, "Y": 1}

EPOCH = "1970-01-01"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_freq(freq: str) -> str:
    if freq not in FREQ_ORDER:
        raise ValueError(f"frequency must be one of {'/'.join(FREQ_ORDER)}, got {freq!r}")
    return freq


def ntz(c) -> Column:
    return _col(c).cast("timestamp_ntz")


def midnight(c) -> Column:
    return _col(c).cast("date").cast("timestamp_ntz")


def hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def days(n) -> Column:
    return F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


def months(n) -> Column:
    return F.make_ym_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def time_bucket(c, freq: str) -> Column:
    """Start of the period that holds ``c``; weeks start on Monday."""
    c = _col(c)
    check_freq(freq)
    if freq == "H":
        return midnight(c) + hours(F.hour(c))
    if freq == "D":
        return midnight(c)
    day = c.cast("date")
    if freq == "W":
        return F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
    unit = {"M": "month", "Q": "quarter", "Y": "year"}[freq]
    return F.trunc(day, unit).cast("timestamp_ntz")


def next_period(c, freq: str, n=1) -> Column:
    """Start of the ``n``-th following period (``n`` may be a column)."""
    c = _col(c)
    n = (n if isinstance(n, Column) else F.lit(n)).cast("int")
    check_freq(freq)
    if freq == "H":
        return c + hours(n)
    if freq == "D":
        return c + days(n)
    if freq == "W":
        return c + days(n * 7)
    per = {"M": 1, "Q": 3, "Y": 12}[freq]
    return time_bucket(c, freq) + months(n * per)


def period_no(c, freq: str) -> Column:
    """Consecutive integer number of the period, so gaps are differences."""
    c = _col(c)
    check_freq(freq)
    day = F.datediff(c.cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")
    if freq == "H":
        return day * 24 + F.hour(c)
    if freq == "D":
        return day
    if freq == "W":
        return F.floor((day + 3) / 7)
    month = F.year(c).cast("bigint") * 12 + F.month(c) - 1
    if freq == "M":
        return month
    if freq == "Q":
        return F.floor(month / 3)
    return F.year(c).cast("bigint")


def micros_of(c) -> Column:
    """Microseconds since the epoch as BIGINT, so that differences are exact."""
    c = _col(c)
    day = F.datediff(c.cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")
    minutes = (day * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def seconds_of(c) -> Column:
    """Seconds since the epoch as DOUBLE, with the fraction."""
    return micros_of(c) / 1e6


def calendar_fields(df: DataFrame, time_col: str = "t") -> DataFrame:
    """weekday (Monday 0), month, quarter, weekend and workday flags."""
    t = F.col(time_col)
    weekday = F.weekday(t)
    return df.withColumns({
        "weekday": weekday,
        "month": F.month(t),
        "quarter": F.quarter(t),
        "weekend": F.when(weekday >= 5, 1.0).otherwise(0.0),
        "workday": F.when(weekday < 5, 1.0).otherwise(0.0),
    })


def time_label(c, style: str = "minute") -> Column:
    """Short display label: to the minute, or month-day with a non-midnight time."""
    c = _col(c)
    if style == "minute":
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit("—"))
    at_midnight = (F.hour(c) == 0) & (F.minute(c) == 0)
    return F.when(at_midnight, F.date_format(c, "MM-dd")).otherwise(F.date_format(c, "MM-dd HH:mm"))
