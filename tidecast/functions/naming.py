"""Names and rates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import _col

# Spellings of calendar covariates and of calendar features.
COVARIATE_ALIASES = {
    "weekday": "weekday", "dayofweek": "weekday", "dayweek": "weekday",
    "month": "month", "quarter": "quarter",
    "weekend": "weekend", "isweekend": "weekend",
    "workday": "workday", "isworkday": "workday", "businessday": "workday",
    "holiday": "holiday", "isholiday": "holiday",
}
FEATURE_ALIASES = {"dayofweek": "weekday", "timeofdayweek": "weekday"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def plain_name(c) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]", "")


def canonical_name(c) -> Column:
    """The calendar field a covariate name stands for, or null."""
    return F.try_element_at(_map(COVARIATE_ALIASES), plain_name(c))


def feature_key(c) -> Column:
    """Comparable feature name: a known alias, else the plain name."""
    return F.coalesce(F.try_element_at(_map(FEATURE_ALIASES), plain_name(c)), plain_name(c))


def rate(num, den) -> Column:
    """num/den to four places, half to even; 0 when there is nothing to divide by."""
    num, den = _col(num).cast("double"), _col(den).cast("double")
    return F.when(den > 0, F.bround(num / F.when(den > 0, den), 4)).otherwise(0.0)


def percent(c) -> Column:
    return F.format_string("%.1f%%", _col(c) * 100)


def texts(*items: Column) -> Column:
    """ARRAY<STRING> of the non-null messages, in order."""
    return F.array_compact(F.array(*items)).cast("array<string>")
