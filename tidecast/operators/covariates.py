"""Covariates: alignment, roles and the rows a forecast may read.

The long form is (keys, t, name, value).  Roles are a short Python list, so
they enter plans as literals; no cross join is needed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import time_bucket
from ..functions.naming import COVARIATE_ALIASES
from ..functions.parse import coerce_flag_number, finite
from ..spec import KEYS, CovariateRole, PanelSpec
from .holidays import FEATURES


def canonical(name: str) -> str | None:
    return COVARIATE_ALIASES.get("".join(ch for ch in name.strip().lower() if ch.isalnum()))


def resolve_roles(columns: Iterable[str], roles: Iterable[CovariateRole] = ()) -> list[CovariateRole]:
    """Configured roles, and by name for the rest: calendar fields are known ahead."""
    given = {r.name: r for r in roles}
    return [given.get(c) or CovariateRole(c, "known_future" if canonical(c) else "static") for c in columns]


def attach_covariates(panel: DataFrame, cov: DataFrame, keys=KEYS) -> DataFrame:
    return panel.join(cov, [*keys, "t"], "left")


def to_long(panel: DataFrame, columns, keys=KEYS) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return panel.select(*keys, "t", F.explode(items).alias("_c")).select(*keys, "t", "_c.*")


def historical_mean(cov: DataFrame, keys=KEYS) -> DataFrame:
    return cov.groupBy(*keys, "name").agg(F.avg(finite("value")).alias("mean"))


def future_rows(rows: DataFrame, spec: PanelSpec, covariates) -> DataFrame:
    """Known inputs after the end of each history: rows with an empty target, averaged per period.

    ``rows`` are annotated rows.  They are reduced to sums per period before
    the history end is joined, so the join never sees raw rows.
    """
    keys = list(spec.keys)
    bucket = time_bucket("t", spec.freq)
    timed = rows.where(F.col("t").isNotNull())
    ends = timed.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.max(bucket).alias("_end"))
    value = {c: coerce_flag_number(c) if dict(rows.dtypes)[c] == "string" else finite(F.col(c).cast("double")) for c in covariates}
    sums = timed.where(F.col("missing_target")).groupBy(
        *keys, bucket.alias("_b"), (F.col("t") > bucket).alias("_inside")).agg(
        *[F.sum(v).alias(f"_s_{c}") for c, v in value.items()], *[F.count(v).alias(f"_n_{c}") for c, v in value.items()])
    after = (F.col("_b") > F.col("_end")) | ((F.col("_b") == F.col("_end")) & F.col("_inside"))
    late = sums.join(ends, keys).where(after)
    mean = {c: F.sum(f"_s_{c}") / F.when(F.sum(f"_n_{c}") > 0, F.sum(f"_n_{c}")) for c in covariates}
    return late.groupBy(*keys, F.col("_b").alias("t")).agg(*[m.alias(c) for c, m in mean.items()])


def _generated(role: CovariateRole, t: Column) -> Column | None:
    field = canonical(role.name)
    weekend = F.weekday(t) >= 5
    return {
        "weekday": F.weekday(t).cast("double"), "month": F.month(t).cast("double"), "quarter": F.quarter(t).cast("double"),
        "weekend": F.when(weekend, 1.0).otherwise(0.0), "workday": F.when(weekend, 0.0).otherwise(1.0),
        "holiday": F.when(weekend, 1.0).otherwise(0.0),
    }.get(field) if field else None


def future_covariates(history: DataFrame, axis: DataFrame, roles: Iterable[CovariateRole], purpose: str = "forecast",
                      observed: DataFrame | None = None, holidays: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """Covariate values of every future step: keys, step, t, name, value, missing.

    ``axis`` has keys, step, t; ``observed`` has keys, step, name, value;
    ``holidays`` has keys, t and the holiday columns.  ``missing`` marks known
    inputs that nobody supplied; callers write them to an error table.
    """
    roles, keys = list(roles), list(keys)
    steps = axis if holidays is None else axis.join(holidays.select(*keys, "t", *FEATURES), [*keys, "t"], "left")

    def known(role: CovariateRole) -> Column:
        if role.name in FEATURES:
            return F.col(role.name) if holidays is not None else F.lit(None).cast("double")
        if role.kind != "known_future":
            return F.lit(None).cast("double")
        if canonical(role.name) == "holiday" and holidays is not None:
            return F.col(FEATURES[0])
        made = _generated(role, F.col("t"))
        return made if made is not None else F.lit(None).cast("double")

    items = F.array(*[F.struct(
        F.lit(r.name).alias("name"), F.lit(r.kind).alias("kind"), F.lit(r.backtest).alias("how"),
        F.lit(r.name in FEATURES).alias("is_holiday"), known(r).alias("made")) for r in roles])
    want = steps.select(*keys, "step", "t", F.explode(items).alias("_r")).select(*keys, "step", "t", "_r.*")

    past = history.groupBy(*keys, "name").agg(
        F.max_by("value", "t").alias("_last"), F.avg(finite("value")).alias("_mean"))
    out = want.join(past, [*keys, "name"], "left")
    if observed is None:
        out = out.withColumn("_seen", F.lit(None).cast("double"))
    else:
        out = out.join(observed.select(*keys, "step", "name", finite("value").alias("_seen")), [*keys, "step", "name"], "left")
    how, last = F.col("how"), finite("_last")
    if purpose == "backtest":
        static = (F.when(how == "use_test_values", F.coalesce("_seen", last))
                  .when(how == "historical_mean", F.coalesce("_mean", last)).otherwise(last))
    elif purpose == "forecast":
        static = last
    else:
        raise ValueError("purpose is 'backtest' or 'forecast'")
    ahead = F.col("kind") == "known_future"
    value = F.when(F.col("is_holiday"), F.col("made")).when(ahead, F.coalesce("made", "_seen")).otherwise(static)
    missing = ahead & ~F.col("is_holiday") & value.isNull()
    return out.select(*keys, "step", "t", "name", F.when(missing, F.lit(None)).otherwise(F.coalesce(value, F.lit(0.0))).alias("value"),
                      missing.alias("missing"))


def covariate_roles(cov: DataFrame, roles: Iterable[CovariateRole], keys=KEYS) -> DataFrame:
    """Role, strategies and leakage risk of every series and covariate, with its counts."""
    def strategy(r: CovariateRole):
        if r.kind == "known_future":
            ahead = "calendar" if canonical(r.name) else "use_future_rows"
            return ahead, "use_test_timeline", False, "known ahead: read from the test or future time axis"
        note = {"historical_mean": "static: the back-test uses the mean of the training part",
                "use_test_values": "static: the back-test reads test values, which leaks the future"}.get(
                    r.backtest, "static: the last known value is repeated")
        return "repeat_last_known", r.backtest, r.backtest == "use_test_values", note

    table = F.create_map(*[x for r in roles for x in (F.lit(r.name), F.struct(
        F.lit(r.kind).alias("kind"), *[F.lit(v).alias(n) for n, v in zip(
            ("forecast_strategy", "backtest_strategy", "leakage_risk", "note"), strategy(r))]))])
    counts = cov.groupBy(*keys, "name").agg(F.count("*").alias("points"), F.count_if(F.col("value").isNull()).alias("missing"))
    return counts.withColumn("_r", F.try_element_at(table, F.col("name"))).where(F.col("_r").isNotNull()).select(
        *keys, "name", "points", "missing", "_r.*")


def leakage_count(roles: DataFrame, keys=KEYS) -> DataFrame:
    return roles.groupBy(*keys).agg(F.count("*").alias("covariates"), F.count_if("leakage_risk").alias("at_risk"))
