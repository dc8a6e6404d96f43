"""Raw rows: parsing, cleaning, duplicates and frequency.

Everything in this module reads un-aggregated rows, where one series may hold
a third of the table.  So there is no window over a whole series here: plain
aggregates combine on the map side, and positions or gaps are found inside
hour-sized chunks of the time axis or even ranges of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import FREQ_ORDER, check_freq, micros_of, time_bucket
from ..functions.parse import MONTH_FORMATS, YEAR_FORMATS, coerce_flag_number, finite, parse_number, trim_blank, with_parsed_time
from ..spec import CleaningConfig, PanelSpec
from ._common import START, backward, forward, in_chunks, whole


def annotate_rows(df: DataFrame, spec: PanelSpec, cfg: CleaningConfig = CleaningConfig(),
                  count_mode: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse time and target; keep every row and flag what is wrong with it.

    Output: keys, ``t``, ``source_format``, ``y``, ``invalid_time``,
    ``missing_target``, ``invalid_target``, the order column and ``keep``
    (covariates; text is read as a number or a flag, e.g. ``yes``).
    In count mode each row counts 1, whatever its target.
    """
    if count_mode:
        missing, value = F.lit(False), F.lit(1.0)
    elif dict(df.dtypes)[spec.target] == "string":
        missing = trim_blank(spec.target).isNull()
        value = parse_number(spec.target, cfg.thousands)
    else:
        missing = F.col(spec.target).isNull()
        value = finite(F.col(spec.target).cast("double"))
    extra = [c for c in ((spec.order,) if spec.order else ()) + tuple(keep) if c not in spec.keys]
    kinds = dict(df.dtypes)
    read = [coerce_flag_number(c).alias(c) if c in keep and kinds[c] == "string" else F.col(c) for c in extra]
    base = with_parsed_time(df, spec.time, "_p", cfg.extra_formats).select(
        *spec.keys, *read, "_p", missing.alias("_m"), value.alias("_v"))
    ok = F.col("_p.ok")
    return base.select(
        *spec.keys, *extra,
        F.col("_p.value").alias("t"), F.col("_p.source_format").alias("source_format"),
        F.when(ok, F.col("_v")).alias("y"),
        (~ok).alias("invalid_time"),
        (ok & F.col("_m")).alias("missing_target"),
        (ok & ~F.col("_m") & F.col("_v").isNull()).alias("invalid_target"),
    )


def drop_invalid_time(df: DataFrame, on_error: str = "drop") -> DataFrame:
    """Keep rows whose time was read; with ``on_error='error'`` the query fails on the first bad one."""
    if on_error == "error":
        return df.where(F.when(F.col("invalid_time"), F.raise_error(F.lit("unparseable time value")).cast("boolean"))
                        .otherwise(F.lit(True)))
    return df.where(~F.col("invalid_time"))


def drop_missing_target(df: DataFrame, target: str = "y") -> DataFrame:
    return df.where(F.col(target).isNotNull())


# -- duplicates ---------------------------------------------------------------

def _order(spec: PanelSpec, time: str) -> Column:
    if not spec.order:
        raise ValueError("first/last need PanelSpec.order: Spark rows have no order of their own")
    return F.struct(F.col(time), F.col(spec.order))


def aggregate_of(how: str, target: str, order: Column | None = None) -> Column:
    y = F.col(target)
    if how in ("first", "last"):
        known = F.when(y.isNotNull(), order)
        return (F.min_by if how == "first" else F.max_by)(y, known)
    plain = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    if how == "count":
        return F.count(y).cast("double")
    if how not in plain:
        raise ValueError(f"unknown aggregation {how!r}")
    return plain[how](y)


def bucket_aggregate(df: DataFrame, spec: PanelSpec, how: str = "sum", covariates: tuple[str, ...] = (),
                     count_as: str | None = None) -> DataFrame:
    """Raw rows to a panel: one row per series and period, covariates averaged alongside.

    ``count_as`` names a column for the number of raw rows behind each period.

    One shuffle of partial aggregates: a hot series sends one row per period
    and map task, not its raw rows.
    """
    order = _order(spec, spec.time) if how in ("first", "last") else None
    return (df.groupBy(*spec.keys, time_bucket(spec.time, spec.freq).alias("t"))
            .agg(aggregate_of(how, spec.target, order).cast("double").alias("y"),
                 *_covariate_means(df, covariates),
                 *([F.count("*").alias(count_as)] if count_as else [])))


def resolve_duplicates(df: DataFrame, spec: PanelSpec, how: str = "mean") -> DataFrame:
    if how not in ("mean", "sum", "first", "last"):
        raise ValueError("duplicates are resolved by mean, sum, first or last")
    return bucket_aggregate(df, spec, how)


def bucket_covariates(df: DataFrame, spec: PanelSpec, columns) -> DataFrame:
    return (df.groupBy(*spec.keys, time_bucket(spec.time, spec.freq).alias("t"))
            .agg(*_covariate_means(df, columns)))


def _covariate_means(df: DataFrame, columns) -> list[Column]:
    """Mean of every covariate; text is read as a number or a flag first."""
    kinds = dict(df.dtypes)
    return [F.avg(coerce_flag_number(c) if kinds[c] == "string" else F.col(c)).alias(c) for c in columns]


def duplicate_count(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows beyond the first of each period: counted per period, then summed, so nothing is expanded."""
    per_bucket = df.groupBy(*spec.keys, time_bucket(spec.time, spec.freq).alias("_b")).agg(F.count("*").alias("_n"))
    return per_bucket.groupBy(*spec.keys).agg(
        F.sum("_n").alias("row_count"), F.count("*").alias("buckets"),
        F.sum(F.col("_n") - 1).alias("duplicates"))


# -- frequency ----------------------------------------------------------------

HOUR, DAY = 3600.0, 86400.0

# Fixed values: (upper edge in seconds, frequency or None for "irregular") of the median gap.
GAP_BANDS = (
    (1.5 * HOUR, "H"), (0.75 * DAY, None), (1.5 * DAY, "D"), (5.5 * DAY, None), (8.5 * DAY, "W"),
    (25 * DAY, None), (35 * DAY, "M"), (80 * DAY, None), (100 * DAY, "Q"), (340 * DAY, None), (390 * DAY, "Y"),
)


def _band(gap: Column) -> Column:
    """Index of the gap band; irregular bands are open at the edges they share with a named one."""
    out = None
    for i, (edge, name) in enumerate(GAP_BANDS):
        inside = gap <= edge if name else gap < edge
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out.otherwise(len(GAP_BANDS))


def _band_freq(band: Column) -> Column:
    names = F.create_map(*[x for i, (_, f) in enumerate(GAP_BANDS) if f for x in (F.lit(i), F.lit(f))])
    return F.try_element_at(names, band)


def distinct_gaps(df: DataFrame, keys, time: str = "t") -> DataFrame:
    """Seconds between consecutive distinct times of each series.

    Gaps inside an hour come from a window over (series, hour); the gap across
    an hour's end comes from a window over the hours of a series.
    """
    hour = time_bucket(time, "H")
    seen = df.where(F.col(time).isNotNull()).select(*keys, hour.alias("_h"), F.col(time).alias("_t")).distinct()
    inner = (seen.withColumn("_p", F.lag("_t").over(forward([*keys, "_h"], "_t")))
             .where(F.col("_p").isNotNull())
             .select(*keys, ((micros_of("_t") - micros_of("_p")) / 1e6).alias("gap")))
    ends = seen.groupBy(*keys, "_h").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    across = (ends.withColumn("_p", F.lag("_z").over(forward(keys, "_h")))
              .where(F.col("_p").isNotNull())
              .select(*keys, ((micros_of("_a") - micros_of("_p")) / 1e6).alias("gap")))
    return inner.unionByName(across)


def _gap_bands(df: DataFrame, keys, time: str, fmt: Column) -> DataFrame:
    """keys, _band, _n, _lo, _hi: number, least and largest of the gaps of each band; band -1 holds the rows
    (``_n``) and those of year and month formats (``_years``, ``_months``).

    One reading of the rows: they are counted per distinct time; gaps inside an hour, the edges of every hour and the counts then
    travel together, as one short row per series and hour.
    """
    item = lambda band, n, lo, hi, y, m: F.struct(band.cast("int").alias("_band"), n.cast("bigint").alias("_n"), lo.alias("_lo"), hi.alias("_hi"),
                                                  y.cast("bigint").alias("_y"), m.cast("bigint").alias("_m"))
    none, zero = F.lit(None).cast("double"), F.lit(0)
    seen = df.where(F.col(time).isNotNull()).groupBy(*keys, time_bucket(time, "H").alias("_h"), F.col(time).alias("_t")).agg(
        F.count("*").alias("_c"), F.count_if(fmt.isin(*YEAR_FORMATS)).alias("_y"), F.count_if(fmt.isin(*MONTH_FORMATS)).alias("_m"))
    inner = (micros_of("_t") - micros_of(F.lag("_t").over(forward([*keys, "_h"], "_t")))) / 1e6
    stepped = seen.withColumn("gap", inner).withColumn("_band", F.when(F.col("gap").isNotNull(), _band(F.col("gap"))))
    short = stepped.groupBy(*keys, "_h", "_band").agg(
        F.count("gap").alias("_n"), F.min("gap").alias("_lo"), F.max("gap").alias("_hi"), F.min("_t").alias("_a"), F.max("_t").alias("_z"),
        F.sum("_c").alias("_c"), F.sum("_y").alias("_y"), F.sum("_m").alias("_m"))
    hours = short.groupBy(*keys, "_h").agg(
        F.collect_list(F.when(F.col("_band").isNotNull(), item(F.col("_band"), F.col("_n"), F.col("_lo"), F.col("_hi"), zero, zero))).alias("_items"),
        F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.sum("_c").alias("_c"), F.sum("_y").alias("_y"), F.sum("_m").alias("_m"))
    across = (micros_of("_a") - micros_of(F.lag("_z").over(forward(keys, "_h")))) / 1e6
    gap = F.col("gap")
    line = hours.withColumn("gap", across).select(*keys, F.inline(F.concat(
        F.col("_items"), F.array_compact(F.array(F.when(gap.isNotNull(), item(_band(gap), F.lit(1), gap, gap, zero, zero)))),
        F.array(item(F.lit(-1), F.col("_c"), none, none, F.col("_y"), F.col("_m"))))))
    return line.groupBy(*keys, "_band").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
                                            F.sum("_y").alias("_years"), F.sum("_m").alias("_months"))


def detect_frequency(df: DataFrame, spec: PanelSpec, target: str | None = None, strict: bool = False) -> DataFrame:
    """Frequency of each series from the median gap between its distinct times.

    Output: keys, ``freq``, ``median_gap`` (exact when it lies between two
    bands, else null), ``irregular``, ``too_fine``.  The median itself is not
    computed: the counts per gap band tell which band holds the two middle
    gaps, and if they lie in different bands they are the largest gap of one
    and the smallest of the next.  So a series with billions of rows costs one
    partial aggregate of at most twelve rows.

    Series whose time text was year-only or year-month decide by format.
    ``target`` marks series whose data is coarser than the wanted frequency;
    ``strict`` fails the query for them.
    """
    keys = list(spec.keys)
    formats = "source_format" in df.columns
    fmt = F.col("source_format") if formats else F.lit(None).cast("string")
    bands = _gap_bands(df, keys, spec.time, fmt)
    gap = F.col("_band") >= 0
    known = F.when(gap, F.col("_n"))
    upto = F.sum(known).over(forward(keys, "_band").rowsBetween(START, 0))
    placed = bands.withColumns({"_upto": upto, "_all": F.sum(known).over(whole(keys))})
    # 1-based ranks of the two middle gaps
    left, right = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    before = F.col("_upto") - F.col("_n")
    holds_left = gap & (before < left) & (left <= F.col("_upto"))
    holds_right = gap & (before < right) & (right <= F.col("_upto"))
    middle = placed.groupBy(*keys).agg(
        *[F.max(F.when(~gap, F.col(c))).alias(n) for c, n in (("_n", "_rows"), ("_years", "_years"), ("_months", "_months"))],
        F.max(F.when(holds_left, F.col("_band"))).alias("_bl"), F.max(F.when(holds_left, F.col("_hi"))).alias("_vl"),
        F.max(F.when(holds_right, F.col("_band"))).alias("_br"), F.max(F.when(holds_right, F.col("_lo"))).alias("_vr"))
    split = F.col("_bl") != F.col("_br")
    median = F.when(split, (F.col("_vl") + F.col("_vr")) / 2)
    middle = middle.withColumn("median_gap", median).withColumn(
        "_band", F.when(split, _band(F.col("median_gap"))).otherwise(F.col("_bl")))

    by_gap = _band_freq(F.col("_band"))
    by_format = F.when(F.col("_years") == F.col("_rows"), "Y").when(F.col("_months") == F.col("_rows"), "M")
    enough = F.col("_rows") >= 2
    freq = F.coalesce(F.when(enough, F.coalesce(by_format, by_gap)), F.lit("D"))
    irregular = enough & by_format.isNull() & F.col("_band").isNotNull() & by_gap.isNull()
    out = middle.select(*keys, freq.alias("freq"), "median_gap", irregular.alias("irregular"))
    rank = F.create_map(*[F.lit(x) for pair in FREQ_ORDER.items() for x in pair])
    too_fine = F.lit(False) if target is None else F.lit(FREQ_ORDER[check_freq(target)]) < rank[F.col("freq")]
    out = out.withColumn("too_fine", too_fine)
    if strict:
        out = out.where(F.when(F.col("too_fine"), F.raise_error(
            F.concat(F.lit("forecast frequency is finer than the source data: "), F.col("freq"))).cast("boolean"))
            .otherwise(F.lit(True)))
    return out


# -- filling at row level -----------------------------------------------------

def fill_rows(df: DataFrame, spec: PanelSpec, strategy: str, limit: int | None = None, ranged: bool = False) -> DataFrame:
    """Fill missing targets of raw rows in time order, before bucketing.

    Runs in hour chunks: windows see one hour of one series, and only the last
    and first known value of each hour travel along the series.  ``ranged`` takes even ranges of series and time instead, which are
    staged (a job): they also cut a bulk load under one time stamp, or rows without a time.
    """
    from .fill import filled_value
    keys = list(spec.keys)
    if strategy == "drop":
        return drop_missing_target(df)
    if strategy == "zero":
        return df.withColumn("y", F.coalesce("y", F.lit(0.0)))
    if strategy == "median":
        from .quantiles import exact_quantile
        med = exact_quantile(df.where(F.col("y").isNotNull()), keys, "y", 0.5).withColumnRenamed("quantile", "_med")
        return (df.join(med, keys, "left")
                .withColumn("y", F.coalesce("y", "_med", F.lit(0.0))).drop("_med"))
    rows = chunked_neighbours(df, keys, ("t", *((spec.order,) if spec.order else ())), "y", ranged)
    value = filled_value("y", strategy, limit)
    return rows.withColumn("y", value).drop("_i", "_x", "_prev", "_next")


def chunked_neighbours(df: DataFrame, keys, order, value: str, ranged: bool = False) -> DataFrame:
    """Adds ``_i`` (position), ``_x`` (microseconds), ``_prev`` and ``_next`` known point of every row.

    Windows see one hour (or range) of one series.  Per hour, the number of rows and the
    first and last known point are carried along the series and joined back.
    """
    rows = in_chunks(df.withColumn("_x", micros_of("t")), keys, order, None if ranged else time_bucket("t", "H"))

    def point(c):
        return F.when(F.col(value).isNotNull(), F.struct(c.alias("i"), F.col("_x").alias("x"), F.col(value).alias("v")))

    rows = rows.withColumn("_pt", point(F.col("_n").cast("bigint")))
    part = ["_key", "_chunk"]
    rows = (rows.withColumn("_p", F.last("_pt", True).over(forward(part, "_n").rowsBetween(START, 0)))
            .withColumn("_q", F.last("_pt", True).over(backward(part, "_n").rowsBetween(START, 0))))

    def shifted(p):
        return F.when(F.col(p).isNotNull(), F.struct((F.col(f"{p}.i") + F.col("_before")).alias("i"), F.col(f"{p}.x").alias("x"), F.col(f"{p}.v").alias("v")))

    hours = rows.groupBy(*part).agg(F.max("_n").cast("bigint").alias("_size"), F.min("_pt").alias("_first"), F.max("_pt").alias("_last"))
    ahead, back = forward(["_key"], "_chunk").rowsBetween(START, -1), backward(["_key"], "_chunk").rowsBetween(START, -1)
    hours = hours.withColumn("_before", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    hours = hours.withColumn("_first", shifted("_first")).withColumn("_last", shifted("_last"))
    carried = hours.select(*part, "_before", F.last("_last", True).over(ahead).alias("_earlier"), F.last("_first", True).over(back).alias("_later"))
    return (rows.join(carried, part)
            .withColumn("_prev", F.coalesce(shifted("_p"), "_earlier"))
            .withColumn("_next", F.coalesce(shifted("_q"), "_later"))
            .withColumn("_i", F.col("_before") + F.col("_n"))
            .drop("_key", "_chunk", "_tie", "_n", "_pt", "_p", "_q", "_before", "_earlier", "_later"))
