"""Dirty text to typed values.

Each pattern is guarded by a regular expression and then read by one
``try_cast``, so a row is parsed once, a bad row costs no exception, and every
expression stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .calendar import _col

PARSED_TYPE = "struct<ok:boolean,value:timestamp_ntz,source_format:string>"

BLANKS = " \t\n\r\f\u000b"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# The accepted time patterns with their labels.
PATTERNS = (
    ("datetime_dash", r"^\d{4}-\d{1,2}-\d{1,2} +\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("datetime_slash", r"^\d{4}/\d{1,2}/\d{1,2} +\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("datetime_iso", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("date_dash", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("date_slash", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("date_dot", r"^\d{4}\.\d{1,2}\.\d{1,2}$"),
    ("year_month_dash", r"^\d{4}-\d{1,2}$"),
    ("year_month_slash", r"^\d{4}/\d{1,2}$"),
    ("year_only", r"^\d{4}$"),
)
CHINESE = (
    ("date_chinese", r"^\d{4}年\d{1,2}月\d{1,2}日$"),
    ("year_month_chinese", r"^\d{4}年\d{1,2}月$"),
)
YEAR_FORMATS = ("year_only",)
MONTH_FORMATS = ("year_month_dash", "year_month_slash", "year_month_chinese")
TRUE_WORDS = ("true", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "no", "n", "0", "off")


def _text(c) -> Column:
    return F.btrim(_col(c).cast("string"), F.lit(BLANKS))


def trim_blank(c) -> Column:
    return F.nullif(_text(c), F.lit(""))


def _as_time(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def numeric_text(c) -> Column:
    """Number text, scientific notation included, as DECIMAL(38,6); else null."""
    text = _text(c)
    return F.when(text.rlike(NUMBER), text.try_cast("decimal(38,6)"))


def parse_yyyymmdd(c) -> Column:
    """Eight digits, year 1900 to 2100."""
    text = _text(c)
    dashed = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(text.rlike(r"^(19\d\d|20\d\d|2100)\d{4}$"), _as_time(dashed))


def _plus_seconds(origin: str, seconds: Column) -> Column:
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit(origin).cast("timestamp_ntz") + span


def parse_excel_serial(c) -> Column:
    """Days since 1899-12-30 with a fraction; results before 1900 are refused."""
    days = _col(c).try_cast("double")
    in_range = days.between(2, 80000)
    return F.when(in_range, _plus_seconds("1899-12-30", F.when(in_range, days) * 86400))


def parse_unix(c) -> Column:
    """Seconds or milliseconds since 1970, told apart by size, read as UTC."""
    number = _col(c).try_cast("double")
    millis = number.between(1_000_000_000_000, 4_102_444_800_000)
    secs = number.between(1_000_000_000, 4_102_444_800)
    value = F.when(millis, number / 1000).when(secs, number)
    return F.when(millis | secs, _plus_seconds("1970-01-01", value))


def parse_chinese_date(c) -> Column:
    text = _text(c)
    plain = F.rtrim(F.translate(text, "年月日", "--"), F.lit("-"))
    known = text.rlike(CHINESE[0][1]) | text.rlike(CHINESE[1][1])
    return F.when(known, _as_time(plain))


def _parsed(value: Column, label: Column) -> Column:
    return F.struct(
        value.isNotNull().alias("ok"),
        value.alias("value"),
        F.when(value.isNotNull(), label).alias("source_format"),
    )


# The reading of a time goes through these columns, each computed once:
# trimmed text -> number -> (digits, seconds since 1970) -> label -> value.

def _number(text: Column) -> Column:
    """DOUBLE: exact for every whole number the readings below accept."""
    return F.when(text.rlike(NUMBER) & ~text.rlike(r"^\d{4}$"), text.try_cast("double"))


def _digits(number: Column) -> Column:
    """The eight digits of a whole number such as 20240131 or 2.0240131E7."""
    day = F.when((number >= 19000101) & (number <= 21001231), number)
    return F.when(day == F.floor(day), day.cast("bigint").cast("string"))


def _seconds(number: Column) -> Column:
    """Unix milliseconds, Unix seconds and Excel days (1899-12-30 is day -25569) as seconds since 1970."""
    n = number
    return (F.when(n.between(1_000_000_000_000, 4_102_444_800_000), n / 1000)
            .when(n.between(1_000_000_000, 4_102_444_800), n)
            .when(n.between(2, 80000), (n - 25569) * 86400))


def _dashed(text: Column, digits: Column) -> Column:
    """Any of the day patterns with dashes between the parts, ready for one cast."""
    spaced = F.rtrim(F.translate(text, "/.年月日", "-----"), F.lit("-"))
    return F.when(digits.isNotNull(), F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")).otherwise(spaced)


def _label(text: Column, number: Column, digits: Column) -> Column:
    out = (F.when(digits.isNotNull(), "yyyyMMdd")
           .when(number >= 1_000_000_000_000, "unix_timestamp_milliseconds")
           .when(number >= 1_000_000_000, "unix_timestamp_seconds")
           .when(number.isNotNull(), "excel_serial_date"))
    for name, pattern in (*PATTERNS, *CHINESE):
        out = out.when(text.rlike(pattern), name)
    return out.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ T]"), "auto")


def _value(text: Column, number: Column, digits: Column, seconds: Column, label: Column, extra: Iterable[str]) -> Column:
    by_digits = _as_time(F.when(digits.isNotNull(), _dashed(text, digits)))
    plain = (F.when(label.isin("auto", "datetime_iso"), _as_time(text))
             .when(label.isNotNull() & number.isNull(), _as_time(_dashed(text, digits))))
    others = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in extra]
    by_number = F.when(number.isNotNull(), F.coalesce(by_digits, _plus_seconds("1970-01-01", seconds)))
    return F.coalesce(by_number, plain, *others)


def parse_datetime(c, extra_formats: Iterable[str] = ()) -> Column:
    """STRUCT<ok, value, source_format> of a text column.

    Order of reading: four digits are a year; numbers are eight digits before
    Unix seconds or milliseconds before Excel days; then the dash, slash, dot
    and Chinese patterns, the remaining ISO forms and ``extra_formats``.
    On large tables prefer ``with_parsed_time``, which computes each
    intermediate once.
    """
    text = _text(c)
    number = _number(text)
    digits = _digits(number)
    label = _label(text, number, digits)
    value = _value(text, number, digits, _seconds(number), label, extra_formats)
    return _parsed(value, F.coalesce(label, F.lit("extra")))


def with_parsed_time(df: DataFrame, name: str, out: str = "parsed", extra_formats: Iterable[str] = ()) -> DataFrame:
    """Add the parsed STRUCT of column ``name``; date and timestamp columns are taken as they are.

    Every step is exploded from a one-element array.  Spark does not push
    filters or merge projections through an explode, so each intermediate is
    computed once per row and the generated code stays small, whatever is
    filtered on later.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(out, _parsed(F.col(name).cast("timestamp_ntz"), F.lit("timestamp")))
    if isinstance(kind, T.DateType):
        return df.withColumn(out, _parsed(F.col(name).cast("timestamp_ntz"), F.lit("date")))

    def once(frame: DataFrame, into: str, **parts: Column) -> DataFrame:
        one = F.struct(*[c.alias(k) for k, c in parts.items()])
        return frame.select("*", F.explode(F.array(one)).alias(into))

    a, b, c = F.col("_pt_a"), F.col("_pt_b"), F.col("_pt_c")
    steps = once(df, "_pt_a", text=_text(name), number=_number(_text(name)))
    steps = once(steps, "_pt_b", digits=_digits(a["number"]), seconds=_seconds(a["number"]),
                 label=_label(a["text"], a["number"], _digits(a["number"])))
    steps = once(steps, "_pt_c", value=_value(a["text"], a["number"], b["digits"], b["seconds"], b["label"], extra_formats),
                 label=F.coalesce(b["label"], F.lit("extra")))
    return steps.withColumn(out, _parsed(c["value"], c["label"])).drop("_pt_a", "_pt_b", "_pt_c")


def finite(c) -> Column:
    """Null for NaN and both infinities."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def parse_number(c, thousands: bool = True) -> Column:
    text = _text(c)
    if thousands:
        text = F.replace(text, F.lit(","), F.lit(""))
    return F.when(text.rlike(NUMBER), finite(text.try_cast("double")))


def coerce_flag_number(c, thousands: bool = True) -> Column:
    """Yes/no words to 1/0, everything else as a number."""
    word = F.lower(_text(c))
    return (F.when(word.isin(*TRUE_WORDS), 1.0)
            .when(word.isin(*FALSE_WORDS), 0.0)
            .otherwise(parse_number(c, thousands)))
