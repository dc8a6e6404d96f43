from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidecast.functions import naming as N
from tidecast.functions import parse as P
from tidecast.functions.calendar import next_period, time_bucket

CASES = [
    ("2024-01-05", datetime(2024, 1, 5), "date_dash"),
    ("2024/1/5", datetime(2024, 1, 5), "date_slash"),
    ("2024.01.05", datetime(2024, 1, 5), "date_dot"),
    ("20240105", datetime(2024, 1, 5), "yyyyMMdd"),
    ("2.0240105E7", datetime(2024, 1, 5), "yyyyMMdd"),
    ("2024-01-05 06:07:08", datetime(2024, 1, 5, 6, 7, 8), "datetime_dash"),
    ("2024/01/05 06:07:08", datetime(2024, 1, 5, 6, 7, 8), "datetime_slash"),
    ("2024-01-05T06:07:08", datetime(2024, 1, 5, 6, 7, 8), "datetime_iso"),
    ("2024-01", datetime(2024, 1, 1), "year_month_dash"),
    ("2024/01", datetime(2024, 1, 1), "year_month_slash"),
    ("2024", datetime(2024, 1, 1), "year_only"),
    ("2024年1月5日", datetime(2024, 1, 5), "date_chinese"),
    ("2024年1月", datetime(2024, 1, 1), "year_month_chinese"),
    ("45000.5", datetime(2023, 3, 15, 12), "excel_serial_date"),
    ("1704412800", datetime(2024, 1, 5), "unix_timestamp_seconds"),
    ("1704412800000", datetime(2024, 1, 5), "unix_timestamp_milliseconds"),
    ("2024-01-05T10:00:00Z", datetime(2024, 1, 5, 10), "auto"),
    ("  2024-01-05 ", datetime(2024, 1, 5), "date_dash"),
    ("not-a-date", None, None), ("", None, None), (None, None, None), ("2024-02-30", None, None),
    ("2024年13月1日", None, None), ("1", None, None), ("18991231", None, None), ("1d", None, None),
]


@pytest.mark.parametrize("staged", [True, False])
def test_times(spark, staged):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string")
    out = P.with_parsed_time(df, "s", "p") if staged else df.withColumn("p", P.parse_datetime("s"))
    got = {r["i"]: r["p"] for r in out.collect()}
    for i, (text, value, label) in enumerate(CASES):
        assert (got[i]["ok"], got[i]["value"], got[i]["source_format"]) == (value is not None, value, label), text


def test_extra_format(spark):
    df = spark.createDataFrame([("05|01|2024",)], "s string")
    row = P.with_parsed_time(df, "s", "p", ["dd|MM|yyyy"]).first()["p"]
    assert row["value"] == datetime(2024, 1, 5) and row["source_format"] == "extra"


def test_does_not_depend_on_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2024-03-10 02:30:00",), ("1704412800",)], "s string")
        out = P.with_parsed_time(df, "s", "p").select(F.col("p.value").alias("t"))
        out = out.select("t", time_bucket("t", "H").alias("h"), next_period("t", "H").alias("n"))
        assert [tuple(r) for r in out.collect()] == [
            (datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 2), datetime(2024, 3, 10, 3, 30)),
            (datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 1, 5, 1))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_numbers_and_flags(spark):
    rows = [" 1,200 ", "n/a", "inf", "nan", "1e3", "1d", "", None, "-.5"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(P.parse_number("s")).collect()] == [1200.0, None, None, None, 1000.0, None, None, None, -0.5]
    flags = ["TRUE", " yes", "y", "on", "1", "False", "no", "OFF", "2,500", "maybe", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(flags)], "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(P.coerce_flag_number("s")).collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 2500, None, None]


def test_names_and_rates(spark):
    df = spark.createDataFrame([("Day-Of_Week", 1, 3), ("Price", 1, 0), ("  IsHoliday", 5, 8)], "n string, a int, b int")
    got = df.select(N.canonical_name("n"), N.feature_key("n"), N.rate("a", "b")).collect()
    assert [tuple(r) for r in got] == [("weekday", "weekday", 0.3333), (None, "price", 0.0), ("holiday", "isholiday", 0.625)]


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 7, 23),), (datetime(2024, 1, 8),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(time_bucket("t", "W")).collect()] == [datetime(2024, 1, 1), datetime(2024, 1, 8)]
