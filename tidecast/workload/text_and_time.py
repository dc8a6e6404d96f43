"""Scalar functions on dirty text, column profiling, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import naming as N
from ..functions import parse as P
from ..operators.profiling import infer_column_types, profile_columns
from ..operators.rows import annotate_rows, drop_invalid_time, drop_missing_target
from ..sources.tables import preview
from ..spec import PanelSpec
from .base import CTES, Tables, near, near_sql, query, with_ctes

# -- dirty rows derived from events: nine time notations, five kinds of value text

TIME_TEXT = ("""
CASE event_id % 12
 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
 WHEN 1 THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss')
 WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
 WHEN 3 THEN date_format(ts, 'yyyyMMdd')
 WHEN 4 THEN concat(' ', date_format(ts, 'yyyy-M-d'), ' ')
 WHEN 5 THEN date_format(ts, 'yyyy年M月d日')
 WHEN 6 THEN date_format(ts, 'yyyy.MM.dd')
 WHEN 7 THEN cast(1700000000 + event_id * 60 AS string)
 WHEN 8 THEN cast(1700000000000 + event_id * 60000 AS string)
 WHEN 9 THEN cast(45000 + event_id % 900 AS string) || '.5'
 WHEN 10 THEN IF(event_id % 24 = 10, '2024-13-45', concat(date_format(ts, 'yyyy'), IF(event_id % 36 = 22, '', '-02')))
 ELSE IF(event_id % 5 = 0, '  ', IF(event_id % 5 = 1, '2.0240115E7', date_format(ts, 'yyyy年M月')))
END""")
VALUE_TEXT = ("""
CASE WHEN event_id % 37 = 0 THEN '  '
 WHEN event_id % 41 = 0 THEN 'n/a'
 WHEN event_id % 43 = 0 THEN concat(' 1,', lpad(cast(event_id % 1000 AS string), 3, '0'), '.5 ')
 WHEN event_id % 47 = 0 THEN 'inf'
 WHEN event_id % 53 = 0 THEN '1.5e2'
 ELSE format_string('%.2f', value) END""")
FLAG_TEXT = ("""
CASE event_id % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'TRUE' WHEN 3 THEN '2,500'
 WHEN 4 THEN 'maybe' WHEN 5 THEN 'n' ELSE '0.25' END""")


def dirty(t: Tables):
    return t.events.select("event_id", F.col("event_type").alias("series_id"), F.expr(TIME_TEXT).alias("time_text"),
                           F.expr(VALUE_TEXT).alias("value_text"), F.expr(FLAG_TEXT).alias("flag_text"))


CTES["dirty"] = ("", """
SELECT event_id, event_type AS series_id,
 CASE event_id % 12
  WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
  WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  WHEN 3 THEN strftime(ts, '%Y%m%d')
  WHEN 4 THEN ' ' || year(ts) || '-' || month(ts) || '-' || day(ts) || ' '
  WHEN 5 THEN year(ts) || '年' || month(ts) || '月' || day(ts) || '日'
  WHEN 6 THEN strftime(ts, '%Y.%m.%d')
  WHEN 7 THEN (1700000000 + event_id * 60)::VARCHAR
  WHEN 8 THEN (1700000000000 + event_id * 60000)::VARCHAR
  WHEN 9 THEN (45000 + event_id % 900)::VARCHAR || '.5'
  WHEN 10 THEN CASE WHEN event_id % 24 = 10 THEN '2024-13-45' ELSE year(ts) || CASE WHEN event_id % 36 = 22 THEN '' ELSE '-02' END END
  ELSE CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 5 = 1 THEN '2.0240115E7' ELSE year(ts) || '年' || month(ts) || '月' END
 END AS time_text,
 CASE WHEN event_id % 37 = 0 THEN '  ' WHEN event_id % 41 = 0 THEN 'n/a'
  WHEN event_id % 43 = 0 THEN ' 1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') || '.5 '
  WHEN event_id % 47 = 0 THEN 'inf' WHEN event_id % 53 = 0 THEN '1.5e2'
  ELSE printf('%.2f', value) END AS value_text,
 CASE event_id % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'TRUE' WHEN 3 THEN '2,500'
  WHEN 4 THEN 'maybe' WHEN 5 THEN 'n' ELSE '0.25' END AS flag_text
FROM events""")

CTES["trimmed"] = ("dirty", "SELECT *, trim(time_text) AS s, nullif(trim(value_text), '') AS v FROM dirty")
CTES["parsed"] = ("trimmed", r"""
SELECT event_id, series_id, v, s,
 CASE WHEN s = '' THEN NULL
  WHEN regexp_full_match(s, '\d{4}') THEN make_timestamp(s::BIGINT, 1, 1, 0, 0, 0.0)
  WHEN regexp_full_match(s, '\d{4}年\d{1,2}月\d{1,2}日') THEN try_strptime(s, '%Y年%m月%d日')
  WHEN regexp_full_match(s, '\d{4}年\d{1,2}月') THEN try_strptime(s, '%Y年%m月')
  WHEN try_cast(s AS DOUBLE) IS NOT NULL AND length(try_cast(try_cast(s AS DOUBLE) AS BIGINT)::VARCHAR) = 8
   THEN try_strptime(try_cast(try_cast(s AS DOUBLE) AS BIGINT)::VARCHAR, '%Y%m%d')
  WHEN try_cast(s AS DOUBLE) BETWEEN 1e12 AND 4102444800000 THEN epoch_ms(try_cast(s AS BIGINT))
  WHEN try_cast(s AS DOUBLE) BETWEEN 1e9 AND 4102444800 THEN epoch_ms(try_cast(s AS BIGINT) * 1000)
  WHEN try_cast(s AS DOUBLE) BETWEEN 2 AND 80000 THEN TIMESTAMP '1899-12-30' + to_seconds(try_cast(s AS DOUBLE) * 86400)
  ELSE coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y/%m/%d %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'),
   try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%Y.%m.%d'), try_strptime(s, '%Y-%m'), try_strptime(s, '%Y/%m')) END AS value,
 CASE WHEN regexp_full_match(s, '\d{4}') THEN 'year_only'
  WHEN regexp_full_match(s, '\d{4}年\d{1,2}月\d{1,2}日') THEN 'date_chinese'
  WHEN regexp_full_match(s, '\d{4}年\d{1,2}月') THEN 'year_month_chinese'
  WHEN regexp_full_match(s, '\d{8}') OR s LIKE '%E7' THEN 'yyyyMMdd'
  WHEN regexp_full_match(s, '\d{13}') THEN 'unix_timestamp_milliseconds'
  WHEN regexp_full_match(s, '\d{10}') THEN 'unix_timestamp_seconds'
  WHEN regexp_full_match(s, '\d{5}\.5') THEN 'excel_serial_date'
  WHEN regexp_full_match(s, '\d{4}-\d{1,2}-\d{1,2} .*') THEN 'datetime_dash'
  WHEN regexp_full_match(s, '\d{4}/\d{1,2}/\d{1,2} .*') THEN 'datetime_slash'
  WHEN regexp_full_match(s, '\d{4}-\d{1,2}-\d{1,2}T.*') THEN 'datetime_iso'
  WHEN regexp_full_match(s, '\d{4}-\d{1,2}-\d{1,2}') THEN 'date_dash'
  WHEN regexp_full_match(s, '\d{4}/\d{1,2}/\d{1,2}') THEN 'date_slash'
  WHEN regexp_full_match(s, '\d{4}\.\d{1,2}\.\d{1,2}') THEN 'date_dot'
  WHEN regexp_full_match(s, '\d{4}-\d{1,2}') THEN 'year_month_dash'
  ELSE NULL END AS label,
 CASE WHEN v IS NULL OR v IN ('n/a', 'inf') THEN NULL ELSE replace(v, ',', '')::DOUBLE END AS y,
 flag_text
FROM trimmed""")


@query("parse_datetime", with_ctes("parsed", """
SELECT event_id, (value IS NOT NULL) AS ok, value AS parsed, CASE WHEN value IS NOT NULL THEN label END AS source_format FROM parsed"""))
def _(t):
    p = P.with_parsed_time(dirty(t), "time_text", "p")
    return p.select("event_id", F.col("p.ok").alias("ok"), F.col("p.value").alias("parsed"), F.col("p.source_format").alias("source_format"))


@query("parse_numeric_times", r"""
SELECT event_id,
 try_strptime(CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m%d') ELSE '20241399' END, '%Y%m%d') AS by_digits,
 TIMESTAMP '1899-12-30' + to_seconds((40000 + event_id % 4000 + 0.25)::DOUBLE * 86400) AS by_excel,
 make_timestamp((1600000000 + event_id * 7) * 1000000) AS by_unix,
 make_timestamp((1600000000000 + event_id * 7) * 1000) AS by_unix_ms,
 CASE WHEN event_id % 2 = 0 THEN (event_id * 1000)::DOUBLE END AS from_text FROM events""")
def _(t):
    e = t.events
    return e.select(
        "event_id",
        P.parse_yyyymmdd(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyyMMdd")).otherwise("20241399")).alias("by_digits"),
        P.parse_excel_serial(F.lit(40000) + F.col("event_id") % 4000 + F.lit(0.25)).alias("by_excel"),
        P.parse_unix(F.lit(1600000000) + F.col("event_id") * 7).alias("by_unix"),
        P.parse_unix(F.lit(1600000000000) + F.col("event_id") * 7).alias("by_unix_ms"),
        P.numeric_text(F.when(F.col("event_id") % 2 == 0, F.concat(F.col("event_id").cast("string"), F.lit("E3"))).otherwise("e3x")).alias("from_text"))


@query("parse_chinese_date", """
SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS by_day, date_trunc('month', o_orderdate)::TIMESTAMP AS by_month FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", P.parse_chinese_date(F.date_format("o_orderdate", "yyyy年M月d日")).alias("by_day"),
        P.parse_chinese_date(F.date_format("o_orderdate", "yyyy年M月")).alias("by_month"))


@query("parse_values", with_ctes("parsed", """
SELECT event_id, v AS trimmed, y AS number,
 CASE lower(trim(flag_text)) WHEN 'yes' THEN 1.0 WHEN 'true' THEN 1.0 WHEN 'off' THEN 0.0 WHEN 'n' THEN 0.0
  WHEN 'maybe' THEN NULL ELSE replace(flag_text, ',', '')::DOUBLE END::DOUBLE AS flag FROM parsed"""))
def _(t):
    return dirty(t).select("event_id", P.trim_blank("value_text").alias("trimmed"), P.parse_number("value_text").alias("number"),
                           P.coerce_flag_number("flag_text").alias("flag"))


@query("time_buckets", """
SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('week', ts)::TIMESTAMP AS w,
 date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('quarter', ts)::TIMESTAMP AS q, date_trunc('year', ts)::TIMESTAMP AS y FROM events""")
def _(t):
    return t.events.select("event_id", *[C.time_bucket("ts", f).alias(f.lower()) for f in C.FREQ_ORDER])


@query("next_periods", """
SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR AS h, o_orderdate + INTERVAL 1 DAY AS d, o_orderdate + INTERVAL 7 DAY AS w,
 (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS m, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::TIMESTAMP AS q,
 (date_trunc('year', o_orderdate) + INTERVAL 12 MONTH)::TIMESTAMP AS y FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", *[C.next_period("o_orderdate", f).alias(f.lower()) for f in C.FREQ_ORDER])


@query("calendar_fields", """
SELECT event_id, (isodow(ts) - 1)::BIGINT AS weekday, month(ts)::BIGINT AS month, quarter(ts)::BIGINT AS quarter,
 CASE WHEN isodow(ts) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS weekend, CASE WHEN isodow(ts) < 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS workday,
 strftime(ts, '%Y-%m-%d %H:%M') AS label,
 CASE WHEN hour(ts) = 0 AND minute(ts) = 0 THEN strftime(ts, '%m-%d') ELSE strftime(ts, '%m-%d %H:%M') END AS short_label FROM events""")
def _(t):
    return C.calendar_fields(t.events, "ts").select(
        "event_id", "weekday", "month", "quarter", "weekend", "workday",
        C.time_label("ts").alias("label"), C.time_label("ts", "short").alias("short_label"))


NAMES = ("Day_Of_Week", "is-weekend", "Business Day", "MONTH", "Promo Rate", "Is Holiday")


@query("canonical_names", f"""
WITH n AS (SELECT p_partkey, ({list(NAMES)!r})[1 + p_partkey % {len(NAMES)}] AS name FROM part),
k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS plain FROM n)
SELECT p_partkey, plain,
 CASE plain WHEN 'dayofweek' THEN 'weekday' WHEN 'isweekend' THEN 'weekend' WHEN 'businessday' THEN 'workday' WHEN 'month' THEN 'month' WHEN 'isholiday' THEN 'holiday' END AS canonical,
 CASE plain WHEN 'dayofweek' THEN 'weekday' ELSE plain END AS feature_key FROM k""")
def _(t):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES) + 1).cast("int"))
    return t.part.select("p_partkey", N.plain_name(name).alias("plain"), N.canonical_name(name).alias("canonical"),
                         N.feature_key(name).alias("feature_key"))


@query("rates", """
SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN round_even(count(*) FILTER (o_totalprice > 200000) / count(*) FILTER (o_orderstatus = 'F')::DOUBLE, 4) ELSE 0.0 END AS rate
FROM orders GROUP BY 1""")
def _(t):
    g = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 200000).alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b"))
    return g.select("o_custkey", N.rate("a", "b").alias("rate"))


@query("clean_rows", with_ctes("parsed", """
SELECT event_id, series_id, value AS t, y FROM parsed WHERE value IS NOT NULL AND y IS NOT NULL"""))
def _(t):
    spec = PanelSpec(("series_id",), "time_text", "value_text", "H", "event_id")
    rows = annotate_rows(dirty(t), spec)
    return drop_missing_target(drop_invalid_time(rows)).select("event_id", "series_id", "t", "y")


# -- profiling and sources

_COUNTS = "count({c}) FILTER ({c} <> '') AS non_null, count(*) - count({c}) FILTER ({c} <> '') AS nulls"


@query("profile_columns", with_ctes("dirty", f"""
, u AS (
 SELECT 'time_text' AS "column", time_text AS v, event_id FROM dirty UNION ALL
 SELECT 'value_text', value_text, event_id FROM dirty UNION ALL
 SELECT 'flag_text', flag_text, event_id FROM dirty UNION ALL
 SELECT 'series_id', series_id, event_id FROM dirty),
d AS (SELECT "column", v, min(event_id) AS first FROM u WHERE v <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first) AS k FROM d),
s AS (SELECT "column", string_agg(v, '|' ORDER BY k) AS samples FROM r WHERE k <= 5 GROUP BY 1),
c AS (SELECT "column", count(*) FILTER (v <> '') AS non_null, count(*) FILTER (v = '' OR v IS NULL) AS nulls FROM u GROUP BY 1)
SELECT c."column", c.non_null, c.nulls, s.samples FROM c JOIN s USING ("column")""".replace("\n, u AS", ", u AS", 1)))
def _(t):
    p = profile_columns(dirty(t), ["time_text", "value_text", "flag_text", "series_id"], "event_id")
    return p.select("column", "non_null", "nulls", F.array_join("samples", "|").alias("samples"))


@query("infer_column_types", """
WITH c AS (
 SELECT 'order_date' AS "column", count(*) AS n, 0 AS booleans, 0 AS numbers, 0 AS clear, count(o_orderdate) AS dates, true AS hinted FROM orders UNION ALL
 SELECT 'year_code', count(*), 0, count(*), 0, count(o_orderdate), true FROM orders UNION ALL
 SELECT 'price', count(*), 0, count(o_totalprice), 0, count(*) FILTER (o_totalprice BETWEEN 2 AND 80000 OR regexp_full_match(o_totalprice::VARCHAR, '(19|20)[0-9][0-9]([.]0)?')), false FROM orders UNION ALL
 SELECT 'plain_code', count(*), 0, count(*), 0, count(o_orderdate), false FROM orders UNION ALL
 SELECT 'digits', count(*), 0, count(*), count(o_orderdate), count(o_orderdate), false FROM orders UNION ALL
 SELECT 'flag', count(*), count(*), 0, 0, 0, false FROM orders UNION ALL
 SELECT 'status', count(o_orderstatus), 0, 0, 0, 0, false FROM orders UNION ALL
 SELECT 'nothing', 0, 0, 0, 0, 0, false)
SELECT "column", CASE WHEN n = 0 THEN 'empty' WHEN booleans = n THEN 'boolean'
  WHEN numbers = n AND (clear >= greatest(2, floor(n * 0.7)) OR (hinted AND dates >= greatest(2, floor(n * 0.7)))) THEN 'datetime'
  WHEN numbers = n THEN 'number' WHEN dates >= greatest(2, floor(n * 0.7)) THEN 'datetime' ELSE 'string' END AS inferred_type,
 n::BIGINT AS n, booleans::BIGINT AS booleans, numbers::BIGINT AS numbers, dates::BIGINT AS dates FROM c""")
def _(t):
    o = t.orders
    cols = o.select(
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("order_date"), F.date_format("o_orderdate", "yyyy").alias("year_code"),
        F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy").alias("plain_code"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("digits"), F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("flag"),
        F.col("o_orderstatus").alias("status"), F.lit("").alias("nothing"))
    return infer_column_types(cols)


@query("read_and_preview", """
SELECT (SELECT count(*) FROM nation) AS row_count, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 100""")
def _(t):
    rows, total = preview(t.nation.orderBy("n_nationkey"), 100)
    return rows.select(F.lit(total).cast("bigint").alias("row_count"), "n_nationkey", "n_name")
