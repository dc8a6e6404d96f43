"""Registry, table loading, common panels and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fill import fill_value, reindex
from ..operators.rows import bucket_aggregate
from ..spec import PanelSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Tables(spark, sf_dir)))
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return register


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, decimals and floats as DOUBLE, times as TIMESTAMP_NTZ."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.DateType)):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def near(c, digits: int = 4) -> Column:
    """Round half up with a small bias, so that exact decimal ties fall the same way on both engines."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.500001) / scale


def near_sql(expr: str, digits: int = 4) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.500001::DOUBLE) / {scale})"


def with_ctes(names: str, body: str) -> str:
    """WITH clause of the named CTEs and everything they read, in order."""
    order: list[str] = []

    def visit(n: str):
        needs, _ = CTES[n]
        for m in needs.split():
            visit(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    recursive = "RECURSIVE " if any("UNION ALL" in CTES[n][1] and f"FROM {n}" in CTES[n][1] for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


# name -> (CTEs it reads, SQL)
CTES: dict[str, tuple[str, str]] = {
    "ev_h": ("", "SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS t, sum(value) AS y FROM events GROUP BY 1, 2"),
    "ev_span": ("ev_h", "SELECT series_id, min(t) AS a, max(t) AS z FROM ev_h GROUP BY 1"),
    "ev_axis": ("ev_span", "SELECT series_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS t FROM ev_span"),
    "ev_grid": ("ev_axis ev_h", "SELECT g.series_id, g.t, e.y, (e.t IS NULL) AS is_gap FROM ev_axis g LEFT JOIN ev_h e ON e.series_id = g.series_id AND e.t = g.t"),
    "ev_zero": ("ev_grid", "SELECT series_id, t, coalesce(y, 0.0) AS y FROM ev_grid"),
    "ord_m": ("", "SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS t, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2"),
    "ord_d": ("", "SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS t, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2"),
    "ord_span": ("ord_d", "SELECT series_id, min(t) AS a, max(t) AS z FROM ord_d GROUP BY 1"),
    "ord_axis": ("ord_span", "SELECT series_id, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS t FROM ord_span"),
    "ord_grid": ("ord_axis ord_d", "SELECT g.series_id, g.t, e.y, (e.t IS NULL) AS is_gap FROM ord_axis g LEFT JOIN ord_d e ON e.series_id = g.series_id AND e.t = g.t"),
    "ship_w": ("", "SELECT l_returnflag AS series_id, date_trunc('week', l_shipdate)::TIMESTAMP AS t, sum(l_quantity) AS y, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2"),
}


def hourly(T_: Tables, how: str = "sum") -> DataFrame:
    spec = PanelSpec(("series_id",), "ts", "value", "H", "event_id")
    return bucket_aggregate(T_.events.withColumnRenamed("event_type", "series_id"), spec, how)


def hourly_grid(T_: Tables) -> DataFrame:
    return reindex(hourly(T_), "H")


def hourly_zero(T_: Tables) -> DataFrame:
    return fill_value(hourly_grid(T_), "zero").drop("is_gap")


def monthly(T_: Tables) -> DataFrame:
    spec = PanelSpec(("series_id",), "o_orderdate", "o_totalprice", "M", "o_orderkey")
    return bucket_aggregate(T_.orders.withColumnRenamed("o_orderpriority", "series_id"), spec, "sum")


def daily(T_: Tables) -> DataFrame:
    spec = PanelSpec(("series_id",), "o_orderdate", "o_totalprice", "D", "o_orderkey")
    return bucket_aggregate(T_.orders.withColumnRenamed("o_orderpriority", "series_id"), spec, "sum")


def daily_grid(T_: Tables) -> DataFrame:
    return reindex(daily(T_), "D")


def weekly(T_: Tables) -> DataFrame:
    spec = PanelSpec(("series_id",), "l_shipdate", "l_quantity", "W")
    rows = (T_.lineitem.withColumnRenamed("l_returnflag", "series_id")
            .withColumnRenamed("l_discount", "discount").withColumnRenamed("l_tax", "tax"))
    return bucket_aggregate(rows, spec, "sum", ("discount", "tax"))
