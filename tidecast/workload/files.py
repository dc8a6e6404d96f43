"""Text files and stored runs: tables are written to the shared folder and read back by the library's own readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.runs import compare_whole_runs
from ..session import shared_folder
from ..sources import store
from ..sources import tables as S
from .base import monthly, near, near_sql, query, with_ctes
from .models_and_scores import monthly_run


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


def quoted_lines(t):
    """A line of text for each order; clerk and comment stand in quotes, with delimiters inside."""
    note = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit("; a, "), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, "; b|").otherwise(""), F.lit('"'))
    return t.orders.select("o_orderkey", F.concat_ws(";", F.col("o_orderkey").cast("string"), note, F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "x,y").otherwise("x")).alias("value"))


@query("delimiter_counts", """
WITH v AS (SELECT o_orderkey, o_orderkey::VARCHAR || ';' || '"' || o_orderpriority || '; a, ' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '; b|' ELSE '' END || '"' || ';' || strftime(o_orderdate, '%Y-%m-%d') || ';'
  || CASE WHEN o_orderkey % 2 = 0 THEN 'x,y' ELSE 'x' END AS value FROM orders),
b AS (SELECT o_orderkey, regexp_replace(value, '"[^"]*"', '', 'g') AS bare FROM v),
c AS (SELECT o_orderkey, d.i, length(bare) - length(replace(bare, d.c, '')) AS n FROM b, (VALUES (0, ','), (1, chr(9)), (2, ';'), (3, '|')) d(i, c))
SELECT i::BIGINT AS i, count(*) AS lines, floor(avg(n) * 1e6 + 0.500001) / 1e6 AS mean, floor(stddev_pop(n) * 1e6 + 0.500001) / 1e6 AS spread, arg_min(n, o_orderkey)::BIGINT AS first FROM c GROUP BY 1""")
def _(t):
    return S.delimiter_counts(quoted_lines(t), order="o_orderkey").select("i", "lines", near("mean", 6).alias("mean"), near("spread", 6).alias("spread"), "first")


@query("sheets_from_text", f"""
SELECT o_orderstatus AS sheet, count(*) AS n, {near_sql('sum(o_totalprice)', 1)} AS total, min(o_orderpriority) AS first_priority,
 CASE WHEN o_orderstatus = 'F' THEN NULL ELSE count(DISTINCT o_custkey) END::BIGINT AS customers FROM orders GROUP BY 1""")
def _(t):
    """A sheet for each order status, as semicolon files with odd headers; one sheet lacks a column."""
    root, sheets = _folder(t), [r[0] for r in t.orders.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]
    for s in sheets:
        rows = t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias(" key "), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
                                                                  *([] if s == "F" else [F.col("o_custkey").alias("customer")]))
        rows.write.option("header", True).option("sep", ";").option("quoteAll", True).csv(f"{root}/{s}")
    df = S.read_sheets(t.spark, {s: f"{root}/{s}" for s in sheets})
    told = df.groupBy("sheet").agg(F.count("key").alias("n"), near(F.sum(F.col("price").cast("double")), 1).alias("total"), F.min("priority").alias("first_priority"), F.countDistinct("customer").alias("c"))
    return told.select("sheet", "n", "total", "first_priority", F.when(F.col("sheet") != "F", F.col("c")).alias("customers"))


@query("stored_run", with_ctes("om_board om_points", f"""
SELECT b.series_id, b.model_id, b.rank, {near_sql('b.mae', 2)} AS mae, p.n AS points FROM om_board b JOIN (SELECT series_id, model_id, count(*) AS n FROM om_points GROUP BY 1, 2) p USING (series_id, model_id)"""))
def _(t):
    """Two runs saved, one of them deleted; the other comes back whole, with its empty table."""
    root = _folder(t)
    board, points = monthly_run(t)
    for run in ("kept: one", "gone"):
        store.save_run({"leaderboard": board, "backtest": points, "trials": board.limit(0)}, root, run)
    store.delete_run(t.spark, root, "gone")
    back = store.load_run(t.spark, root, "kept: one")
    rows = back["leaderboard"].unionByName(back["trials"]).join(back["backtest"].groupBy("series_id", "model_id").agg(F.count("*").alias("points")), ["series_id", "model_id"])
    return rows.where(F.lit(store.stored_runs(t.spark, root) == ["kept: one"])).select("series_id", "model_id", "rank", near("mae", 2).alias("mae"), "points")


@query("compare_whole_runs", with_ctes("om_board", """
, f AS (SELECT series_id, max(model_id) FILTER (rank = 1) AS best, max(model_id) FILTER (rank = 2) AS second, count(*) AS n FROM om_board GROUP BY 1)
SELECT series_id, n * 4 + 3 AS checks, n * 4 + CASE WHEN series_id < '3' THEN 1 ELSE 3 END AS passed, CASE WHEN series_id < '3' THEN 'recommended_model|series_hash' ELSE '' END AS drift FROM f""".replace("\n, f AS", ", f AS", 1)))
def _(t):
    board, points = monthly_run(t)
    panel = monthly(t)
    first = {"leaderboard": board, "backtest": points, "series_points": panel}
    hit = F.col("series_id") < "3"
    second = {"leaderboard": board.withColumn("rank", F.when(hit & (F.col("rank") <= 2), 3 - F.col("rank")).otherwise(F.col("rank"))), "backtest": points,
              "series_points": panel.where(~(hit & (F.month("t") == 3)))}
    return compare_whole_runs(first, second).select("series_id", "checks", "passed", F.array_join("drift", "|").alias("drift"))
