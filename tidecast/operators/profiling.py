"""Column profiles and type inference."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.parse import NUMBER, _text, with_parsed_time
from ._common import whole

# Parts of a column name that suggest times.
TIME_HINTS = ("date", "time", "datetime", "timestamp", "month", "year", "日期", "时间", "年月", "月份", "年度")
BOOLEAN_WORDS = ("true", "false", "yes", "no")


def _present(c: str) -> Column:
    v = F.col(c).cast("string")
    return F.when(v != "", v)


def infer_column_types(df: DataFrame, columns=None) -> DataFrame:
    """column, inferred_type and the counts behind it: boolean, number, datetime, string or empty.

    Values are unpivoted to narrow rows, so the parsing code exists once
    whatever the number of columns, and counted with partial aggregates: the
    shuffle carries one row per column and task.
    """
    columns = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("_i"), _present(c).alias("v")) for i, c in enumerate(columns)])
    long = with_parsed_time(df.select(F.explode(pairs).alias("p")).select("p.*"), "v", "_t")
    v, parsed = F.col("v"), F.col("_t.ok")
    word = F.lower(_text(v))
    number = _text(v).rlike(NUMBER) | word.isin("inf", "-inf", "nan", "infinity", "-infinity")
    clear = F.regexp_replace(_text(v), r"\.0$", "").rlike(r"^(19|20|21|22)\d{6}$") & parsed
    counts = long.groupBy("_i").agg(
        F.count(v).alias("n"), F.count_if(word.isin(*BOOLEAN_WORDS)).alias("booleans"), F.count_if(number).alias("numbers"),
        F.count_if(clear).alias("_clear"), F.count_if(parsed).alias("dates"))
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(any(h in c.strip().lower() for h in TIME_HINTS)).alias("hinted")) for c in columns])
    rows = counts.withColumn("_c", names[F.col("_i")]).select("*", "_c.*")
    n = F.col("n")
    enough = F.greatest(F.lit(2), F.floor(n * 0.7))
    all_numbers = F.col("numbers") == n
    kind = (F.when(n == 0, "empty").when(F.col("booleans") == n, "boolean")
            .when(all_numbers & ((F.col("_clear") >= enough) | (F.col("hinted") & (F.col("dates") >= enough))), "datetime")
            .when(all_numbers, "number")
            .when(F.col("dates") >= enough, "datetime").otherwise("string"))
    return rows.select("column", kind.alias("inferred_type"), "n", "booleans", "numbers", "dates")


def first_distinct(df: DataFrame, columns, order: str, k: int) -> DataFrame:
    """column, v, _first: the ``k`` distinct values of each column that stand first by ``order``, and some more of other tasks.

    Every task keeps the k earliest of its own rows, one Arrow batch after the other: a value that is among the first k of the table is
    among the first k of the task that holds its first row.  So columns x tasks x k rows leave the tasks, whatever the number of distinct
    values.  Values first seen at equal places are taken in their own order; rows without ``order`` are not looked at.
    """
    kind = dict(df.dtypes)[order]

    def keep(batches):
        held = [pd.DataFrame({"o": pd.Series(dtype=object), "v": pd.Series(dtype=object)}) for _ in columns]
        for batch in batches:
            place = batch.column(0).to_pandas()
            for i in range(len(columns)):
                new = pd.DataFrame({"o": place, "v": batch.column(i + 1).to_pandas()})
                new = new[new["v"].notna() & new["o"].notna()]
                if len(held[i]) == k:
                    new = new[new["o"] <= held[i]["o"].iloc[-1]]
                if len(new):
                    both = pd.concat([held[i], new], ignore_index=True) if len(held[i]) else new
                    held[i] = both.groupby("v", as_index=False, sort=False)["o"].min()[["o", "v"]].sort_values(["o", "v"]).head(k)
        for i, h in enumerate(held):
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int32)), pa.array(h["v"].tolist(), pa.string()), pa.array(h["o"].tolist(), to_arrow_type(schema["_first"].dataType))],
                                                 names=["_i", "v", "_first"])

    schema = T.StructType.fromDDL(f"_i int, v string, _first {kind}")
    rows = df.select(F.col(order).alias("_o"), *[_present(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(keep, schema)
    names = F.array(*[F.lit(c) for c in columns])
    return rows.groupBy("_i", "v").agg(F.min("_first").alias("_first")).select(names[F.col("_i")].alias("column"), "v", "_first")


def profile_columns(df: DataFrame, columns, order: str, samples: int = 5) -> DataFrame:
    """column, non_null, nulls and the first distinct values in row order (see ``first_distinct``)."""
    columns = list(columns)
    pos = F.row_number().over(whole(["column"]).orderBy("_first", "v"))
    kept = (first_distinct(df, columns, order, samples).withColumn("_k", pos).where(F.col("_k") <= samples)
            .groupBy("column").agg(F.sort_array(F.collect_list(F.struct("_k", "v"))).alias("_s")))
    counts = df.agg(*[F.count(_present(c)).alias(f"n{i}") for i, c in enumerate(columns)], F.count("*").alias("_all"))
    totals = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("non_null"), (F.col("_all") - F.col(f"n{i}")).alias("nulls"))
        for i, c in enumerate(columns)])).alias("t")).select("t.*")
    found = F.coalesce(F.transform("_s", lambda s: s["v"]), F.array().cast("array<string>"))
    return totals.join(kept, "column", "left").select("column", "non_null", "nulls", found.alias("samples"))
