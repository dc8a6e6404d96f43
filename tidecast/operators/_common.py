"""Shared window and key helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

START, HERE = W.unboundedPreceding, W.currentRow


def cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def forward(keys, *order):
    return W.partitionBy(*cols(keys)).orderBy(*cols(order or ("t",)))


def backward(keys, *order):
    return W.partitionBy(*cols(keys)).orderBy(*[c.desc() for c in cols(order or ("t",))])


def whole(keys):
    return W.partitionBy(*cols(keys))


def mark_chunks(df: DataFrame, keys, chunk: Column) -> DataFrame:
    return df.withColumn("_key", F.struct(*cols(keys))).withColumn("_chunk", F.struct(chunk))


def range_chunks(df: DataFrame, keys, order) -> DataFrame:
    """``df`` dealt by ranges of key, order and a hash of the row, staged (a job), with ``_key``, ``_tie`` and ``_chunk``, the range a row lies in.

    Ranges hold about as many rows each, whatever the keys and times: a bulk load under one time stamp, or rows without a time, are cut
    by the hash.  Only rows that are equal in every column stay together.  The ranges are staged because a later reading must find the same ones.
    """
    whole_row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")])
    marked = df.withColumn("_key", F.struct(*cols(keys))).withColumn("_tie", whole_row)
    return stage(marked.repartitionByRange("_key", *cols(order), "_tie").withColumn("_chunk", F.struct(F.spark_partition_id().alias("part"))))


def in_chunks(df: DataFrame, keys, order, chunk: Column | None = None) -> DataFrame:
    """Adds ``_key``, ``_chunk``, ``_tie`` and ``_n``, the position inside key and chunk.

    Key and chunk are structs, so that null keys and null times group and join
    like other values.  Without a ``chunk``, which must follow ``order``, rows are dealt by ``range_chunks``.
    Everything that follows groups and joins on (_key, _chunk), so a key with a third of all rows spreads over as many
    tasks as it has chunks.
    """
    rows = range_chunks(df, keys, order) if chunk is None else mark_chunks(df, keys, chunk).withColumn("_tie", F.lit(0))
    return rows.withColumn("_n", F.row_number().over(forward(["_key", "_chunk"], *order, "_tie")))


def number_rows(df: DataFrame, keys, order, chunk: Column | None = None, name: str = "sequence") -> DataFrame:
    """1-based position inside each key: ranks inside chunks, plus the rows of the chunks before.

    The chunk sizes are partial counts, so only the ranking moves the rows.
    """
    rows = range_chunks(df, keys, order) if chunk is None else mark_chunks(df, keys, chunk).withColumn("_tie", F.lit(0))
    ranked = rows.withColumn("_n", F.row_number().over(forward(["_key", "_chunk"], *order, "_tie")))
    sizes = rows.groupBy("_key", "_chunk").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(forward(["_key"], "_chunk").rowsBetween(START, -1))
    offsets = sizes.select("_key", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = ranked.join(offsets, ["_key", "_chunk"])
    return joined.withColumn(name, F.col("_before") + F.col("_n")).drop("_key", "_chunk", "_tie", "_n", "_before")
