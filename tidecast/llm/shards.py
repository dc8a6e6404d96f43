"""Two-pass external shuffle of a table into shards.

Pass one scatters the rows by a seeded hash into buckets that fit in memory; pass two reads a bucket, permutes it
(``shuffle``: Fisher-Yates with the seed and the partition's number) and writes it.  The written buckets, one after the
other, are the shuffled table; shards are equal runs of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import written as store

BUCKET_BYTES = 32 << 20


def shuffled_buckets(docs: DataFrame, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """(bucket, place, row): every row once, scattered to a bucket and put at a random place of it.

    Rows are scattered by a hash of seed, text and row number of their input partition, so that repeated rows
    and hot keys spread evenly; a bucket holds about ``bucket_bytes`` of text and is the largest thing in memory.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).head()
    buckets = max(1, -(-((total["b"] or 0) + 64 * total["n"]) // bucket_bytes))
    where = F.pmod(F.xxhash64(F.lit(seed), F.col(text), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    scattered = docs.select(where.alias("bucket"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    gathered = (scattered.repartitionById(buckets, F.col("bucket"))
                .groupBy("bucket").agg(F.shuffle(F.collect_list("row"), seed).alias("rows")))
    return gathered.select("bucket", F.posexplode("rows").alias("place", "row"))


def shuffle_to_shards(docs: DataFrame, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with shard (0 to shards-1) and slot (bigint, gapless from 0 in its shard): law ``rows``.

    The shuffled buckets are written once to the shared folder; only their row counts (one number a bucket) are
    added up to place every bucket in the whole.  Row p of N goes to shard p * shards / N, so counts are
    at most one apart.  Equal seed and equal input partitions scatter alike.  Null texts count as no bytes; repeated rows
    stay as often as they are; input columns named shard or slot are replaced; an empty table gives an empty table.
    """
    base = docs.drop("shard", "slot")
    written = store(shuffled_buckets(base, seed, bucket_bytes, text))
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    rows = written.select(F.count(F.lit(1)).alias("all")).head()["all"]
    place = written.join(starts, "bucket").select("row", (F.col("start") + F.col("place")).alias("p"))
    return (place.withColumn("shard", F.expr(f"cast(p * {shards}L div {max(rows, 1)}L as int)"))
            .select("row.*", "shard", (F.col("p") - F.expr(f"(shard * {max(rows, 1)}L + {shards - 1}L) div {shards}L")).alias("slot")))


def write_shards(placed: DataFrame, folder: str) -> None:
    """Write one folder ``shard=k`` for each shard, rows in slot order within a file (Parquet, replaces the folder)."""
    (placed.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").mode("overwrite").parquet(folder))
