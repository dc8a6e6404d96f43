"""Exact Lloyd clustering of integer vectors whose columns are dealt into shards.

Vectors are held as records of some thousand rows by a few columns each (a column block).  A round has three steps: tasks over column
blocks compute the exact part of every squared distance that their columns and their slice of the centroids give; the parts of a
record's blocks are added and each row takes its nearest centroid; then every block sums its own columns by cluster and makes its own
slice of the next centroids.  No task ever sees a whole centroid, and no record more than ``ROWS`` rows.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .store import written

ROWS, WIDTH, SCALE = 4096, 16, 64
#: Centroid numbers (clusters x dimensions) up to which slices are broadcast, 32 MB; beyond, blocks and slices meet by a salted join.
BROADCAST_NUMBERS, SALTS = 1 << 22, 512


def pack(a: np.ndarray) -> bytes:
    """Integers in the smallest type that holds them all, the type's code first."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    kind = np.promote_types(np.min_scalar_type(min(low, -1)), np.min_scalar_type(high)) if low < 0 else np.min_scalar_type(high)
    return kind.str.encode() + a.astype(kind).tobytes()


def unpack(b: bytes, columns: int = 1) -> np.ndarray:
    return np.frombuffer(b, np.dtype(b[:3].decode()), offset=3).astype(np.int64).reshape(-1, columns)


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T exactly; by floating point where no sum can leave its exact integers."""
    if x.size and c.size and int(np.abs(x).max()) * int(np.abs(c).max()) * x.shape[1] < 1 << 53:
        return (x.astype(float) @ c.T.astype(float)).astype(np.int64)
    return x @ c.T


def integers(vectors: DataFrame, dims: int = 64, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors with exactly ``dims`` components, all finite, as integers floor(SCALE * component).

    Components so large that a squared distance might leave a long raise an error, as overflow does elsewhere in Spark.
    """
    most = isqrt(((1 << 63) - 1) // dims) // 2
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v.cast("double")) * SCALE < most, F.floor(v.cast("double") * SCALE)).otherwise(F.raise_error(F.lit("vector component too large for exact distances")).cast("bigint"))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dims) & fine).select("vec_id", F.transform(vector, whole).alias("x"))


def blocks_of(whole: DataFrame, dims: int, width: int = WIDTH) -> DataFrame:
    """(block, record, data, ids) written by block: ``ROWS`` vectors or fewer by ``width`` columns; the first block also carries the ids."""
    cuts = [(a, min(a + width, dims)) for a in range(0, dims, width)]

    def cut(batches):
        task, record = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy().reshape(-1, dims)
                ids = pa.array([part.column("vec_id").to_pylist()] + [None] * (len(cuts) - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array(np.full(len(cuts), task | record)),
                                                  pa.array([pack(x[:, a:b]) for a, b in cuts], pa.binary()), ids], names=["block", "record", "data", "ids"])
                record += 1

    return written(whole.mapInArrow(cut, "block int, record bigint, data binary, ids array<bigint>"), "block")


def first_slices(whole: DataFrame, k: int, dims: int, seed: str, width: int = WIDTH) -> DataFrame:
    """(block, slice): the vectors of the k smallest sha256 of ``seed:vec_id``, in this order, cut into column blocks.

    Of equal ids the smaller vector is first.  Vectors without vec_id start no cluster.
    """
    chosen = (whole.where("vec_id is not null").select(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), "UTF-8"), 256).alias("h"), "x").orderBy("h", "x").limit(k)
              .select(F.row_number().over(Window.orderBy("h", "x")).alias("cluster"), "x"))  # k rows
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit((dims - 1) // width)), lambda b: F.struct(b.alias("block"), F.slice("x", b * width + 1, F.lit(width)).alias("own")))).alias("c")
    return chosen.select("cluster", cut).groupBy("c.block").agg(_in_order("cluster", "c.own"))


def _in_order(key: str, value: str):
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))), lambda s: s["v"]).alias("slice")


def _with_slices(blocks: DataFrame, slices: DataFrame, numbers: int) -> DataFrame:
    if numbers <= BROADCAST_NUMBERS:
        return blocks.join(F.broadcast(slices), "block")
    dealt = slices.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int")).join(dealt, ["block", "salt"])


def assign(blocks: DataFrame, slices: DataFrame, numbers: int) -> DataFrame:
    """(record, cluster, distance: packed) of every record's rows: partial distances by block, added by record, smallest one taken."""
    def part(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                lists = batch.column("slice")[i].values
                c = lists.flatten().to_numpy().reshape(len(lists), -1)
                x = unpack(batch.column("data")[i].as_py(), c.shape[1])
                out.append(pack((x * x).sum(1)[:, None] - 2 * products(x, c) + (c * c).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array([len(x) for x in batch.column("slice")], pa.int32()), pa.array(out, pa.binary())], names=["record", "k", "part"])

    def nearest(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        total = sum(unpack(p.as_py(), k) for p in table.column("part"))
        cluster = total.argmin(1)
        return pa.table({"record": table.column("record").slice(0, 1), "cluster": pa.array([pack(cluster)], pa.binary()),
                         "distance": pa.array([pack(total[np.arange(len(total)), cluster])], pa.binary())})

    parts = _with_slices(blocks.select("block", "record", "data"), slices, numbers).mapInArrow(part, "record bigint, k int, part binary")
    return parts.groupBy("record").applyInArrow(nearest, "record bigint, cluster binary, distance binary")


def move(blocks: DataFrame, assigned: DataFrame, slices: DataFrame, width: int = WIDTH) -> DataFrame:
    """The next slices: each block's sums by cluster and column, divided with floor by exact counts; clusters without rows keep their place."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, b = unpack(batch.column("cluster")[i].as_py())[:, 0], batch.column("block")[i].as_py()
                x = unpack(batch.column("data")[i].as_py(), batch.column("columns")[i].as_py())
                order = np.argsort(cluster, kind="stable")
                found, start = np.unique(cluster[order], return_index=True)
                own = sums.setdefault(b, np.zeros((batch.column("k")[i].as_py(), x.shape[1] + 1), np.int64))
                own[found] += np.add.reduceat(np.c_[x, np.ones(len(x), np.int64)][order], start)
        for b, own in sums.items():
            k, w = own.shape
            c, d = (a.ravel() for a in np.indices((k, w - 1), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), b, np.int32)), pa.array(c), pa.array(d), pa.array(own[:, :-1].ravel()), pa.array(np.repeat(own[:, -1], w - 1))],
                                             names=["block", "cluster", "at", "total", "n"])

    shape = slices.select("block", F.size("slice").alias("k"), F.size(F.col("slice")[0]).alias("columns"))
    told = blocks.select("block", "record", "data").join(assigned.select("record", "cluster"), "record").join(F.broadcast(shape), "block")  # shape: one short row a block
    sums = told.select("block", "data", "cluster", "k", "columns").mapInArrow(add, "block int, cluster int, at int, total bigint, n bigint")
    means = sums.groupBy("block", "cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").select("block", "cluster", "at", F.expr("(total - pmod(total, n)) div n").alias("mean"))
    old = slices.select("block", F.posexplode("slice").alias("cluster", "own")).select("block", "cluster", F.posexplode("own").alias("at", "value"))
    now = old.join(means, ["block", "cluster", "at"], "left").select("block", "cluster", "at", F.coalesce("mean", "value").alias("value"))
    return now.groupBy("block", "cluster").agg(_in_order("at", "value").alias("own")).groupBy("block").agg(_in_order("cluster", "own"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: str = "1", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector, after ``rounds`` rounds and one more assignment.

    Kept are rows of exactly ``dims`` finite components; null, short, long or non-finite vectors have no row, whatever their
    id.  Repeated rows count each by itself (and may both start a cluster); with fewer than k vectors there are as many clusters as vectors with an id; equal
    distances go to the smaller number.  Without any such vector the result is empty.  Other columns are ignored.  Jobs run while this is planned: the blocks
    and every round's centroids are written to the shared folder, so a lost executor costs part of one round.
    """
    whole = integers(vectors.select("vec_id", F.col(vector)), dims, vector)
    blocks = blocks_of(whole, dims, width)
    slices = stage(first_slices(whole, k, dims, seed, width))
    for _ in range(rounds):
        slices = stage(move(blocks, assign(blocks, slices, k * dims), slices, width))
    ids = blocks.where("ids is not null").select("record", "ids").join(assign(blocks, slices, k * dims), "record")

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c, d = (unpack(batch.column(x)[i].as_py())[:, 0] for x in ("cluster", "distance"))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(c.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    placed = written(ids.select("ids", "cluster", "distance").mapInArrow(rows, "vec_id bigint, cluster int, distance bigint"))
    near = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = near.withColumn("inertia", F.lit(near.agg(F.sum("cluster_inertia")).head()[0]).cast("bigint"))
    text = (slices.select("block", F.posexplode("slice").alias("cluster", "own")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("block", "own"))).alias("all"))
            .select("cluster", F.sha2(F.encode(F.array_join(F.flatten(F.transform("all", lambda s: s["own"])).cast("array<string>"), ","), "UTF-8"), 256).alias("centroid_sha256")))
    return placed.join(told.join(text, "cluster"), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
