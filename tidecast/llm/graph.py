"""Connected components of a large undirected graph, as rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .skew import attach


#: A node with fewer edges than this is no hub, however few edges there are.
HUB = 10_000
#: Edges that a task holds at once.
BLOCK = 1 << 20


def find(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of x, where label leads every place to its parent and roots to themselves."""
    r = label[x]
    while True:
        n = label[r]
        if np.array_equal(n, r):
            return r
        r = n


def _stars(batches):
    """Blocks of edges (u, v) as stars around the smallest node of each part that hangs together inside the block."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= BLOCK:
            yield _star(held)
            held, many = [], 0
    if many:
        yield _star(held)


def _star(batches) -> pa.RecordBatch:
    u, v = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
    node, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    label, x, y = np.arange(len(node)), place[:len(u)], place[len(u):]
    while len(x):
        x, y = find(label, x), find(label, y)
        differ = x != y
        x, y = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(label, y, x)
    least = node[find(label, label)]
    return pa.RecordBatch.from_arrays([pa.array(node[least != node]), pa.array(least[least != node])], names=["u", "v"])


def _in_blocks(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges as stars, by tasks of about BLOCK edges however many partitions they lay in, and whether that was one block, so that the stars are final."""
    edges = stage(edges)
    many = edges.count()
    return stage(edges.coalesce(max(1, -(-many // BLOCK))).mapInArrow(_stars, "u bigint, v bigint")), many <= BLOCK


def _turn(edges: DataFrame, least: DataFrame, larger: bool, many: int, most: int) -> DataFrame:
    """One half round: hang neighbours on the smallest node a node knows.

    larger: every node passes its smallest neighbour (or itself) to its larger neighbours;
    else to its smaller ones and to itself.  Only a minimum per node is grouped, so a hub costs
    one aggregated row; its edges (``most`` for the largest, of ``many`` in all) stay in their tasks and meet that row there.
    """
    both = _both(edges) if larger else edges
    met = attach(both, least, ["u"], "n", many) if most > HUB else both.join(least, "u")
    if larger:
        hung = met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        hung = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The smallest neighbour m and the number n of neighbours of every u; all edges, the largest n, and how many nodes are in no star.

    In a star around its smallest node, that node has only larger neighbours and the others have one neighbour each.
    """
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    found = least.agg(F.sum("n"), F.max("n"), F.count(F.when((F.col("m") < F.col("u")) & (F.col("n") > 1), 1))).head()
    return least, *(x or 0 for x in found)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v: bigint) reaches.

    Edges become stars inside their tasks, in blocks of BLOCK; what fits one block is done then.  Else the two half rounds alternate until the edges are
    stars around the smallest node of each component, which the neighbours counted for the next round tell.  Every round is written to the
    shared checkpoint folder, so a lost executor costs one round at most; the number of rounds grows
    with the logarithm of the longest path.  Self links and null ends are ignored; nodes without an
    edge have no row.  An empty table gives an empty table.
    """
    now, done = _in_blocks(edges.where("u is not null and v is not null and u <> v")
                           .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not done:
        least, many, most, loose = _least(_both(now))
        if not loose:
            break
        half = stage(_turn(now, least, True, many, most))
        least, many, most, _ = _least(half)
        now, done = _in_blocks(_turn(half, least, False, many, most))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
