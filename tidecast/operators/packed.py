"""Fitted trees as flat node arrays: packing, walking and exact Shapley values.

A model's nodes are read from the table it saves itself, one record a tree: int16 feature (-1 at leaves), double cut, int32 child (the
left child follows its parent), double value and row count.  Up to ``MOST_BYTES`` the arrays go to every task; beyond that rows and
blocks of trees meet by a shuffle and the blocks' parts are added, so that no task holds more than one block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

MOST_BYTES, BLOCK_BYTES = 256 << 20, 64 << 20
NODE_BYTES = 2 + 8 + 4 + 8 + 8
#: Numbers that an explanation holds at once.
HELD = 1 << 21
COLUMNS = ("feature", "cut", "right", "value", "count")
KINDS = dict(zip(COLUMNS, (np.int16, np.float64, np.int32, np.float64, np.float64)))
SCHEMA = "tree int, weight double, nodes bigint, " + ", ".join(f"{c} binary" for c in COLUMNS)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def node_table(fitted, spark, forest: bool) -> DataFrame:
    """One record a tree of a fitted MLlib ensemble (writes the model to the shared folder)."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    fitted.write().save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(fitted.treeWeights)], "tree int, weight double")
    scale = 1.0 / len(fitted.treeWeights) if forest else 1.0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), "nodeData.id", F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.prediction").alias("value"), F.col("nodeData.rawCount").cast("double").alias("count"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        left, ids = t.column("left").to_numpy(), t.column("id").to_numpy()
        inner = left >= 0
        if not (ids == np.arange(len(ids))).all() or not (left[inner] == ids[inner] + 1).all():
            raise ValueError("nodes are not listed parent before left child before right child")
        own = {"feature": np.where(inner, t.column("feature").to_numpy(), -1), "cut": np.where(inner, t.column("cut").fill_null(0.0).to_numpy(), 0.0),
               "right": np.where(inner, t.column("right").to_numpy(), ids), "value": t.column("value").to_numpy(), "count": t.column("count").to_numpy()}
        return pa.table({"tree": t.column("tree").slice(0, 1), "weight": t.column("weight").slice(0, 1), "nodes": pa.array([len(ids)]),
                         **{c: pa.array([own[c].astype(KINDS[c]).tobytes()], pa.binary()) for c in COLUMNS}})

    named = nodes.join(F.broadcast(weights.withColumn("weight", F.col("weight") * scale)), "tree")  # a row a tree
    return named.groupBy("tree").applyInArrow(pack, SCHEMA)


def unpacked(records) -> dict[str, np.ndarray]:
    """The arrays of some trees (dicts of ``SCHEMA``) one behind the other; child numbers are places in these arrays."""
    records = list(records)
    start = np.cumsum([0, *[r["nodes"] for r in records]])
    out = {c: np.concatenate([np.zeros(0, KINDS[c]), *[np.frombuffer(r[c], KINDS[c]) for r in records]]) for c in COLUMNS}
    shift = np.repeat(start[:-1], np.diff(start))
    out["right"] = out["right"].astype(np.int64) + shift
    at = np.arange(len(shift))
    out["left"] = np.where(out["feature"] < 0, at, at + 1)
    return out | {"roots": start[:-1], "weight": np.array([r["weight"] for r in records], float)}


def tree_values(trees: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Weighted sum of the trees' values for rows ``x``."""
    at = np.broadcast_to(trees["roots"], (len(x), len(trees["roots"]))).copy()
    rows = np.arange(len(x))[:, None]
    while (trees["feature"][at] >= 0).any():
        low = x[rows, np.maximum(trees["feature"][at], 0)] <= trees["cut"][at]
        at = np.where(trees["feature"][at] < 0, at, np.where(low, trees["left"][at], trees["right"][at]))
    return trees["value"][at] @ trees["weight"]


def leaf_paths(trees: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For every leaf the features on its way, each with the interval (low, high] and the share of rows that all its cuts let pass; value is weighted."""
    found: list[tuple] = []
    for root, weight in zip(trees["roots"].tolist(), trees["weight"].tolist()):
        todo = [(root, {})]
        while todo:
            node, way = todo.pop()
            f = int(trees["feature"][node])
            if f < 0:
                found.append((weight * trees["value"][node], way))
                continue
            low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
            cut, n = trees["cut"][node], trees["count"][node]
            left, right = trees["left"][node], trees["right"][node]
            todo.append((left, way | {f: (low, min(high, cut), share * trees["count"][left] / n)}))
            todo.append((right, way | {f: (max(low, cut), high, share * trees["count"][right] / n)}))
    depth = max([1, *[len(w) for _, w in found]])
    feature = np.full((len(found), depth), -1)
    low, high, share = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf), np.ones(feature.shape)
    for i, (_, way) in enumerate(found):
        for j, (f, (a, b, s)) in enumerate(way.items()):
            feature[i, j], low[i, j], high[i, j], share[i, j] = f, a, b, s
    return {"value": np.array([v for v, _ in found], float), "feature": feature, "low": low, "high": high, "share": share}


def tree_shapley(paths: dict[str, np.ndarray], x: np.ndarray, reference: np.ndarray | None = None) -> np.ndarray:
    """Exact Shapley values (rows x features).

    An absent feature follows both branches by the shares of training rows; or, with a ``reference`` row, takes its value there.  A leaf
    of value v whose features j pass the row by o_j and are absent by w_j gives feature j
    v (o_j - w_j) * integral over t of prod_{k <> j} ((1 - t) w_k + t o_k): all orders of the features are in this integral, a
    polynomial, which a few Gauss points give exactly.
    """
    out = np.zeros(x.shape)
    depth = paths["feature"].shape[1]
    nodes, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    nodes, weights = (nodes + 1) / 2, weights / 2
    step = max(1, HELD // max(1, len(x) * depth))
    for at in range(0, len(paths["value"]), step):
        f, low, high, w, v = (paths[c][at:at + step] for c in ("feature", "low", "high", "share", "value"))
        here = np.maximum(f, 0)
        inside = lambda z: ((z[:, here] > low) & (z[:, here] <= high)) | (f < 0)  # noqa: B023, E731
        o = inside(x).astype(float)
        if reference is not None:
            w = inside(reference[None])[0].astype(float)
        total = np.zeros(o.shape)
        for t, g in zip(nodes, weights):
            factor = (1 - t) * w + t * o
            whole = factor.prod(2, keepdims=True)
            total += g * np.divide(whole, factor, out=np.zeros_like(factor), where=factor > 0)
        total *= (o - w) * v[:, None]
        owner = np.zeros((f.size, x.shape[1]))
        owner[np.flatnonzero(f.ravel() >= 0), f.ravel()[f.ravel() >= 0]] = 1.0
        out += total.reshape(len(x), -1) @ owner
    return out


def expected_value(paths: dict[str, np.ndarray]) -> float:
    """The prediction when every feature is absent: leaves weighted by their shares."""
    return float((paths["value"] * paths["share"].prod(1)).sum())


def over_blocks(rows: DataFrame, table: DataFrame, blocks: int, apply, salts: int = 1) -> DataFrame:
    """(id, out): ``apply(trees, x)`` (a row of numbers for each) for every row (id, x: array<double>), added over all blocks of trees.

    A task holds one block; its rows pass in Arrow batches.  ``salts`` deals the rows of a block over so many tasks, each with a copy of the block.
    """
    parts = table.select((F.col("tree") % blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("bigint").alias("id"),
                         F.lit(None).cast("array<double>").alias("x"), *NAMES)
    asked = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "id", "x",
                        *[F.lit(None).cast(dict(table.dtypes)[c]).alias(c) for c in NAMES])
    met = parts.unionByName(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("id").asc_nulls_first())

    def run(batches):
        key, held, trees = None, [], None
        for batch in batches:
            where = np.column_stack([batch.column(c).to_numpy() for c in ("block", "salt")])
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)]).tolist() + [batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if tuple(where[a]) != key:
                    key, held, trees = tuple(where[a]), [], None
                part = batch.slice(a, b - a)
                plain = part.column("id").is_valid().to_numpy(zero_copy_only=False)
                held += part.filter(pa.array(~plain)).select(NAMES).to_pylist()
                asked = part.filter(pa.array(plain))
                if asked.num_rows:
                    trees = unpacked(held) if trees is None else trees
                    held = [] if trees is not None else held
                    x = np.stack([np.asarray(r, float) for r in asked.column("x").to_pylist()])
                    got = apply(trees, x).reshape(len(x), -1)
                    yield pa.RecordBatch.from_arrays([asked.column("id"), pa.array(list(got), pa.list_(pa.float64()))], names=["id", "out"])

    summed = met.mapInArrow(run, "id bigint, out array<double>").groupBy("id").agg(F.collect_list("out").alias("parts"))
    return summed.select("id", F.reduce("parts", F.array_repeat(F.lit(0.0), F.size(F.col("parts")[0])), lambda a, b: F.zip_with(a, b, lambda p, q: p + q)).alias("out"))
