"""Audit of how filters interact, from sorted posting lists of the documents that fail them.

Every row gets a document number.  For each part and each range of numbers one record holds, per filter, the rising list of the
numbers that fail.  A range's lists are merged set by set: the union with one more filter is the union before plus what a galloping
merge finds missing in it.  Only the sizes leave a range and are summed; all orders, steps and shares follow from them.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import ascii_words, let

RANGE_BITS = 14


def filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions that look at one text; E, copies, is found across the table."""
    body = F.coalesce(F.col(text), F.lit(""))
    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(ascii_words(F.col(text))) < 100,
            "B": let(ascii_words(F.col(text)), lambda w: 100 * F.size(F.array_distinct(w)) < 80 * F.size(w)),
            "C": 100 * capitals > 10 * F.length(body),
            "D": body.rlike("[#$%&*|]")}


def _numbered(docs: DataFrame, conditions: dict[str, Column], part: str, text: str) -> DataFrame:
    """(number, doc_id, part, digest, fails) written once: what the audit needs to know of every row, in one pass over the texts."""
    return written(docs.select(
        F.monotonically_increasing_id().alias("number"), F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)).alias("digest"),
        F.array(*[F.coalesce(c, F.lit(False)) for c in conditions.values()]).alias("fails")))


def _copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: a smaller doc_id has the same text.

    The first holder of each text is looked up by text and doc_id together, so no text, however common, is a key of its own in the join;
    null ids are told apart by their number.
    """
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    key = F.when(F.col("doc_id").isNull(), F.col("number")).otherwise(F.lit(-1))
    holders = first.select("doc_id", "digest", F.lit(-1).cast("bigint").alias("__apart"), F.lit(True).alias("__holds"))
    return (rows.withColumn("__apart", key).join(holders, ["doc_id", "digest", "__apart"], "left")
            .withColumn("copy", F.col("doc_id").isNotNull() & F.col("__holds").isNull()).drop("__holds"))


def postings(docs: DataFrame, labels: DataFrame | None = None, conditions: dict[str, Column] | None = None, part: str = "lang",
             text: str = "text", marks: dict[str, Column] | None = None, copies: bool = True) -> DataFrame:
    """(part, range, n, one rising bigint list of failing document numbers a filter, one list a mark), written.

    ``marks`` are conditions on the columns of ``labels``; a document has a mark if any of its labels has.  A record holds
    at most 2^RANGE_BITS documents.  Null texts are empty, null parts the empty string; repeated rows count each by itself; an empty table
    gives an empty table.
    """
    conditions = filters(text) if conditions is None else conditions
    marks = {} if marks is None else marks
    rows = _numbered(docs, conditions, part, text)
    names = list(conditions)
    rows = rows.select("number", "doc_id", "part", "digest", *[F.col("fails")[i].alias(f"fails_{n}") for i, n in enumerate(names)])
    if copies:
        rows, names = _copies(rows).withColumnRenamed("copy", "fails_E"), [*names, "E"]
    else:
        rows = rows.withColumn("__apart", F.when(F.col("doc_id").isNull(), F.col("number")).otherwise(F.lit(-1)))
    if marks:
        marked = (labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"mark_{m}") for m, c in marks.items()])
                  .withColumn("__apart", F.lit(-1).cast("bigint")))
        rows = rows.join(marked, ["doc_id", "__apart"], "left")
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c), F.col("number")))).alias(c)
    return written(rows.groupBy("part", F.shiftright("number", RANGE_BITS).alias("range"))
                   .agg(F.count(F.lit(1)).alias("n"), *[listed(f"fails_{n}") for n in names], *[listed(f"mark_{m}") for m in marks]))


def gallop(keys: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The place of every key (rising) in a rising run.

    Every 64th key is placed first; the keys between two of them are searched only between their places, so a
    stretch of the run in which no key lies is jumped over.
    """
    if len(keys) <= 64 or len(run) <= 64:
        return np.searchsorted(run, keys)
    posts = np.searchsorted(run, keys[::64])
    low = np.repeat(posts, 64)[:len(keys)]
    high = np.repeat(np.r_[posts[1:], len(run)], 64)[:len(keys)]
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        right = open_ & (run[np.minimum(middle, len(run) - 1)] < keys)
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)


def missing(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The numbers of ``some`` that ``others`` lacks; both rising."""
    if not len(some) or not len(others):
        return some
    if len(others) < len(some):  # the shorter list is the one that is looked up
        at = gallop(others, some)
        found = at[(at < len(some)) & (some[np.minimum(at, len(some) - 1)] == others)]
        keep = np.ones(len(some), bool)
        keep[found] = False
        return some[keep]
    at = gallop(some, others)
    return some[(at == len(others)) | (others[np.minimum(at, len(others) - 1)] != some)]


def union_sizes(lists: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """For every set of filters (bit i: list i), how many numbers the union of their lists has, and how many of those carry each mark."""
    out = np.zeros((1 << len(lists), 1 + len(marks)), np.int64)
    unions = [np.zeros(0, np.int64)]
    for s in range(1, 1 << len(lists)):
        top = s.bit_length() - 1
        before = s ^ (1 << top)
        fresh = missing(lists[top], unions[before])
        out[s, 0] = out[before, 0] + len(fresh)
        for m, mark in enumerate(marks):
            out[s, m + 1] = out[before, m + 1] + len(fresh) - len(missing(fresh, mark))
        unions.append(np.insert(unions[before], gallop(fresh, unions[before]), fresh) if len(fresh) else unions[before])
    return out


def sizes(lists: DataFrame) -> DataFrame:
    """(part, n, sizes): the number of documents of each part, and sizes[s], an array per set s of filters: documents that fail one of them, and those with each mark."""
    names = [c for c in lists.columns if c.startswith("fails_")]
    marks = [c for c in lists.columns if c.startswith("mark_")]

    def merge(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                got = union_sizes([at(c) for c in names], [at(c) for c in marks])
                k = len(got)
                yield pa.RecordBatch.from_arrays([batch.column("part").slice(i, 1).take([0] * k), pa.array(np.where(np.arange(k), 0, batch.column("n")[i].as_py())), pa.array(np.arange(k, dtype=np.int32)),
                                                  *[pa.array(np.ascontiguousarray(got[:, j])) for j in range(got.shape[1])]], names=["part", "n", "filters", "failing", *marks])

    numbers = ["failing", *marks]
    made = lists.select("part", "n", *names, *marks).mapInArrow(merge, "part string, n bigint, filters int, " + ", ".join(f"{c} bigint" for c in numbers))
    summed = made.groupBy("part", "filters").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in numbers])
    return summed.groupBy("part").agg(F.sum("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("filters", F.array(*numbers).alias("size")))), lambda x: x["size"]).alias("sizes"))


def interactions(counted: DataFrame, names: str = "ABCDE", marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """One row per part, filter_order (every permutation of ``names``) and step, from ``sizes``.

    kept, removed, redundant, unique_fails and <mark>_lost are counts of documents; shapley sums a filter's removals over all orders.
    Sets of filters grow as 2^n and orders as n!, so this is for a handful of filters.
    """
    orders = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order):
            orders.append({"filter_order": "".join(names[j] for j in order), "step": step + 1, "i": i, "bit": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    steps = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order: string, step: int, i: int, bit: int, before: int, after: int>>")
    full = (1 << len(names)) - 1
    size = lambda s, k=0: F.col("sizes")[s][k]
    share = []
    for i in range(len(names)):
        terms = []
        for s in range(full + 1):
            if not s >> i & 1:
                others = s.bit_count()
                terms.append((size(F.lit(s | 1 << i)) - size(F.lit(s))) * (factorial(others) * factorial(len(names) - 1 - others)))
        share.append(sum(terms[1:], terms[0]))
    both = counted.withColumn("__share", F.array(*share)).select("*", F.inline(steps))
    removed = size(F.col("after")) - size(F.col("before"))
    alone = size(F.col("bit"))
    return both.select("part", "filter_order", "step", (F.col("n") - size(F.col("after"))).alias("kept"), removed.alias("removed"), (alone - removed).alias("redundant"),
                       (size(F.lit(full)) - size(F.lit(full) - F.col("bit"))).alias("unique_fails"),
                       *[(size(F.col("after"), k + 1) - size(F.col("before"), k + 1)).alias(f"{m}_lost") for k, m in enumerate(marks)],
                       F.col("__share")[F.col("i")].alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """The interactions of the filters A to E over whole texts, per part, with the good and toxic documents each step costs.

    A document without labels is neither good nor toxic; one with several is either if any of them says so.  Rows without doc_id have no labels, are no
    copies and have none.  Repeated rows count each by itself and are no copies of each other (no id is smaller).  An empty table gives an empty table; other columns are ignored.
    """
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    base = docs.select("doc_id", F.col(text), F.col(part))
    return interactions(sizes(postings(base, labels.select("doc_id", "quality", "toxic"), part=part, text=text, marks=marks)))
