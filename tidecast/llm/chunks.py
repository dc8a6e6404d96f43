"""Repeated passages by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that the rolling hash sees, and half the stretch in which a cut's hash must be the smallest.
SEEN, REACH = 16, 16
LONGEST = 4096
SIZE_BITS, WORD_BITS = 13, 13
PIECE = 1 << 20


def gear_table(seed: int = 1) -> np.ndarray:
    """A random 32-bit number for every byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


_GEAR = gear_table()


def _hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash after every byte: the sum over the last ``SEEN`` bytes, shifted by their distance."""
    h, reach = _GEAR[data], 1
    while reach < SEEN:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h


def _least(h: np.ndarray) -> np.ndarray:
    """Smallest of the ``REACH`` values from each place on."""
    m, reach = h, 1
    while reach < REACH:
        step = min(reach, REACH - reach)
        m = np.minimum(m, np.r_[m[step:], np.full(min(step, len(m)), np.iinfo(np.uint32).max, np.uint32)])
        reach += step
    return m


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array: after the bytes whose hash is smaller than the ``REACH`` before and not
    larger than the ``REACH`` after, moved on to the next start of a character; at most ``LONGEST`` apart.

    A cut depends on the bytes around it alone, so an insertion moves no cut beyond its neighbourhood.
    """
    n = len(data)
    h = _hashes(data)
    after = _least(h)
    before = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    before[REACH:] = after[:-REACH]
    at = np.flatnonzero((h < before) & (h <= np.r_[after[1:], np.uint32(np.iinfo(np.uint32).max)]))
    at = at[at >= REACH] + 1
    ends = np.unique(np.r_[at[at < n], n])
    start = np.r_[0, ends[:-1]]
    long = np.flatnonzero(ends - start > LONGEST)
    if len(long):
        ends = np.unique(np.concatenate([ends] + [np.arange(start[i] + LONGEST, ends[i], LONGEST) for i in long]))
    begins = np.append((data & 0xC0) != 0x80, True)
    for _ in range(3):
        ends = np.where(begins[ends], ends, ends + 1)
    return np.unique(ends)


def chunk_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(digest, place) of every chunk; place packs the start and the size in code points and the number of words that start in it."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data)
    starts = np.r_[0, ends[:-1]]
    digest = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    words = np.r_[0, np.cumsum(~space & np.r_[True, space[:-1]])]
    a, size, n = chars[starts], chars[ends] - chars[starts], words[ends] - words[starts]
    return digest.astype(np.int64), (a << (SIZE_BITS + WORD_BITS)) | (size << WORD_BITS) | n


def chunk_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, doc_id, place) of every chunk of every text; rows without doc_id and null or empty texts have none."""
    def run(batches):
        for batch in batches:
            ids, digests, places, size = [], [], [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if not t:
                    continue
                digest, place = chunk_text(t)
                ids.append(np.full(len(digest), d, np.int64))
                digests.append(digest)
                places.append(place)
                size += len(digest)
                if size > PIECE:
                    yield _rows(digests, ids, places)
                    ids, digests, places, size = [], [], [], 0
            if size:
                yield _rows(digests, ids, places)

    def _rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["digest", "doc_id", "place"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, "digest bigint, doc_id bigint, place bigint")


def repeated_passages(docs: DataFrame, min_words: int = 20, text: str = "text") -> DataFrame:
    """doc_id, start, end (code points, end exclusive), n_words, first_doc_ids, removed: runs of chunks that other documents have too.

    Chunks are found again by digest.  A passage is a run of adjoining chunks, each of which stands in at least two
    documents, with at least ``min_words`` words, all of them first held by this document or all by earlier ones; first_doc_ids are the
    smallest doc_ids that have its chunks, and removed tells whether these are other documents (the first one keeps the passage).  A passage that repeats over more than about 50 bytes beyond
    ``min_words`` words is found wherever it stands.  Rows that repeat a doc_id count as one document, repeats within
    a document do not count, and rows without doc_id take no part.  Documents without repeats have no row.

    Digests are counted with map-side partial sums, and only found chunks are sorted by document, so a passage
    that many documents share is never in one task.
    """
    chunks = chunk_table(docs, text)
    shared = (chunks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
              .where("first <> last").select("digest", "first"))
    low = (1 << WORD_BITS) - 1
    found = chunks.join(shared, "digest").select(
        "doc_id", "first", F.shiftright("place", SIZE_BITS + WORD_BITS).alias("start"),
        (F.shiftright("place", SIZE_BITS + WORD_BITS) + F.shiftright("place", WORD_BITS).bitwiseAND((1 << SIZE_BITS) - 1)).alias("end"),
        F.col("place").bitwiseAND(low).alias("words"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    later = F.col("first") != F.col("doc_id")
    fresh = F.when((F.lag("end").over(order) >= F.col("start")) & (F.lag(later).over(order) == later), 0).otherwise(1)
    runs = (found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
            .groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"),
                                          F.array_sort(F.collect_set("first")).alias("first_doc_ids")))
    return (runs.where(F.col("n_words") >= min_words)
            .select("doc_id", "start", "end", "n_words", "first_doc_ids", (~F.array_contains("first_doc_ids", F.col("doc_id"))).alias("removed")))


def remove_passages(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the passages marked as removed; all rows and columns stay."""
    base = docs.drop("__id", "__cut")
    gone = (passages.where("removed").groupBy(F.col("doc_id").alias("__id"))
            .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cut")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda a, x: F.substring(F.col(text), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
    walked = F.aggregate("__cut", start, lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(piece(a, x))).alias("out")),
                         lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))))
    now = F.when(F.col("__cut").isNull(), F.col(text)).otherwise(walked)
    return (base.join(gone, F.col("doc_id") == F.col("__id"), "left")
            .select(*[now.alias(text) if c == text else F.col(f"`{c}`") for c in base.columns]))
