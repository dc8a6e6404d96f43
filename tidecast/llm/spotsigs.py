"""SpotSigs document fingerprints: chains of content words that follow common words."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import let

#: Very common words of English, German, French and Spanish; they are the anchors and are left out of the chains.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this",
    "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "ce", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "ne", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "como", "con", "del", "el", "es", "los", "las", "lo", "no", "para", "por", "se", "su", "sus", "una", "y",
)
CHAIN = 3
AHEAD = 10
BLOCK_ROWS, BLOCKS = 2000, 20_000


def signatures(text: Column) -> Column:
    """The set of spot signatures of a whole text as a sorted array<int>; null counts as empty.

    A signature hashes an anchor and the next ``CHAIN`` words that are no anchors, among the ``AHEAD`` words after it.  Words are
    runs of letters, in lower case.  A word is an anchor too where none of the ``AHEAD`` words before it is common, so that
    lists and texts in other languages have signatures; the first word always is one, so no set is empty.  Whether a word
    starts a chain depends on its neighbours alone, and equal texts have equal sets.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    common = lambda x: x.isin(*ANCHORS)

    def spots(w):
        chain = lambda x, i: F.hash(x, F.slice(F.filter(F.slice(w, i + 2, F.lit(AHEAD)), lambda y: ~common(y) & (y != "")), 1, CHAIN))
        lonely = lambda i: ~F.exists(F.slice(w, F.greatest(i - AHEAD + 1, F.lit(1)), F.least(i, F.lit(AHEAD))), common)
        return F.filter(F.transform(w, lambda x, i: F.when(common(x) | lonely(i), chain(x, i))), lambda s: s.isNotNull())

    return F.sort_array(F.array_distinct(let(words, spots)))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 without comparing where their lengths rule out ``at_least``."""
    both = F.size(F.array_intersect(a, b))
    full = (both / (F.size(a) + F.size(b) - both)).cast("double")
    return F.when(F.least(F.size(a), F.size(b)) < at_least * F.greatest(F.size(a), F.size(b)), 0.0).otherwise(full)


def as_text(signature: Column) -> Column:
    """A fingerprint as a string: its signatures, comma-joined."""
    return F.array_join(signature.cast("array<string>"), ",")


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): every row with the text of the next one; null texts count as empty.

    Rows follow each other by falling doc_id, nulls last, rows of one doc_id by text hash; after the last one comes the first.
    Rows are dealt once, by blocks of neighbouring ids (of nulls: of hashes), and ordered within a block.  The first row of a block
    also goes to the block before it, where it stands last.  There are at most ``BLOCKS`` blocks of ids and as many of
    nulls, so the keys of these rows pass the driver (four numbers each) and are broadcast.
    """
    body, h = F.coalesce(F.col(text), F.lit("")), F.xxhash64(text)
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).head()
    some = lambda n: max(1, min(BLOCKS, n // BLOCK_ROWS))
    low, width = seen["low"] or 0, ((seen["high"] or 0) - (seen["low"] or 0)) // some(seen["ids"]) + 1
    nulls = some(seen["n"] - seen["ids"])
    of_null = F.least(F.floor((h.cast("double") / 2.0 ** 64 + 0.5) * nulls), F.lit(nulls - 1))
    block = F.when(F.col("doc_id").isNull(), -1 - of_null).otherwise(F.expr(f"(doc_id - {low}L) div {width}L"))
    keyed = docs.select("doc_id", body.alias("text"), h.alias("h"), block.cast("bigint").alias("block"))
    first = F.max(F.struct("doc_id", F.bitwise_not("h").alias("nh")))
    rows = keyed.groupBy("block").agg(first.alias("f")).select("block", "f.doc_id", F.bitwise_not("f.nh").alias("h")).collect()
    rows.sort(key=lambda r: -r["block"])
    # each block's first row goes to the block before it, that of the highest block to the lowest one
    told = [{"block": r["block"], "f_id": r["doc_id"], "f_h": r["h"], "before": rows[i - 1]["block"]} for i, r in enumerate(rows)]
    firsts = docs.sparkSession.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps(told)), "array<struct<block:bigint,f_id:bigint,f_h:bigint,before:bigint>>")))
    guests = keyed.join(F.broadcast(firsts), "block").where(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")))
    both = keyed.withColumn("guest", F.lit(False)).unionByName(
        guests.select("doc_id", "text", "h", F.col("before").alias("block"), F.lit(True).alias("guest")))
    order = Window.partitionBy("block").orderBy("guest", F.desc_nulls_last("doc_id"), "h")
    return both.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest")).select("doc_id", "text", "next_text")


def edit_likeness(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, signature, edited_signature, near_edited, near_next for every row of ``docs``.

    edited: the text with its last floor(n / 2) code points replaced by the first as many (or all) of the next row's, in the order of
    ``with_next``; likeness is that of signature sets, from 0 to 1.  Repeated rows each count; an empty table gives an empty
    table; a single row is its own next.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    held = with_next(docs, text).select("doc_id", "text", "next_text", edited.alias("edited"))
    made = held.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "edited", signatures(F.col("text")).alias("signature"),
                       signatures(F.col("edited")).alias("edited_signature"), signatures(F.col("next_text")).alias("next_signature"))
    return made.select("doc_id", "n_chars", "edited", "signature", "edited_signature",
                       likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
                       likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))


def near_pairs(sets: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(a, b, likeness), a < b: pairs of distinct signature sets (key, signature) at least so alike; equal sets must be merged before.

    Sets are partitioned by length: class k holds lengths from ``at_least`` ** -k to the next power, and a set meets only its own class
    and the one above.  Within a class two sets meet through one of their first (smallest) signatures, as many as leave
    too few for the likeness; the pairs that meet are pruned by length and then compared in full.
    """
    ratio = math.log(1 / at_least)
    size = F.size("signature")
    home = F.floor(F.log(size.cast("double")) / ratio + 1e-9).cast("int")
    lead = F.slice("signature", F.lit(1), size - F.ceil(size * at_least - 1e-9).cast("int") + 1)
    spread = sets.select("key", "signature", home.alias("home"), F.explode(lead).alias("spot"))
    left = spread.select(F.col("key").alias("a"), F.col("signature").alias("sa"), "spot", F.col("home").alias("class"))
    right = spread.select(F.col("key").alias("b"), F.col("signature").alias("sb"), "spot", F.col("home"), F.explode(F.array("home", F.col("home") - 1)).alias("class"))
    met = left.join(right, ["spot", "class"]).where((F.col("a") != F.col("b")) & ((F.col("home") > F.col("class")) | (F.col("a") < F.col("b"))))
    close = met.where(F.least(F.size("sa"), F.size("sb")) >= at_least * F.greatest(F.size("sa"), F.size("sb")))
    scored = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb"), at_least).alias("likeness"))
    return scored.where(F.col("likeness") >= at_least).distinct()
