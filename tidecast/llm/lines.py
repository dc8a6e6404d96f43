"""Cross-site boilerplate lines, found by how many distinct sites carry a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import SPACE_CHARS

MIN_SITES = 10
BAND = 0.2
LOG_REGISTERS = 12


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def line_table(docs: DataFrame, site: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, site, line): a row for every line with a word; line is the hash of the line without outer white space."""
    bare = F.filter(F.transform(F.split(F.col(text), "\n"), _bare), lambda x: F.length(x) > 0)
    return docs.select("doc_id", F.col(site).cast("string").alias("site"), F.explode(F.transform(bare, lambda x: F.xxhash64(x))).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(line, holder): lines on at least ``min_sites`` distinct sites, and the smallest doc_id that has each.

    A HyperLogLog sketch of the sites per line is built on the map side and merged by the aggregation, so a line that
    every document carries costs one sketch a task.  Estimates beyond the threshold by more than ``band`` are trusted;
    lines within the band get exact distinct counts.  Null sites are not counted.
    """
    spread = (lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min("doc_id").alias("holder"))
              .select("line", "holder", F.hll_sketch_estimate("sketch").alias("sites"))
              .where(F.col("sites") >= min_sites * (1 - band)))
    spread = written(spread)
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("line", "holder")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("line", "holder")
    exact = (lines.join(near, "line").where("site is not null").select("line", "holder", "site").distinct()
             .groupBy("line", "holder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line", "holder"))
    return sure.unionByName(exact)


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """``docs`` with cross-site boilerplate lines taken out of the text; every row and all columns stay.

    The document with the smallest doc_id that has a line keeps it, so no line disappears from the corpus, and the first of
    many copies keeps its text.  Rows without doc_id hold no lines; a line that only such rows have stays.  Lines are equal
    if they are equal without outer white space; lines without words always stay.  Null texts stay null; a text whose
    lines all go becomes empty.  Repeated rows are treated alike; an empty table gives an empty table.
    """
    base = docs.drop("__id", "__bad")
    lines = written(line_table(base, site, text))
    common = boilerplate(lines, min_sites, band)
    hits = (lines.join(common, "line").where(F.col("holder").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("holder")))
            .groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__bad")))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: (F.length(_bare(x)) == 0) | ~F.array_contains(F.col("__bad"), F.xxhash64(_bare(x)))), "\n")
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["__id"]), "left")
    return joined.select(*[(F.when(F.col("__bad").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(f"`{c}`")) for c in base.columns])
