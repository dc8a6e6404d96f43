"""Reading tables: clean headers, delimiter and encoding detection, several sheets, previews, digests."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The delimiters looked for, in order of preference.
DELIMITERS = (",", "\t", ";", "|")


def clean_header(names) -> list[str]:
    """Names without blanks around them: an empty one becomes column_n, and a name already taken gets the first free _2, _3, ..."""
    plain = [(raw or "").strip().lstrip("\ufeff") or f"column_{i}" for i, raw in enumerate(names, start=1)]
    taken: set[str] = set()
    for i, name in enumerate(plain):
        if name in taken:
            free = next(k for k in range(2, len(plain) + 2) if f"{name}_{k}" not in taken and f"{name}_{k}" not in plain)
            plain[i] = f"{name}_{free}"
        taken.add(plain[i])
    return plain


def encoding_of(lines: DataFrame, col: str = "value") -> str:
    """UTF-8 unless any line holds bytes that are not; then GB18030.  Stops at the first such line."""
    return "GB18030" if lines.where(~F.is_valid_utf8(col)).limit(1).take(1) else "UTF-8"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """Encoding of a text file, judged by all its lines."""
    return encoding_of(spark.read.text(path))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, start, at: the lines of text files with the block they lie in and their order inside it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                        F.monotonically_increasing_id().alias("at"))


def _running(lines: DataFrame, value: Column, name: str, by=("file", "start")) -> DataFrame:
    """``lines`` with the sum of ``value`` over all lines of the file before each: inside its block by a window, and of the blocks before by their sums."""
    w = W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sums = lines.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*by, F.coalesce(before, F.lit(0)).alias("_off"))
    return (lines.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0))).join(offsets, list(by))
            .withColumn(name, F.col("_own") + F.col("_off")).drop("_own", "_off"))


def quoted_records(lines: DataFrame) -> DataFrame:
    """``lines`` (value, file, start, at) with ``inside``, whether a line begins within quotes, and ``record``, the number of its record in the file.

    The parity of the quotes before a line is a prefix sum over blocks, so a file's blocks are read in parallel although quotes may hold line ends.
    """
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    told = _running(lines, marks, "_quotes").withColumn("inside", F.col("_quotes") % 2 == 1).drop("_quotes")
    return _running(told, (~F.col("inside")).cast("int"), "_starts").withColumn("record", F.col("_starts") + (~F.col("inside")).cast("int")).drop("_starts")


def delimiter_counts(lines: DataFrame, candidates=DELIMITERS, col: str = "value", order: str | None = None) -> DataFrame:
    """i, lines, mean, spread, first: how often each candidate stands on the records with text, outside quotes (one row each).

    Lines are records of their own, unless they come from ``quoted_records``.  ``order`` says which is the first one.
    """
    over = "inside" in lines.columns
    inside = F.col("inside").cast("int") if over else F.lit(0)
    bare = F.array_join(F.filter(F.split(col, '"'), lambda x, i: (i + inside) % 2 == 0), "")
    counted = lines.where(F.trim(col) != "").withColumn("_bare", bare)
    counted = counted.withColumn("_n", F.array(*[(F.length("_bare") - F.length(F.replace("_bare", F.lit(d), F.lit("")))).cast("int") for d in candidates]))
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    if over:  # only records over several lines are gathered
        odd = (F.length(col) - F.length(F.replace(F.col(col), F.lit('"'), F.lit("")))) % 2 == 1
        alone = counted.where(~F.col("inside") & ~odd).select(F.struct("file", "start", "at").alias("_l"), "_n")
        sums = [F.sum(F.col("_n")[i]).cast("int") for i in range(len(candidates))]
        parts = counted.where(F.col("inside") | odd).groupBy("file", "record").agg(F.min(F.struct("file", "start", "at")).alias("_l"), F.array(*sums).alias("_n"))
        counted = alone.unionByName(parts.select("_l", "_n"))
    else:
        counted = counted.select(place.alias("_l"), "_n")
    found = counted.select("_l", F.posexplode("_n").alias("i", "n"))
    return found.groupBy("i").agg(F.count("*").alias("lines"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("spread"), F.min_by("n", "_l").alias("first"))


def delimiter_of(lines: DataFrame, candidates=DELIMITERS, col: str = "value") -> str:
    """The delimiter that occurs equally often in every record; else the most frequent in the first."""
    stats = delimiter_counts(lines, candidates, col).collect()
    steady = [r for r in stats if r["mean"] > 0 and r["spread"] == 0]
    if steady:
        return candidates[max(steady, key=lambda r: (r["mean"], -r["i"]))["i"]]
    top = max(stats, key=lambda r: (r["first"], -r["i"]), default=None)
    return candidates[top["i"]] if top is not None and top["first"] else candidates[0]


def detect_delimiter(spark: SparkSession, path: str, candidates=DELIMITERS) -> str:
    """Delimiter of text files, judged by all their records (quotes may hold delimiters and line ends); one row a candidate reaches the driver."""
    return delimiter_of(quoted_records(file_lines(spark, path)), candidates)


def read_table(spark: SparkSession, path: str, fmt: str = "csv", sep: str | None = None,
               encoding: str = "UTF-8", **options) -> DataFrame:
    """CSV as text columns with clean names, or a typed format as it is.

    GB18030 needs ``spark.sql.legacy.javaCharsets=true`` in the session.
    """
    if fmt != "csv":
        return spark.read.format(fmt).options(**options).load(path)
    if encoding.upper().replace("-", "") != "UTF8" and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ValueError(f"set spark.sql.legacy.javaCharsets=true to read {encoding}")
    sep = sep or detect_delimiter(spark, path)
    reader = spark.read.options(sep=sep, encoding=encoding, **options)
    head = reader.option("header", False).csv(path).limit(1).collect()
    names = clean_header(head[0] if head else [])
    _check_headers(spark, path, sep, encoding, names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (bytes): the first line with text of every file, in one job."""
    lines = file_lines(spark, path).where((F.col("start") == 0) & (F.trim("value") != ""))
    return lines.groupBy("file").agg(F.min_by(F.col("value").cast("binary"), "at").alias("line"))


def _check_headers(spark: SparkSession, path: str, sep: str, encoding: str, names: list[str]) -> None:
    """Files of other columns would be read into the wrong ones.  Equal lines are told once, so the driver sees one row for each different header."""
    if len(spark.read.text(path).inputFiles()) < 2:
        return
    different = first_lines(spark, path).groupBy("line").agg(F.min("file").alias("file")).toLocalIterator()
    for r in different:
        head = next(csv.reader([bytes(r["line"]).decode(encoding, "replace")], delimiter=sep))
        if clean_header(head) != names:
            raise ValueError(f"{r['file']} has other columns than the first file: read it apart")


def read_sheets(spark: SparkSession, sheets: dict[str, str], **options) -> DataFrame:
    """One path per sheet, united by column name; ``sheet`` tells them apart."""
    parts = [read_table(spark, p, **options).withColumn("sheet", F.lit(s)) for s, p in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def preview(df: DataFrame, n: int = 100) -> tuple[DataFrame, int]:
    """The first rows and the exact row count (runs a count)."""
    return df.limit(n), df.count()


PIECE = 8 << 20


def file_digest(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """path, bytes, sha256 of every file, whatever its size.

    Files are digested in parallel, each by one task that reads it as a stream in pieces of ``piece`` bytes; only names and lengths
    come from the listing (which leaves out empty files), no file is ever one value.  Executors open the paths with Arrow's file systems.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")  # the content is not read

    def digest(batches):
        import hashlib

        from pyarrow import fs
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                system, place = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", name), safe="/:"))
                h, seen = hashlib.sha256(), 0
                with system.open_input_stream(place) as stream:
                    while part := stream.read(piece):
                        h.update(part)
                        seen += len(part)
                if seen != length:
                    raise OSError(f"{name} has {length} bytes, but {seen} were read")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seen]), pa.array([h.hexdigest()])], names=["path", "bytes", "sha256"])

    return listed.mapInArrow(digest, "path string, bytes bigint, sha256 string")
