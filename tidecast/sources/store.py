"""Run store: one Parquet table per artifact, partitioned by experiment."""

from __future__ import annotations

import json
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTIFACTS = ("runs", "series_points", "leaderboard", "backtest", "trials", "forecast", "diagnostics")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


MANIFESTS = "_manifests"


def save_run(tables: dict[str, DataFrame], root: str, experiment_id: str) -> None:
    """Write the tables of one run; saving the same run again replaces it and nothing else.

    Tables first, then a manifest that lists them with their schemas.  ``load_run`` reads what a manifest lists, so a table
    without rows comes back empty, a run broken off is not read at all, and tables of an earlier saving that are not in this one are gone.
    """
    spark = next(iter(tables.values())).sparkSession
    _unlist(spark, root, experiment_id)
    for name in set(stored_tables(spark, root)) - set(tables):
        _drop_partition(spark, f"{root}/{name}", experiment_id)
    for name, df in tables.items():
        seen = Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("experiment_id", F.lit(experiment_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").parquet(f"{root}/{name}"))
        if not seen.get["n"] and name in stored_tables(spark, root):  # the writer replaces no partition by nothing
            _drop_partition(spark, f"{root}/{name}", experiment_id)
    listed = [(experiment_id, name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(listed, "experiment_id string, name string, schema string").coalesce(1).write.mode("overwrite").json(_manifest(root, experiment_id))


def _manifest(root: str, experiment_id: str) -> str:
    return f"{root}/{MANIFESTS}/{quote(experiment_id, safe='')}"


def _unlist(spark: SparkSession, root: str, experiment_id: str) -> bool:
    fs, p = _fs(spark, _manifest(root, experiment_id))
    return bool(fs.exists(p) and fs.delete(p, True))


def manifest(spark: SparkSession, root: str, experiment_id: str) -> dict[str, T.StructType] | None:
    """Tables and schemas of a run that was saved to its end; None if there is none."""
    fs, p = _fs(spark, f"{_manifest(root, experiment_id)}/_SUCCESS")
    if not fs.exists(p):
        return None
    rows = spark.read.schema("name string, schema string").json(_manifest(root, experiment_id)).collect()  # a row a table
    return {r["name"]: T.StructType.fromJson(json.loads(r["schema"])) for r in rows}


def stored_runs(spark: SparkSession, root: str) -> list[str]:
    """Runs that were saved to their end."""
    fs, p = _fs(spark, f"{root}/{MANIFESTS}")
    return sorted(unquote(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []


def stored_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables under ``root`` that hold any run."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    folders = [f.getPath() for f in fs.listStatus(p) if f.isDirectory()]
    return sorted(d.getName() for d in folders if any(x.getPath().getName().startswith("experiment_id=") for x in fs.listStatus(d)))


def load_run(spark: SparkSession, root: str, experiment_id: str, names=None) -> dict[str, DataFrame]:
    """Tables of one run, as its manifest lists them; without such a run (or one saved to its end) all stored tables, without rows.

    The filter prunes to the run's partition, so other runs are not read; every table has the columns and types it was saved with.
    """
    listed, out = manifest(spark, root, experiment_id), {}
    stored = set(stored_tables(spark, root))
    if listed is None:
        return {n: spark.read.option("basePath", f"{root}/{n}").parquet(f"{root}/{n}").where("false") for n in names or sorted(stored)}
    for name in names or listed:
        if name not in listed:
            raise KeyError(f"run {experiment_id!r} has no table {name!r}")
        if name not in stored:  # no run has a row in it
            out[name] = spark.createDataFrame([], listed[name]).withColumn("experiment_id", F.lit(experiment_id))
            continue
        full = T.StructType([*listed[name].fields, T.StructField("experiment_id", T.StringType())])
        df = spark.read.schema(full).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
        out[name] = df.where(F.col("experiment_id") == F.lit(experiment_id))
    return out


def _drop_partition(spark: SparkSession, table: str, experiment_id: str) -> bool:
    """A partition's folder is found by the value it stands for, since the writer escapes characters such as ``:`` in names."""
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    fs, p = _fs(spark, table)
    gone = False
    for folder in fs.listStatus(p):
        key, _, value = folder.getPath().getName().partition("=")
        if key == "experiment_id" and plain(value) == experiment_id:
            gone |= bool(fs.delete(folder.getPath(), True))
    return gone


def delete_run(spark: SparkSession, root: str, experiment_id: str) -> int:
    """Remove a run: its manifest first, then its partitions; returns how many tables held rows of it.  No data is rewritten."""
    if not experiment_id or "/" in experiment_id:
        raise ValueError("experiment_id must be a plain name")
    _unlist(spark, root, experiment_id)
    return sum(_drop_partition(spark, f"{root}/{name}", experiment_id) for name in stored_tables(spark, root))
