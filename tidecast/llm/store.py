"""Intermediate tables as Parquet in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder


def written(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``spark.checkpoint.dir`` and read it from there (runs a job).

    Unlike a checkpoint the table is compressed and later reads take only the columns they need.  It
    survives lost executors; the folder's owner clears it after the run, as it does with checkpoints.
    ``folders`` are columns that get a folder for each value (few, and whole numbers or texts).
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
