"""Session defaults for one machine, and staging of shared results."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidecast", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster use the session you are given."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", partitions)
             .config("spark.driver.memory", memory)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="tidecast-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` once to the shared folder and go on from there (runs a job); it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def share_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that Python workers find it wherever they start."""
    sc = spark.sparkContext
    if getattr(sc, "_tidecast_shared", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidecast-")
    copy = shutil.copytree(here, os.path.join(folder, "src", "tidecast"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tidecast"), "zip", os.path.dirname(copy), "tidecast"))
    sc._tidecast_shared = True
