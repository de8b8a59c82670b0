"""Durable cuts of lineage for the core operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors reach: spark.checkpoint.dir. Where it is unset a local master (tests) gets a
    temporary one; on a cluster that is an error, since executors do not share their local folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docstrata-")
        atexit.register(shutil.rmtree, base, True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
