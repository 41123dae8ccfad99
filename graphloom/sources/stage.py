"""Intermediate tables written once to the folder that driver and executors share, for plans that read them more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder: that of spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-stage-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def staged(rows: DataFrame) -> DataFrame:
    """rows worked out now and kept in the checkpoint folder: lineage ends there, lost executors lose nothing, and no cache is held."""
    checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()
