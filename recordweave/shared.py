"""The folder that driver and executors share, and frames kept in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none gets a temporary folder, removed when Python ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="recordweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and kept reliably: lost executors cost no recomputation, and its lineage ends here."""
    folder(df.sparkSession)
    return df.checkpoint()
