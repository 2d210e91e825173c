"""Cutting long lineages, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is named, as in tests, one of our own."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = f"file://{tempfile.gettempdir()}/tidebar-checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` worked out once: steps that read it several times don't repeat what is below, and lost executors don't lose it."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
