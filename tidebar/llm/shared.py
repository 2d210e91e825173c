"""Tables, and places in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import checkpoints
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoints(ship(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place for a table below the shared folder."""
    return f"{checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table written below the shared folder and read again: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``kept`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns, *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column has it (whatever the case of its letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(column: str) -> str:
    """A column's name as text for the parser, dots and all."""
    return "`" + column.replace("`", "``") + "`"
