"""The folder that all executors share, and tables in it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one where it's unset and the master is local, as in tests."""
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder, or to a given one, and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{path or folder(spark)}/{name}" + ("" if path else f"-{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # digests in half of the bytes
    return spark.read.schema(df.schema).parquet(path)


#: rows of a few ids that may be broadcast (about 20 MB)
FEW = 200_000


def few(df: DataFrame, most: int = FEW, repeats: bool = False) -> DataFrame:
    """Rows of ids, distinct unless they may repeat, written, so that they're made once, and broadcast where they are counted to be at most so many."""
    df = written(df if repeats else df.distinct(), "few")
    return F.broadcast(df) if df.count() <= most else df


def state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of the last change of a file or folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder if it's there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
