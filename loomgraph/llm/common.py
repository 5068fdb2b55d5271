"""What the operators share: applying a function to runs of texts, the cluster's shared folder, table access."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb


#: rows of a few numbers that may be broadcast (24 MB)
FEW = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of an Arrow batch between the JVM and Python
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, where the session has Spark's defaults: 10,000 rows of long texts would take hundreds
    of MB of the JVM's direct memory and of Python's."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(BATCH))


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that other columns, whatever their names, neither travel nor clash."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def columns(ids: pa.Array, arrays: dict[str, np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    made = [ids.cast(schema.field(0).type)]
    for f in list(schema)[1:]:
        x = arrays[f.name]
        made.append(x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def map_runs(df: DataFrame, id_col: str, text_col: str, fn: Callable[[tb.Run], dict], fields: list[tuple[str, T.DataType]], max_bytes: int = 1 << 20) -> DataFrame:
    """Apply fn to runs of texts; it gives a column for each of fields, a row for each document.

    The id column keeps its name and type and comes first.
    """
    small = two(df, id_col, text_col)
    out = T.StructType([T.StructField(id_col, small.schema["id"].dataType), *(T.StructField(n, t) for n, t in fields)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            for run in tb.runs(b.column(1), max_bytes):
                yield columns(b.column(0).slice(run.first, run.n), fn(run), schema)
        tb.release()

    return small.mapInArrow(apply, out)


def shared(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; set to a local one where it's unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_kept: list[list[str]] = []


def collected(spark: SparkSession) -> None:
    """Shuffles that nothing refers to any more are deleted when the driver collects its garbage; else they pile up."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """The tables that are written within are deleted at its end; what an outer one wrote stays."""
    _kept.append([])
    try:
        yield
    finally:
        for p in _kept.pop():
            _delete(spark, p)
        collected(spark)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that were written and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame that make gives, written; the tables that it wrote on the way are deleted."""
    with temporary(spark):
        return written(make(), name, _kept[-2] if len(_kept) > 1 else [])


def written(df: DataFrame, name: str = "t", paths: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    if paths is None and _kept:
        paths = _kept[-1]
    if paths is not None:
        paths.append(path)
    collected(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def map_rows(df: DataFrame, fn: Callable, out: T.StructType) -> DataFrame:
    """mapInArrow for tables whose column names may hold dots or differ only by case; fn goes by place."""
    small_batches(df.sparkSession)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(fn, out)


def keep_runs(df: DataFrame, text_col: str, fn: Callable[[tb.Run], np.ndarray], max_bytes: int = 1 << 18) -> DataFrame:
    """The rows of df, with all columns, whose flag in what fn gives for a run of texts is set."""
    at, schema = df.columns.index(text_col), df.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = to_arrow_schema(schema).names
        for b in batches:
            texts = b.column(at)
            if not tb.as_text(texts.type):
                texts = texts.cast(pa.string())
            kept = [fn(run) for run in tb.runs(texts, max_bytes)]
            if kept:
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(np.concatenate(kept))).columns, names=names)
        tb.release()

    return map_rows(df, apply, schema)


def text_buckets(df: DataFrame, text_col: str, bytes_each: int) -> int:
    """How many buckets of about so many bytes of text a table needs; 1 at least."""
    total = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, -(-total // bytes_each))


def checked(keys: DataFrame) -> DataFrame:
    """Keys to be joined: broadcast if they are counted to be FEW at most, by a shuffle beyond."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        taken.add(n)
        out.append(n)
    return out


def crc_mod(id_col, mod: int):
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(mod)
