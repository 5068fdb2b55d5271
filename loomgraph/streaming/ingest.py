"""Incremental ingest: files to graph tables, in micro-batches that may be run again.

A source is keyed by its id, so writing a batch twice changes nothing; versions are derived again from all
starts, so a version that comes late only splits the interval that it falls into.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.operators.versions import insert_versions
from loomgraph.sources.shared import folder, removed
from loomgraph.sources.stores import ParquetStore

NODES = {"source": "source_id", "chunk": "chunk_id", "topic": "topic_id", "statement": "statement_id", "fact": "fact_id", "entity": "entity_id"}
EDGES = ("chunk_links", "topic_chunk", "previous", "supports", "entity_fact", "relation")


def documents(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """A stream of JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def build_batch(store: ParquetStore, extractor: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """Node tables by their ids and edge tables by all of their columns; the batch is extracted once."""

    def run(batch: DataFrame, _: int) -> None:
        g = Graph(batch) if extractor is None else Graph(batch, extractor=extractor)
        path = f"{folder(batch.sparkSession)}/batch-{uuid.uuid4().hex}"
        try:
            g = g.stored(path)
            for name, key in NODES.items():
                store.upsert(getattr(g, name), name, key)
            for name in EDGES:
                edges = getattr(g, name)
                if not edges.isEmpty():
                    store.upsert(edges.withColumn("edge_id", F.concat_ws("|", *edges.columns)), name, "edge_id")
        finally:
            removed(batch.sparkSession, path)

    return run


def version_batch(store: ParquetStore, key: str, name: str = "version") -> Callable[[DataFrame, int], None]:
    """Rows with key and valid_from become versions of key."""

    def run(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key, "valid_from"])
        try:
            old = store.read(batch.sparkSession, name).join(new.select(key, "valid_from"), [key, "valid_from"], "left_anti").drop("version_id")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = insert_versions(new.limit(0).withColumn("valid_to", F.lit(0)), new.limit(0), key)
        rows = insert_versions(old, new, key).withColumn("version_id", F.concat_ws(":", F.col(key).cast("string"), F.col("valid_from").cast("string")))
        store.upsert(rows, name, "version_id")

    return run


def start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Run what is there now; the checkpoint remembers which files were done."""
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
