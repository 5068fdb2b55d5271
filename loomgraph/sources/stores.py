"""Graph and vector tables in a folder, by connection string; the first factory that accepts one makes the store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class ParquetStore:
    """Tables partitioned by tenant; reading one prunes to the tenant's files."""

    path: str
    tenant: str = "default_"
    read_only: bool = False

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}").where(F.col("tenant") == self.tenant).drop("tenant")

    def append(self, df: DataFrame, name: str) -> None:
        self._writable()
        df.withColumn("tenant", F.lit(self.tenant)).write.mode("append").partitionBy("tenant").parquet(f"{self.path}/{name}")

    def upsert(self, df: DataFrame, name: str, key: str) -> None:
        """Rows of df replace those with their keys; a new version of the tenant's folder is written, then put in place."""
        self._writable()
        spark = df.sparkSession
        try:
            old = self.read(spark, name).join(df.select(key), key, "left_anti")
            merged = old.unionByName(df, allowMissingColumns=True)
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            merged = df
        merged.withColumn("tenant", F.lit(self.tenant)).write.mode("overwrite").partitionBy("tenant").parquet(f"{self.path}/_{name}")
        done = spark.read.parquet(f"{self.path}/_{name}")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").parquet(f"{self.path}/{name}")

    def tenants(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}").select("tenant").distinct()

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")


class DummyStore:
    """Accepts writes and has no rows."""

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame([], T.StructType([]))

    def append(self, df: DataFrame, name: str) -> None: ...

    def upsert(self, df: DataFrame, name: str, key: str) -> None: ...


FACTORIES: list[Callable[[str], object | None]] = [
    lambda s: DummyStore() if s in ("", "dummy://") else None,
    lambda s: ParquetStore(s.removeprefix("parquet://")) if s.startswith(("parquet://", "/", "file:", "s3a:", "hdfs:")) else None,
]


def register(factory: Callable[[str], object | None]) -> None:
    FACTORIES.insert(0, factory)


def for_connection(s: str):
    for f in FACTORIES:
        if (store := f(s)) is not None:
            return store
    raise ValueError(f"no store for {s!r}")
