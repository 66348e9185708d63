"""A keyed table that a stream keeps current batch by batch, under versions that readers can pin.

The rows lie in buckets by the hash of their key. A batch reads the buckets it touches, takes the newest change of each
key, and writes just these buckets as a new version; the version's manifest says for every bucket which version holds
it. Nothing that a reader has pinned is ever overwritten by another batch. A batch that is run again starts from the
version before it and writes the same rows, so a retry changes nothing. Deleted keys stay as markers, so that a change
which arrives after its own deletion does not bring the key back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causalspark.operators import state


@dataclass(frozen=True)
class KeyedStore:
    """``schema`` is that of the changes: the keys, ``op``, ``at``, ``offset`` and any other columns."""

    path: str
    keys: tuple[str, ...]
    schema: StructType
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _manifests(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("bucket int, held long, version long").parquet(f"{self.path}/manifest")

    def versions(self, spark: SparkSession) -> list[int]:
        """The versions that are complete."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return []
        return sorted(r.version for r in self._manifests(spark).select("version").distinct().collect())

    def manifest(self, spark: SparkSession, version: int | None) -> dict[int, int]:
        """Bucket to the version that holds it; ``buckets`` rows at most."""
        if version is None:
            return {}
        return {r.bucket: r.held for r in self._manifests(spark).where(F.col("version") == version).collect()}

    def _rows(self, spark: SparkSession, held: dict[int, int]) -> DataFrame:
        """All rows (markers too) of the given buckets."""
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*self.schema.names)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function: applies a batch of changes as version ``batch_id``."""
        spark = batch.sparkSession
        before = [v for v in self.versions(spark) if v < batch_id]
        held = self.manifest(spark, before[-1] if before else None)
        changes = state.latest_rows(batch.select(*self.schema.names), list(self.keys)).select(*self.schema.names).withColumn("bucket", self.bucket())
        touched = {r.bucket for r in changes.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        old = self._rows(spark, {b: v for b, v in held.items() if b in touched}).withColumn("bucket", self.bucket())
        merged = state.latest_rows(old.unionByName(changes), [*self.keys, "bucket"])
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={batch_id}")
        now = held | dict.fromkeys(touched, batch_id)
        rows = spark.createDataFrame(sorted(now.items()), "bucket int, held long").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/version={batch_id}")

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Live rows of a version (the newest complete one, if left out)."""
        known = self.versions(spark)
        version = version if version is not None else known[-1] if known else None
        return self._rows(spark, self.manifest(spark, version)).where(F.coalesce(F.col("op"), F.lit("DELETE")) != "DELETE")
