"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causalspark.session import shared_folder

#: Bytes of input that one call of a batch function holds at a time (a batch of long texts is cut to that).
SLICE_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def text_key(name: str = "text") -> Column:
    """64-bit hash of a text. With the doc_id it names a row; rows equal in both get equal results."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def or_least(name: str) -> Column:
    """An id as a plain join key: null becomes the smallest number."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(-(1 << 63)))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, so that long texts do not pile up as Python objects."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over columns as Python lists.

    ``make()`` runs once per task and returns a function from the list of input columns to the list of output columns.
    """
    schema = df.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        step = make()
        for batch in slices(batches):
            out = step([column.to_pylist() for column in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def one_of_equal(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each value of ``keys``, the first in ``order``."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder as it is partitioned, and read back; Catalyst then knows its size from the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
