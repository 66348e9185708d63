"""JSON export and snapshot writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(rows: DataFrame, *id_columns: str) -> DataFrame:
    """One JSON document per row, with its id."""
    return rows.select(F.concat_ws("::", *id_columns).alias("doc_id"),
                       F.to_json(F.struct(*rows.columns)).alias("doc"))


def write_documents(rows: DataFrame, path: str, *id_columns: str) -> None:
    json_documents(rows, *id_columns).select("doc").write.mode("overwrite").text(path)


def write_snapshot(rows: DataFrame, path: str, date_column: str = "t") -> None:
    """Event tables are laid out by day, so that time filters prune whole folders."""
    day = F.to_date(F.timestamp_micros(date_column))
    rows.withColumn("day", day).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)
