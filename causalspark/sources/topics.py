"""Keyed topics: reading, replaying, publishing, tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causalspark import schemas
from causalspark.functions.scalar import DAY_US, MINUTE_US, blank_to_null, split_tenant_key
from causalspark.operators.timejoin import latest, top_per

# Retention in days; None is a compacted topic.
RETENTION_DAYS = {
    "raw.k8s.events": 7, "raw.k8s.logs": 3, "raw.events": 7, "raw.prom.alerts": 7,
    "events.normalized": 7, "logs.normalized": 3, "alerts.raw": 30, "alerts.normalized": 30,
    "state.k8s.resource": None, "state.k8s.topology": None, "state.prom.targets": None,
    "state.prom.rules": None,
}


def read_topic(spark: SparkSession, topic: str, path: str | None = None, servers: str | None = None,
               stream: bool = False) -> DataFrame:
    """(key, value, topic, timestamp, offset) from Kafka, or from JSON files of that shape."""
    reader = spark.readStream if stream else spark.read
    if servers:
        rows = (reader.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("subscribe", topic).load())
        return rows.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic",
                           F.unix_micros("timestamp").alias("timestamp"), "offset")
    return reader.schema(schemas.TOPIC).json(path).where(F.col("topic") == topic)


def parsed(records: DataFrame, schema: StructType) -> DataFrame:
    """Topic records with the JSON value as columns; a null value stays (it is a tombstone)."""
    return records.select("key", "timestamp", "offset", "value",
                          F.from_json("value", schema).alias("v")).select(
        "key", "timestamp", "offset", F.col("value").isNull().alias("tombstone"), "v.*")


def tenant_column(client_id: Column, key: Column, default: str | None = None) -> Column:
    """Payload, then key, then default."""
    choices = [blank_to_null(client_id), split_tenant_key(key)[0]]
    return F.coalesce(*choices, *([F.lit(default)] if default else []))


def only_tenant(rows: DataFrame, client_id: str | None) -> DataFrame:
    return rows.where(F.col("client_id") == client_id) if client_id else rows


def expired(rows: DataFrame, as_of=None) -> DataFrame:
    """Rows of retained topics that are past their retention (needs topic and t)."""
    days = F.create_map(*[F.lit(x) for k, v in RETENTION_DAYS.items() if v for x in (k, v)])
    keep = F.try_element_at(days, F.col("topic")) * F.lit(DAY_US)
    return rows.where(F.col("t") < latest(rows, as_of) - keep)


def bounded_replay(events: DataFrame, minutes: int, namespace: str | None = None,
                   name: str | None = None, limit: int = 1000, as_of=None) -> DataFrame:
    """The latest events of the last minutes, filtered, at most ``limit`` of each tenant."""
    rows = events.where(F.col("t") >= latest(events, as_of) - minutes * MINUTE_US)
    if namespace:
        rows = rows.where(F.col("s_ns") == namespace)
    if name:
        rows = rows.where(F.contains(F.col("s_name"), F.lit(name)))
    return top_per(rows, ["client_id"], [F.desc("t"), "eid"], limit)


def to_records(rows: DataFrame, topic: str, *key: Column) -> DataFrame:
    """Rows as (key, value, topic) with a ``::`` key and a JSON value."""
    return rows.select(F.concat_ws("::", *key).alias("key"),
                       F.to_json(F.struct(*rows.columns)).alias("value"), F.lit(topic).alias("topic"))


def tenants(**frames: DataFrame) -> DataFrame:
    """Tenants seen in each source, with row counts (partial sums before the shuffle)."""
    out = None
    for name, frame in frames.items():
        part = frame.groupBy("client_id").agg(F.count("*").alias("n")).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
