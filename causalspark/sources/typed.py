"""State topics as change rows: resources, edges, scrape targets and rules.

A record has a key ``tenant::raw`` (or ``tenant|raw``) and a JSON value; a null or empty value is a tombstone. The tenant is the
payload's, else the key's, else the default. Times are the payload's ``at``, else the record's. Every row has op (UPSERT or
DELETE, whatever the case in the payload), at (microseconds) and offset, as the merges of ``operators.state`` take them.

Defined cases: a value that is no JSON object of the topic's fields is left out here and returned by :func:`malformed`; a
delete is known by its key, as it may have no payload; unknown payload fields are ignored. Rules are not deleted: a
tombstone or DELETE of a rule is no change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causalspark import schemas
from causalspark.functions.scalar import blank_to_null, resource_id, safe_relation, split_tenant_key
from causalspark.sources.topics import only_tenant, tenant_column

BAD = "_bad"


def _read(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Records with tenant, raw key, ``dead`` (no value) and the payload ``v``; its ``_bad`` is the text of what is malformed."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    dead = blank_to_null(F.trim("value")).isNull()
    return records.select("*", dead.alias("dead"), F.from_json("value", full, {"columnNameOfCorruptRecord": BAD}).alias("v")).withColumn(
        "raw", F.coalesce(split_tenant_key(F.col("key"))[1], F.lit("")))


def malformed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """(key, value, topic, timestamp, offset) of values that cannot be read."""
    return _read(records, schema).where(f"NOT dead AND v.{BAD} IS NOT NULL").select(*schemas.TOPIC.fieldNames())


def _changes(records: DataFrame, schema: T.StructType, default: str | None, client_id: str | None) -> DataFrame:
    rows = _read(records, schema).where(f"dead OR v.{BAD} IS NULL")
    gone = F.col("dead") | F.coalesce(F.upper("v.op") == "DELETE", F.lit(False))
    at = F.coalesce(F.unix_micros(F.col("v.at").try_cast("timestamp")), F.col("timestamp"))
    return only_tenant(rows.withColumns({
        "client_id": tenant_column(F.col("v.client_id"), F.col("key"), default),
        "op": F.when(gone, "DELETE").otherwise("UPSERT"), "at": at}), client_id)


COMMON = ["client_id", "op", "at", "offset"]


def key_resource_id(raw: Column) -> Column:
    """``Kind:rest`` with the kind in lower case; any other key wholly in lower case."""
    kind = F.regexp_extract(raw, r"^([A-Za-z]+):(?s:.+)$", 1)
    return F.when(kind != "", F.concat(F.lower(kind), F.substr(raw, F.length(kind) + 1))).otherwise(F.lower(raw))


def resource_changes(records: DataFrame, default: str | None = None, client_id: str | None = None) -> DataFrame:
    """state.k8s.resource; a delete has null properties."""
    rows = _changes(records, schemas.RESOURCE_CHANGE, default, client_id)
    v = lambda name: F.col(f"v.{name}")
    rid = F.when(F.col("op") == "DELETE", key_resource_id(F.col("raw"))).otherwise(resource_id(v("kind"), v("uid"), v("namespace"), v("name")))
    return rows.select(*COMMON, rid.alias("rid"), v("kind").alias("kind"), v("uid").alias("uid"), F.coalesce(v("namespace"), F.lit("")).alias("ns"),
                       v("name").alias("name"), v("labels").alias("labels"), v("node").alias("node"), v("image").alias("image"), v("replicas").alias("replicas"))


def edge_changes(records: DataFrame, default: str | None = None, client_id: str | None = None) -> DataFrame:
    """state.k8s.topology; the id is the payload's, else the key's."""
    rows = _changes(records, schemas.EDGE_CHANGE, default, client_id)
    name = F.coalesce(blank_to_null(F.col("v.id")), F.col("raw"))
    return rows.select(*COMMON, name.alias("id"), F.lower("v.from").alias("src"), F.lower("v.to").alias("dst"),
                       F.when(F.col("op") == "UPSERT", safe_relation(F.coalesce("v.type", F.lit("")))).alias("type"))


def target_changes(records: DataFrame, default: str | None = None, client_id: str | None = None) -> DataFrame:
    """state.prom.targets; without a key the id is made of cluster and labels. The service falls back to the job."""
    rows = _changes(records, schemas.TARGET_CHANGE, default, client_id)
    label = lambda name: F.try_element_at("v.labels", F.lit(name))
    parts = [F.coalesce(p, F.lit("")) for p in (F.col("v.cluster"), label("job"), label("namespace"), label("service"), label("instance"))]
    return rows.select(*COMMON, F.coalesce(blank_to_null(F.col("raw")), F.concat_ws("|", *parts)).alias("target_id"),
                       label("namespace").alias("ns"), F.coalesce(blank_to_null(label("service")), label("job")).alias("service"), label("pod").alias("pod"),
                       F.col("v.scrapeUrl").alias("scrape_url"), F.upper("v.health").alias("health"), F.col("v.lastError").alias("last_error"))


def rule_changes(records: DataFrame, default: str | None = None, client_id: str | None = None) -> DataFrame:
    """state.prom.rules; without a key the id is ``group|rule``."""
    rows = _changes(records, schemas.RULE_CHANGE, default, client_id).where("op = 'UPSERT'")
    label = lambda name: F.try_element_at("v.labels", F.lit(name))
    made = F.concat(F.coalesce("v.group", F.lit("")), F.lit("|"), F.coalesce("v.rule", F.lit("")))
    return rows.select(*COMMON, F.coalesce(blank_to_null(F.col("raw")), made).alias("rule_key"), F.col("v.rule").alias("rule"), F.col("v.group").alias("group"),
                       F.lower("v.type").alias("type"), F.col("v.expr").alias("expr"), label("namespace").alias("ns"), label("service").alias("service"))
