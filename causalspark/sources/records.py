"""Raw records to normalized events and logs, with a dead-letter frame for the bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalspark import schemas
from causalspark.functions import classify as K
from causalspark.functions.scalar import blank_to_null, joined
from causalspark.sources.topics import tenant_column


def event_time(*texts: Column) -> Column:
    """First timestamp text that parses, in epoch microseconds."""
    return F.unix_micros(F.coalesce(*[F.try_to_timestamp(blank_to_null(t)) for t in texts]))


def normalize_events(raw: DataFrame, default_tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ok, dead letters) from cluster event records (key, value, timestamp)."""
    v = raw.withColumn("v", F.from_json("value", schemas.CLUSTER_EVENT))
    t = event_time(F.col("v.eventTime"), F.col("v.lastTimestamp"), F.col("v.firstTimestamp"),
                   F.col("v.metadata.creationTimestamp"))
    error = (F.when(F.col("v").isNull() | F.col("v.metadata").isNull(), "malformed record")
             .when(t.isNull(), "bad timestamp"))
    rows = v.withColumn("t", t).withColumn("error", error)
    reason = F.coalesce(blank_to_null(F.trim("v.reason")), F.lit("Unknown"))
    ns = F.coalesce("v.involvedObject.namespace", F.lit(""))
    name = F.coalesce("v.involvedObject.name", F.lit(""))
    fallback = F.sha1(F.concat_ws("|", F.col("t").cast("string"), F.lit("k8s.event"),
                                  F.concat_ws("/", ns, name), reason))
    ok = rows.where("error IS NULL").select(
        F.coalesce(blank_to_null(F.col("v.metadata.uid")), blank_to_null(F.col("key")), fallback).alias("eid"),
        tenant_column(F.col("v.client_id"), F.col("key"), default_tenant).alias("client_id"),
        "t", F.lit("k8s.event").alias("etype"), K.normalized_severity(F.col("v.type")).alias("severity"),
        reason.alias("reason"), K.abstract_type(reason).alias("abstract_type"),
        F.col("v.message").alias("message"),
        F.coalesce(blank_to_null(F.col("v.involvedObject.kind")), F.lit("Unknown")).alias("s_kind"),
        F.col("v.involvedObject.uid").alias("s_uid"), ns.alias("s_ns"), name.alias("s_name"),
        K.service_of(F.col("v.involvedObject.labels")).alias("service"),
        F.col("v.source.host").alias("node"))
    dead = rows.where("error IS NOT NULL").select(
        F.col("value").alias("original"), "error", F.col("timestamp").alias("at"))
    return ok, dead


def unwrap(message: Column) -> Column:
    """Take the inner ``message`` (or ``log``) of a JSON line, up to two levels deep."""
    def once(text):
        inner = F.from_json(text, "message STRING, log STRING")
        found = F.coalesce(inner["message"], inner["log"])
        return F.when(F.startswith(F.ltrim(text), F.lit("{")) & found.isNotNull(), found).otherwise(text)
    return once(once(message))


def field(fields: Column, name: str) -> Column:
    """A merged field as text; null if it is not there or null. Objects and lists come as their JSON."""
    value = F.try_element_at(fields, F.lit(name))
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.when(~F.is_variant_null(value), F.to_json(value)))


def merge_record(raw: DataFrame, message: Column | None = None) -> DataFrame:
    """Log records with ``line``, the innermost text, and ``fields``, what else the JSON around it holds.

    ``fields`` is map<string, variant>, so values keep their types: the fields of a JSON line and of a JSON text inside
    it, up to two levels. The text that was followed (``message``, else ``log``) is left out; of equal names the inner one
    stays. It is null, and the line is the text, for a text that is no JSON object or repeats a name in one.

    Each step is a column of its own, so that a line is parsed once a level.
    """
    def opened(text):
        # only lines that look like an object are parsed
        value = F.when(F.startswith(F.ltrim(text), F.lit("{")), F.try_parse_json(text))
        return F.try_variant_get(value, "$", "map<string,variant>")

    def others(fields, message, log):
        followed = F.when(F.col(message).isNotNull(), "message").when(F.col(log).isNotNull(), "log").otherwise("")
        return F.map_filter(fields, lambda name, _: name != followed)

    def open_level(rows, text, level):
        rows = rows.withColumn(f"__o{level}", opened(F.col(text)))
        both = [field(F.col(f"__o{level}"), n).alias(f"__{n}{level}") for n in ("message", "log")]
        return rows.select("*", *both).withColumn(f"__t{level}", F.coalesce(f"__message{level}", f"__log{level}"))
    rows = raw.withColumn("__t0", F.coalesce("message", "log", F.lit("")) if message is None else message)
    rows = open_level(open_level(rows, "__t0", 1), "__t1", 2)
    outer, inner = others(F.col("__o1"), "__message1", "__log1"), others(F.col("__o2"), "__message2", "__log2")
    rows = rows.withColumns({"__a": outer, "__b": inner})
    kept = F.map_filter("__a", lambda name, _: ~F.map_contains_key("__o2", name))
    fields = F.when(F.col("__o2").isNull(), F.col("__a")).otherwise(F.map_concat(kept, F.col("__b")))
    own = [c for c in raw.columns if c not in ("line", "fields")]
    return rows.select(*own, F.coalesce("__t2", "__t1", "__t0").alias("line"), fields.alias("fields"))


def normalize_logs(raw: DataFrame) -> DataFrame:
    """Log records (columns of the LOG schema plus ``key`` and ``t``) to normalized rows.

    A level or severity inside the JSON of the line counts before that of the record.
    """
    rows = merge_record(raw).withColumn("low", F.lower("line"))
    given = lambda name: F.coalesce(field(F.col("fields"), name), F.col(name))
    rows = rows.withColumn("severity", K.log_severity(F.col("line"), given("level"), given("severity"), F.col("low")))
    rows = rows.withColumn("reason", K.log_reason(F.col("severity"), F.col("low")))
    eid = F.sha1(joined("|", "key", "t", "reason", F.substring("line", 1, 64)))
    return rows.select(
        eid.alias("eid"), "client_id", "t", F.lit("k8s.log").alias("etype"),
        "severity", "reason", F.substring("line", 1, 1000).alias("message"),
        K.high_signal_category(F.col("severity"), F.col("low")).alias("category"),
        F.lit("Pod").alias("s_kind"),
        F.coalesce(blank_to_null(F.col("pod_uid")), blank_to_null(F.col("kubernetes.pod_uid"))).alias("s_uid"),
        F.col("pod_namespace").alias("s_ns"), F.col("pod_name").alias("s_name"))


def high_signal(logs: DataFrame) -> DataFrame:
    return logs.where("category IS NOT NULL")
