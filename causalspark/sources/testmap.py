"""Adapter from the star-schema sample tables to the engine's tables.

The same expressions are kept as SQL text, so that a second engine can evaluate them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalspark.session import use_utc

REASONS = {
    "error": ["OOMKilled", "Failed", "BackOff", "Error"],
    "purchase": ["Unhealthy", "FailedScheduling", "FailedMount", "ImagePullBackOff"],
    "signup": ["Evicted", "Killing", "CrashLoopBackOff", "NodeNotReady"],
    "click": ["Pulled", "Created", "Started", "Scheduled"],
    "view": ["LOG_INFO", "LOG_WARNING", "LOG_ERROR", "LOG_OOM_KILLED"],
}
PHRASES = [
    "connection refused", "database deadlock detected", "container exit code 137",
    "liveness probe failed", "volume attach failed", "api service slow",
    "out of memory", "request timeout",
]


def _case(subject: str, values: list[str]) -> str:
    branches = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {subject} {branches} END"


TENANT = "'tenant-' || CAST(u % 3 AS STRING)"
NAMESPACE = "'ns-' || CAST(u % 5 AS STRING)"
ETYPE = _case("k % 3", ["k8s.event", "k8s.log", "prom.alert"])
REASON = "CASE event_type " + " ".join(
    f"WHEN '{kind}' THEN {_case('k % 4', names)}" for kind, names in REASONS.items()) + " END"
SEVERITY = (
    "CASE WHEN event_type = 'error' THEN CASE WHEN value > 100 THEN 'FATAL' ELSE 'ERROR' END "
    "WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END "
    "WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END")
MESSAGE = f"reason || ' on pod-' || CAST(u AS STRING) || ': ' || {_case('k % 8', PHRASES)}"
SUBJECT_KIND = ("CASE WHEN reason = 'NodeNotReady' THEN 'Node' "
                "WHEN etype = 'prom.alert' AND k % 5 = 0 THEN 'Service' ELSE 'Pod' END")
SUBJECT_NS = "CASE WHEN s_kind = 'Node' THEN '' ELSE ns END"
SUBJECT_NAME = ("CASE s_kind WHEN 'Node' THEN node WHEN 'Service' THEN service "
                "ELSE 'pod-' || CAST(u AS STRING) END")
RID = "lower(s_kind) || ':' || s_ns || ':' || s_name"
PHASE = "CASE u % 7 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Pending' WHEN 2 THEN 'CrashLoopBackOff' ELSE 'Running' END"


class Sample:
    """Engine tables over one sample directory; every table is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, directory: str):
        use_utc(spark)
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def _events(self) -> DataFrame:
        ev = self.raw("events").select(
            "event_id", F.col("user_id").alias("u"), "event_type", "value",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
            F.get_json_object("props", "$.k").cast("int").alias("k"))
        users = self.raw("customer").select(
            F.col("c_custkey").alias("u"),
            F.expr("'node-' || CAST(c_nationkey AS STRING)").alias("node"),
            F.expr("'svc-' || lower(c_mktsegment)").alias("service"))
        return ev.join(users, "u")

    @property
    def episodes(self) -> DataFrame:
        """Events with subject and resource id (the ABOUT edge is the ``rid`` column)."""
        df = self._events()
        for name, text in [("client_id", TENANT), ("ns", NAMESPACE), ("etype", ETYPE),
                           ("reason", REASON), ("severity", SEVERITY), ("message", MESSAGE),
                           ("s_kind", SUBJECT_KIND), ("s_ns", SUBJECT_NS),
                           ("s_name", SUBJECT_NAME), ("rid", RID)]:
            df = df.withColumn(name, F.expr(text))
        return df.select(
            "client_id", F.expr("'evt-' || CAST(event_id AS STRING)").alias("eid"),
            F.timestamp_micros("t").alias("event_time"), "t", "etype", "severity", "reason",
            "message", "s_kind", "s_ns", "s_name", "rid", "service", "node", "value")

    @property
    def pods(self) -> DataFrame:
        seen = self.raw("events").select(F.col("user_id").alias("u")).distinct()
        users = self.raw("customer").select(
            F.col("c_custkey").alias("u"), "c_mktsegment", "c_nationkey")
        return seen.join(users, "u").select(
            "u", F.expr(TENANT).alias("client_id"), F.expr(NAMESPACE).alias("ns"),
            F.expr("'pod-' || CAST(u AS STRING)").alias("name"),
            F.expr("'node-' || CAST(c_nationkey AS STRING)").alias("node"),
            F.expr("lower(c_mktsegment)").alias("app"),
            F.expr("'team-' || CAST(u % 4 AS STRING)").alias("team"),
            F.expr("'rs-' || CAST(u % 30 AS STRING)").alias("rs"),
            F.expr("'deploy-' || CAST(u % 15 AS STRING)").alias("deploy"),
            F.expr(PHASE).alias("phase"))

    @property
    def resources(self) -> DataFrame:
        p = self.pods
        pod = p.select("client_id", F.lit("Pod").alias("kind"), "ns", "name", "node", "app",
                       "team", "phase", F.expr("'ReplicaSet/' || rs").alias("owner"))

        def derived(kind, ns, name, app="''", team="''", owner="''"):
            return p.select("client_id", F.lit(kind).alias("kind"), F.expr(ns).alias("ns"),
                            F.expr(name).alias("name"), F.lit("").alias("node"),
                            F.expr(app).alias("app"), F.expr(team).alias("team"),
                            F.lit("Active").alias("phase"), F.expr(owner).alias("owner")
                            ).distinct()

        frames = [derived("Node", "''", "node"),
                  derived("Service", "ns", "'svc-' || app", app="app"),
                  derived("ReplicaSet", "ns", "rs", owner="'Deployment/' || deploy"),
                  derived("Deployment", "ns", "deploy")]
        out = pod
        for frame in frames:
            out = out.unionByName(frame)
        return out.withColumn(
            "rid", F.expr("lower(kind) || ':' || ns || ':' || name"))

    @property
    def edges(self) -> DataFrame:
        p = self.pods

        def part(kind, src, dst):
            return p.select("client_id", F.expr(src).alias("src"), F.expr(dst).alias("dst"),
                            F.lit(kind).alias("type"))

        out = (part("RUNS_ON", "'pod:' || ns || ':' || name", "'node::' || node")
               .unionByName(part("SELECTS", "'service:' || ns || ':svc-' || app",
                                 "'pod:' || ns || ':' || name"))
               .unionByName(part("CONTROLS", "'replicaset:' || ns || ':' || rs",
                                 "'pod:' || ns || ':' || name"))
               .unionByName(part("CONTROLS", "'deployment:' || ns || ':' || deploy",
                                 "'replicaset:' || ns || ':' || rs").distinct()))
        return out.withColumn("id", F.expr("'edge:' || src || '->' || dst"))

    @property
    def service_flows(self) -> DataFrame:
        """Service dependencies: every part flow of each supplier, in the tenant of the ordering customer."""
        orders = self.raw("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS u")
        return (self.raw("lineitem").join(orders, "l_orderkey").selectExpr(
            f"{TENANT} AS client_id", "'svc-' || CAST(l_suppkey AS STRING) AS src",
            "'svc-' || CAST(l_partkey % 100 AS STRING) AS dst").where("src <> dst").distinct())

    @property
    def resource_changes(self) -> DataFrame:
        """Orders read as a keyed change log: the customer is the resource."""
        return self.raw("orders").selectExpr(
            "o_custkey AS u", "o_orderkey AS offset",
            "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS at",
            "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'DELETE' ELSE 'UPSERT' END AS op",
            "o_orderpriority AS image", "o_orderstatus AS phase").selectExpr(
            f"{TENANT} AS client_id", f"'pod:' || {NAMESPACE} || ':pod-' || CAST(u AS STRING) AS rid",
            "at", "offset", "op", "image", "phase")

    @property
    def edge_changes(self) -> DataFrame:
        """Line items read as a keyed edge log: supplier to customer of the order."""
        orders = self.raw("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS u")
        return self.raw("lineitem").join(orders, "l_orderkey").selectExpr(
            f"{TENANT} AS client_id", "'service:' || 'shop' || ':svc-' || CAST(l_suppkey AS STRING) AS src",
            f"'pod:' || {NAMESPACE} || ':pod-' || CAST(u AS STRING) AS dst",
            "unix_micros(CAST(l_shipdate AS TIMESTAMP)) AS at",
            "l_orderkey * 10 + l_linenumber AS offset", "'SELECTS' AS type",
            "CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'UPSERT' END AS op",
        ).withColumn("id", F.expr("'edge:' || src || '->' || dst"))
