"""Alert webhooks and scrape targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalspark.functions import classify as K
from causalspark.functions.scalar import blank_to_null


def explode_alerts(webhooks: DataFrame) -> DataFrame:
    """One row per alert; the alert's own labels win over group and common ones."""
    one = webhooks.withColumn("a", F.explode_outer("alerts"))
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce("a.labels", empty)
    common = F.coalesce("commonLabels", empty)
    group = F.coalesce("groupLabels", empty)
    less = lambda m, over: F.map_filter(m, lambda k, v: ~F.map_contains_key(over, k))
    rest = F.map_concat(common, less(group, common))
    labels = F.map_concat(own, less(rest, own))
    notes = F.coalesce("a.annotations", empty)
    notes = F.map_concat(notes, less(F.coalesce("commonAnnotations", empty), notes))
    return one.select("receiver", "groupKey", F.coalesce("a.status", "status").alias("status"),
                      labels.alias("labels"), notes.alias("annotations"),
                      F.col("a.startsAt").alias("starts_at"), F.col("a.endsAt").alias("ends_at"),
                      F.col("a.fingerprint").alias("fingerprint"))


def _label(m: Column, key: str) -> Column:
    return blank_to_null(F.try_element_at(m, F.lit(key)))


def stable_key(first_fingerprint: Column, group_key: Column, labels: Column) -> Column:
    """Fingerprint, then group key, then ``job|namespace|service``."""
    job = F.coalesce(_label(labels, "job"), F.lit("unknown"))
    ns = F.coalesce(_label(labels, "namespace"), F.lit("default"))
    return F.coalesce(blank_to_null(first_fingerprint), blank_to_null(group_key),
                      F.concat_ws("|", job, ns, F.coalesce(_label(labels, "service"), job)))


def alerts_to_events(alerts: DataFrame) -> DataFrame:
    """Alerts (labels, annotations, status) as normalized events."""
    m, notes = F.col("labels"), F.col("annotations")
    pod, svc, dep, node = (_label(m, k) for k in ("pod", "service", "deployment", "node"))
    name = F.coalesce(_label(m, "alertname"), F.lit("UnknownAlert"))
    severity = F.upper(_label(m, "severity"))
    return alerts.select(
        *[c for c in alerts.columns if c not in ("labels", "annotations", "status")],
        F.lit("prom.alert").alias("etype"), name.alias("reason"),
        F.when(severity.isin("CRITICAL", "WARNING", "INFO"), severity).otherwise("WARNING").alias("severity"),
        F.coalesce(_label(notes, "description"), _label(notes, "summary"),
                   F.concat(F.lit("Alert "), name, F.lit(" is "), "status")).alias("message"),
        F.when(pod.isNotNull(), "Pod").when(svc.isNotNull(), "Service")
        .when(dep.isNotNull(), "Deployment").when(node.isNotNull(), "Node").otherwise("Service").alias("s_kind"),
        F.coalesce(_label(m, "namespace"), F.lit("default")).alias("s_ns"),
        F.coalesce(pod, svc, dep, node, F.lit("")).alias("s_name"),
        K.alert_type(name).alias("fault_type"))


def target_changes(previous: DataFrame, current: DataFrame, key: str = "target_id") -> DataFrame:
    """UPSERT for every current target, DELETE for targets that are gone."""
    gone = previous.join(current.select("client_id", key), ["client_id", key], "left_anti")
    return current.withColumn("op", F.lit("UPSERT")).unionByName(
        gone.withColumn("op", F.lit("DELETE")), allowMissingColumns=True)
