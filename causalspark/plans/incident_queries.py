"""Named queries for windows, incidents and anomalies (W rows)."""

from pyspark.sql import functions as F

from causalspark.functions.scalar import round_to
from causalspark.operators import incidents as I
from causalspark.plans.engine import INCIDENT_GAP_MIN
from causalspark.plans.registry import query
from causalspark.plans.sqltables import r3

FAIL = "severity IN ('ERROR','FATAL')"


@query("w1_escalate_severity", """SELECT client_id, eid, severity AS severity_raw, n >= 2 AND severity IN ('WARNING','ERROR') AS escalated,
    CASE WHEN n >= 2 AND severity IN ('WARNING','ERROR') THEN n ELSE 0 END AS repeat_count,
    CASE WHEN n >= 2 AND severity = 'WARNING' THEN 'ERROR' WHEN n >= 2 AND severity = 'ERROR' THEN 'FATAL' ELSE severity END AS severity
  FROM (SELECT *, count(*) OVER (PARTITION BY client_id, rid, reason ORDER BY t RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) - 1 AS n FROM episodes)""")
def w1(x):
    return I.escalate_severity(x.episodes, window_min=7 * 1440, threshold=2).select(
        "client_id", "eid", "severity_raw", "escalated", "repeat_count", "severity")


@query("w2_cluster_incidents", f"""SELECT client_id, rid AS resource_id, eid, t - 3600000000 AS window_start, t + 3600000000 AS window_end, n AS event_count, severity
  FROM (SELECT *, count(*) OVER (PARTITION BY client_id, rid ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 3600000000 FOLLOWING) AS n FROM episodes)
  WHERE {FAIL} AND n - 1 >= 2""")
def w2(x):
    return I.cluster_incidents(x.episodes, window_min=60)


@query("w2_cluster_members", f"""SELECT a.client_id, a.eid, b.eid AS member FROM (SELECT * FROM
    (SELECT *, count(*) OVER (PARTITION BY client_id, rid ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 3600000000 FOLLOWING) AS n FROM episodes)
    WHERE {FAIL} AND n - 1 >= 2) a JOIN episodes b ON a.client_id = b.client_id AND a.rid = b.rid AND abs(b.t - a.t) <= 3600000000""")
def w2m(x):
    return I.cluster_members(I.cluster_incidents(x.episodes, 60), x.episodes, 60)


@query("w3_sessionize_incidents", "SELECT incident_id, client_id, resource_id, window_start, window_end, event_count, severity, status FROM incidents")
def w3(x):
    return x.incidents


@query("w3_incident_members", "SELECT incident_id, client_id, eid, reason FROM incident_members")
def w3m(x):
    return x.incident_members.select("incident_id", "client_id", "eid", "reason")


@query("w4_incident_timeline", """SELECT m.client_id, m.incident_id, m.eid, row_number() OVER (PARTITION BY m.client_id, m.incident_id ORDER BY m.t, m.eid) AS step,
    coalesce(r.root_causes, 0) AS root_causes, coalesce(r.best_root, '') AS best_root FROM incident_members m LEFT JOIN (
    SELECT client_id, effect, count(*) AS root_causes, max(row(confidence, cause)).cause AS best_root FROM (
      SELECT l.client_id, l.effect, l.cause, l.confidence FROM links l WHERE NOT EXISTS (SELECT 1 FROM links u WHERE u.client_id = l.client_id AND u.effect = l.cause))
    GROUP BY 1, 2) r ON r.client_id = m.client_id AND r.effect = m.eid""".replace(
    "max(row(confidence, cause)).cause", "max({'a': confidence, 'cause': cause}).cause"))
def w4(x):
    return I.incident_timeline(x.incident_members, x.links).select(
        "client_id", "incident_id", "eid", "step", "root_causes", "best_root")


@query("w4_around_incident", """SELECT i.client_id, i.incident_id, e.eid, e.reason, e.t - i.window_start AS offset_us,
    CASE WHEN e.t < i.window_start THEN 'before' WHEN e.t = i.window_start THEN 'start' ELSE 'after' END AS marker
  FROM incidents i JOIN episodes e ON e.client_id = i.client_id AND abs(e.t - i.window_start) <= 1800000000""")
def w4a(x):
    return I.around_incident(x.episodes, x.incidents)


@query("w5_impactful_incidents", f"""SELECT client_id, incident_id, event_count, duration_minutes, severity, impact_score FROM (
    SELECT *, {r3("CASE severity WHEN 'FATAL' THEN 10 ELSE 5 END * event_count * (duration_minutes / CAST(60.0 AS DOUBLE))")} AS impact_score
    FROM (SELECT *, (window_end - window_start) // 60000000 AS duration_minutes FROM incidents)) QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY impact_score DESC, incident_id) <= 10""")
def w5(x):
    return I.impactful_incidents(x.incidents).select(
        "client_id", "incident_id", "event_count", "duration_minutes", "severity", "impact_score")


@query("w6_error_spike", f"""SELECT client_id, current_errors, {r3('average_errors', 6)} AS average_errors, {r3('spike_ratio', 6)} AS spike_ratio,
    CASE WHEN spike_ratio >= 5 THEN 'critical' ELSE 'high' END AS severity FROM (
    SELECT *, current_errors / CASE WHEN average_errors > 0 THEN average_errors ELSE 1.0 END AS spike_ratio FROM (
      SELECT client_id, count(*) FILTER (t >= now - 3600000000) AS current_errors, count(*) / CAST(24.0 AS DOUBLE) AS average_errors
      FROM episodes, clock WHERE {FAIL} AND t >= now - 86400000000 GROUP BY 1)) WHERE spike_ratio >= 0.5""")
def w6(x):
    return I.error_spike(x.episodes, recent_min=60, ratio=0.5).withColumn(
        "average_errors", round_to(F.col("average_errors"), 6)).withColumn(
        "spike_ratio", round_to(F.col("spike_ratio"), 6))


@query("w6_error_spike_series", f"""SELECT client_id, slot, errors, {r3('errors / avg', 6)} AS spike_ratio FROM (
    SELECT *, sum(errors) OVER (PARTITION BY client_id ORDER BY slot RANGE BETWEEN 95 PRECEDING AND CURRENT ROW) / CAST(96.0 AS DOUBLE) AS avg FROM (
      SELECT client_id, t // 900000000 AS slot, count(*) AS errors FROM episodes WHERE {FAIL} GROUP BY 1, 2)) WHERE errors / avg >= 3""")
def w6s(x):
    return I.error_spike_series(x.episodes).drop("average_errors").withColumn(
        "spike_ratio", round_to(F.col("spike_ratio"), 6))


@query("w7_rate_anomalies", f"""SELECT client_id, slot, severity AS what, n, 'error_spike' AS anomaly FROM (SELECT client_id, t // 86400000000 AS slot, severity, count(*) AS n FROM episodes WHERE {FAIL} GROUP BY 1, 2, 3) WHERE n / 1440.0 > 0.01
  UNION ALL SELECT client_id, slot, reason, n, 'cascading_failure' FROM (SELECT client_id, t // 86400000000 AS slot, reason, count(*) AS n FROM episodes WHERE {FAIL} GROUP BY 1, 2, 3) WHERE n > 5
  UNION ALL SELECT client_id, slot, reason, n, 'memory_leak' FROM (SELECT client_id, t // 86400000000 AS slot, reason, count(*) AS n FROM episodes WHERE {FAIL} GROUP BY 1, 2, 3) WHERE n > 3 AND reason IN ('OOMKilled','LOG_OOM_KILLED')""")
def w7(x):
    return I.rate_anomalies(x.episodes, window_min=1440, per_minute=0.01, same_reason=5)


@query("w8_operation_churn", """SELECT client_id, kind, slot, operations FROM (SELECT client_id, 'pod' AS kind, at_us // 604800000000 AS slot, count(*) AS operations
    FROM resource_changes GROUP BY 1, 2, 3) WHERE operations > 10""")
def w8(x):
    changes = x.resource_changes.select("client_id", F.split("rid", ":")[0].alias("kind"),
                                        F.col("at").alias("t"))
    return I.operation_churn(changes, window_min=7 * 1440, limit=10)


@query("w8_churn_ratio", f"""SELECT client_id, kind, ns, resource_count, state_changes, {r3('state_changes / CAST(resource_count AS DOUBLE)', 6)} AS churn_ratio FROM (
    SELECT client_id, kind, ns, count(*) AS resource_count FROM resources WHERE kind IN ('Pod','Service') GROUP BY 1, 2, 3) JOIN (
    SELECT client_id, s_kind AS kind, s_ns AS ns, count(*) AS state_changes FROM episodes, clock WHERE reason IN ('Created','Deleted','FailedScheduling') AND t >= now - 2592000000000 GROUP BY 1, 2, 3)
  USING (client_id, kind, ns) WHERE state_changes > resource_count * 3""")
def w8r(x):
    return I.churn_ratio(x.episodes, x.resources, hours=720).withColumn(
        "churn_ratio", round_to(F.col("churn_ratio"), 6))


@query("w9_memory_leaks", """SELECT client_id, rid, oom_count, first_interval_min, last_interval_min, last_interval_min < first_interval_min AS is_accelerating FROM (
    SELECT client_id, rid, count(*) AS oom_count, (list(t ORDER BY t)[2] - list(t ORDER BY t)[1]) // 60000000 AS first_interval_min,
      (list(t ORDER BY t)[-1] - list(t ORDER BY t)[-2]) // 60000000 AS last_interval_min
    FROM episodes, clock WHERE reason IN ('OOMKilled','LOG_OOM_KILLED') AND t >= now - 2592000000000 GROUP BY 1, 2 HAVING count(*) >= 3)""")
def w9(x):
    return I.memory_leaks(x.episodes, hours=720)


@query("w10_cascading_failures", f"""SELECT client_id, rid, error_count, related_errors FROM (
    SELECT a.client_id, a.rid, any_value(a.n) AS error_count, CAST(sum(b.n) AS BIGINT) AS related_errors FROM cnt a JOIN near ON near.client_id = a.client_id AND near.a = a.rid AND hops <= 2
    JOIN cnt b ON b.client_id = a.client_id AND b.rid = near.b WHERE a.n >= 5 GROUP BY 1, 2) WHERE related_errors >= 3""",
       {"cnt": f"SELECT client_id, rid, count(*) AS n FROM episodes, clock WHERE {FAIL} AND t >= now - 604800000000 GROUP BY 1, 2"})
def w10(x):
    return I.cascading_failures(x.episodes, x.edges, window_min=7 * 1440)


@query("w11_anomaly_report", f"""SELECT client_id, severity AS item, {r3('max(n) / CAST(1440.0 AS DOUBLE)', 6)} AS peak, 'events_per_minute' AS metric FROM (SELECT client_id, severity, t // 86400000000, count(*) AS n FROM episodes GROUP BY 1, 2, 3) GROUP BY 1, 2
  UNION ALL SELECT client_id, reason, CAST(max(n) AS DOUBLE), 'error_pattern' FROM (SELECT client_id, reason, t // 86400000000, count(*) AS n FROM episodes WHERE {FAIL} GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def w11(x):
    return I.anomaly_report(x.episodes, window_min=1440).withColumn(
        "peak", round_to(F.col("peak"), 6))


ALERT_ROWS = """SELECT * FROM episodes WHERE etype = 'prom.alert'
    UNION ALL SELECT * FROM episodes WHERE etype = 'prom.alert' AND severity IN ('ERROR','FATAL')"""
FINGERPRINT = """array_to_string([CASE WHEN reason IS NULL OR reason = '' THEN 'unknown' ELSE lower(reason) END, CASE WHEN severity IS NULL OR severity = '' THEN 'unknown' ELSE lower(severity) END,
    lower(ifnull(s_kind, '')), lower(ifnull(s_ns, '')), lower(left(ifnull(message, ''), 50))], '::')"""
GROUPED = {
    "alert_rows": ALERT_ROWS,
    "a1": f"SELECT *, {FINGERPRINT} AS fingerprint, row_number() OVER (PARTITION BY client_id, {FINGERPRINT}, eid ORDER BY t) AS copy FROM alert_rows",
    "a2": "SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client_id, fingerprint ORDER BY t, eid) <= 259200000000 THEN 0 ELSE 1 END AS new FROM a1 WHERE copy = 1",
    "a3": "SELECT *, sum(new) OVER (PARTITION BY client_id, fingerprint ORDER BY t, eid ROWS UNBOUNDED PRECEDING) AS g FROM a2",
    "a4": "SELECT *, row_number() OVER (PARTITION BY client_id, fingerprint, g ORDER BY t, eid) - 1 AS pos, min(t) OVER (PARTITION BY client_id, fingerprint, g) AS island FROM a3",
    "a5": "SELECT *, substr(md5(client_id || '|' || fingerprint || '|' || CAST(island AS STRING) || '|' || CAST(pos // 2 AS STRING)), 1, 16) AS group_id, CASE WHEN pos % 2 = 0 THEN 'new' ELSE 'grouped' END AS action FROM a4",
    "grouped_alerts": """SELECT client_id, fingerprint, eid, t, rid, reason, severity, group_id, action FROM a5 UNION ALL
      SELECT a1.client_id, a1.fingerprint, a1.eid, a1.t, a1.rid, a1.reason, a1.severity, a5.group_id, 'duplicate' FROM a1 JOIN a5 USING (client_id, fingerprint, eid) WHERE a1.copy > 1""",
}


def _grouped(x):
    alerts = x.episodes.where("etype = 'prom.alert'")
    delivered = alerts.unionByName(alerts.where(F.col("severity").isin("ERROR", "FATAL")))
    return I.group_alerts(delivered, gap_min=3 * 1440, max_size=2)


@query("w12_group_alerts", "SELECT client_id, fingerprint, eid, group_id, action FROM grouped_alerts", GROUPED)
def w12(x):
    return _grouped(x).select("client_id", "fingerprint", "eid", "group_id", "action")


@query("w13_alert_group_summary", """SELECT client_id, group_id, fingerprint, reason, severity, min(t) AS first_seen, max(t) AS last_seen, count(*) AS alerts,
    count(DISTINCT rid) AS affected_resources FROM grouped_alerts WHERE action <> 'duplicate' GROUP BY ALL""", GROUPED)
def w13(x):
    return I.alert_group_summary(_grouped(x))


@query("w13_alert_group_stats", f"""SELECT client_id, count(*) AS received, count(*) FILTER (action <> 'duplicate') AS accepted, count(*) FILTER (action = 'new') AS groups,
    {r3("(1.0 - count(*) FILTER (action = 'new') / CAST(count(*) AS DOUBLE)) * 100.0", 2)} AS dedup_rate FROM grouped_alerts GROUP BY 1""", GROUPED)
def w13s(x):
    return I.alert_group_stats(_grouped(x))


@query("w14_active_incidents", """SELECT e.client_id, e.eid, e.reason, d.blast_radius, coalesce(u.top_cause, '') AS top_cause, coalesce(u.c, 0) AS cause_confidence,
    CASE WHEN blast_radius > 20 OR reason IN ('OOMKilled','CrashLoopBackOff') THEN 'critical' WHEN blast_radius > 10 OR reason IN ('Failed','BackOff') THEN 'high'
      WHEN blast_radius > 5 THEN 'medium' ELSE 'low' END AS severity
  FROM episodes e JOIN clock ON e.t >= now - 2592000000000
  JOIN (SELECT client_id, cause AS eid, count(*) AS blast_radius FROM links GROUP BY 1, 2) d USING (client_id, eid)
  LEFT JOIN (SELECT client_id, effect AS eid, max({'a': confidence, 'cause': cause}).cause AS top_cause, max(confidence) AS c FROM links GROUP BY 1, 2) u USING (client_id, eid)
  WHERE reason IN ('Failed','BackOff','Unhealthy','OOMKilled','Error','CrashLoopBackOff','FailedScheduling')""")
def w14(x):
    return I.active_incidents(x.episodes, x.links, minutes=43200).select(
        "client_id", "eid", "reason", "blast_radius", "top_cause", "cause_confidence", "severity")


@query("w15_alert_batches", """SELECT client_id, 'fault-' || client_id || '-' || CAST(b AS STRING) AS fault_id, eid FROM (
    SELECT *, unnest([n, n + 1, n + 2]) AS b FROM (SELECT client_id, eid, row_number() OVER (PARTITION BY client_id ORDER BY t, eid) AS n,
      count(*) OVER (PARTITION BY client_id) AS total FROM episodes WHERE etype = 'prom.alert')) WHERE b >= 3 AND b <= total""")
def w15(x):
    return I.alert_batches(x.episodes.where("etype = 'prom.alert'")).drop("t")


@query("w16_assign_faults", """SELECT client_id, eid, client_id || '|' || CAST(min(t) OVER (PARTITION BY client_id, g) AS STRING) AS fault_id FROM (
    SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY t, eid ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client_id ORDER BY t, eid) <= 1800000000 THEN 0 ELSE 1 END AS new FROM episodes WHERE severity <> 'INFO'))""")
def w16(x):
    return I.assign_faults(x.episodes.where("severity <> 'INFO'"), ["client_id"]).select(
        "client_id", "eid", "fault_id")


@query("w17_liveness", """SELECT client_id, rid, last_seen, now - last_seen AS age_us, CASE WHEN now - last_seen > 432000000000 THEN 'dead' WHEN now - last_seen > 172800000000 THEN 'stale' ELSE 'active' END AS status
  FROM (SELECT client_id, rid, max(t) AS last_seen FROM episodes GROUP BY 1, 2), clock""")
def w17(x):
    return I.liveness(x.episodes, ["client_id", "rid"], stale_min=2880, dead_min=7200)
