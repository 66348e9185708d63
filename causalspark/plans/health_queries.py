"""Named queries for health, validation and advice (H, V and N rows)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import round_to
from causalspark.operators import health as H, paths as P, sketches as S, topology as T
from causalspark.plans.path_queries import DEGREE, REACH, chains
from causalspark.plans.registry import query
from causalspark.plans.sqltables import r3

HEALTH = {"health": """SELECT *, CASE WHEN health_score >= 80 THEN 'healthy' WHEN health_score >= 50 THEN 'degraded' ELSE 'critical' END AS status FROM (
    SELECT r.client_id, r.rid, r.kind, coalesce(e.events, 0) AS events, coalesce(fatal, 0) AS fatal, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(i.n, 0) AS incidents,
      CAST(greatest(0, least(100, 100 - 15 * coalesce(i.n, 0) - 20 * coalesce(fatal, 0) - 10 * coalesce(error, 0) - 5 * coalesce(warning, 0))) AS BIGINT) AS health_score
    FROM resources r LEFT JOIN (SELECT client_id, rid, count(*) AS events, count(*) FILTER (severity = 'FATAL') AS fatal, count(*) FILTER (severity = 'ERROR') AS error, count(*) FILTER (severity = 'WARNING') AS warning
      FROM episodes, clock WHERE t >= now - 172800000000 GROUP BY 1, 2) e USING (client_id, rid) LEFT JOIN (SELECT client_id, resource_id AS rid, count(*) AS n FROM incidents WHERE status <> 'resolved' GROUP BY 1, 2) i USING (client_id, rid))"""}


def _health(x):
    return H.resource_health(x.resources, x.episodes, x.incidents, hours=48)


@query("h1_resource_health", "SELECT * FROM health", HEALTH)
def h1(x):
    return _health(x)


@query("h1_health_checks", " UNION ALL ".join(f"SELECT client_id, rid, '{n}' AS \"check\", {c} AS value, CASE WHEN {c} {low} THEN 'ok' WHEN {c} < {hi} THEN 'warning' ELSE 'critical' END AS state FROM health"
    for n, c, low, hi in [("Active Incidents", "incidents", "= 0", 3), ("Fatal Events", "fatal", "= 0", 5), ("Error Events", "error", "= 0", 10), ("Warning Events", "warning", "= 0", 20), ("Event Frequency", "events", "< 50", 100)]), HEALTH)
def h1c(x):
    return H.health_checks(_health(x))


@query("h2_health_ratio", f"SELECT client_id, rid, kind, events, errors, fatal, {r3('ratio', 2)} AS health_score, CASE WHEN ratio >= 0.9 THEN 'healthy' WHEN ratio >= 0.7 THEN 'degraded' WHEN ratio >= 0.5 THEN 'unhealthy' ELSE 'critical' END AS status FROM (SELECT *, CAST(1.0 AS DOUBLE) - (errors * CAST(0.5 AS DOUBLE) + fatal) / greatest(events, 1) AS ratio FROM (SELECT r.client_id, r.rid, r.kind, coalesce(n, 0) AS events, coalesce(errors, 0) AS errors, coalesce(fatal, 0) AS fatal FROM resources r LEFT JOIN (SELECT client_id, rid, count(*) AS n, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'FATAL') AS fatal FROM episodes, clock WHERE t >= now - 864000000000 GROUP BY 1, 2) USING (client_id, rid) WHERE kind IN ('Pod','Service','Deployment'))) WHERE ratio < 0.8")
def h2(x):
    return H.health_ratio(x.resources, x.episodes, hours=240)


@query("h3_tenant_summary", "SELECT r.*, coalesce(n, 0) AS active_incidents FROM (SELECT client_id, count(*) FILTER (phase IN ('Running','Active')) AS healthy, count(*) FILTER (phase IN ('Failed','CrashLoopBackOff','Pending')) AS unhealthy, count(*) AS total FROM resources GROUP BY 1) r LEFT JOIN (SELECT e.client_id, count(*) AS n FROM episodes e, clock WHERE t >= now - 864000000000 AND EXISTS (SELECT 1 FROM links l WHERE l.client_id = e.client_id AND l.cause = e.eid) AND NOT EXISTS (SELECT 1 FROM links l WHERE l.client_id = e.client_id AND l.effect = e.eid) GROUP BY 1) USING (client_id)")
def h3(x):
    return H.tenant_summary(x.resources, x.episodes, x.links, 240)


@query("h3_top_issues", "SELECT client_id, reason, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY n DESC, reason) AS rank FROM (SELECT client_id, reason, count(*) AS n FROM episodes, clock WHERE t >= now - 86400000000 GROUP BY 1, 2)) WHERE rank <= 5")
def h3t(x):
    return H.top_issues(x.episodes)


@query("h4_namespace_health", "SELECT *, CASE WHEN failed = 0 AND pending = 0 THEN 'healthy' ELSE 'degraded' END AS status, CASE WHEN recent_errors > 10 THEN 'critical' WHEN recent_errors > 0 THEN 'warning' ELSE 'healthy' END AS alarm FROM (SELECT p.*, coalesce(n, 0) AS recent_errors FROM (SELECT client_id, ns, count(*) FILTER (phase = 'Running') AS running, count(*) FILTER (phase = 'Failed') AS failed, count(*) FILTER (phase = 'Pending') AS pending, count(*) FILTER (phase = 'CrashLoopBackOff') AS other FROM pods GROUP BY 1, 2) p LEFT JOIN (SELECT client_id, s_ns AS ns, count(*) AS n FROM episodes, clock WHERE reason IN ('Failed','BackOff','Unhealthy','OOMKilled','Error','CrashLoopBackOff') AND t >= now - 86400000000 GROUP BY 1, 2) USING (client_id, ns))")
def h4(x):
    return H.namespace_health(x.resources, x.episodes)


@query("h5_service_health", "SELECT *, CASE WHEN unhealthy = 0 THEN 'Healthy' WHEN unhealthy < pods THEN 'Degraded' ELSE 'Critical' END AS health FROM (SELECT client_id, 'service:' || ns || ':svc-' || app AS service, count(*) AS pods, count(*) FILTER (phase <> 'Running') AS unhealthy FROM pods GROUP BY 1, 2)")
def h5(x):
    return H.service_health(T.service_map(x.edges).select("client_id", "service", "pod"), x.resources)


LAT = "SELECT CASE etype WHEN 'k8s.event' THEN 'message_processing' WHEN 'k8s.log' THEN 'rca_compute' ELSE 'graph_query' END AS operation, value * 5 AS ms FROM episodes"


def _latencies(x):
    op = F.when(F.col("etype") == "k8s.event", "message_processing").when(F.col("etype") == "k8s.log", "rca_compute").otherwise("graph_query")
    return x.episodes.select(op.alias("operation"), (F.col("value") * 5).alias("ms"))


@query("h6_sla_labels", f"SELECT operation, CASE WHEN ms > hi THEN 'critical' WHEN ms > lo THEN 'warning' ELSE 'ok' END AS label, count(*) AS n, max(ms) AS worst_ms FROM (SELECT *, CASE operation WHEN 'message_processing' THEN 500 WHEN 'rca_compute' THEN 200 ELSE 100 END AS lo, CASE operation WHEN 'message_processing' THEN 2000 WHEN 'rca_compute' THEN 1000 ELSE 500 END AS hi FROM ({LAT})) GROUP BY 1, 2")
def h6(x):
    return H.sla_labels(_latencies(x))


@query("h6_latency_histogram", f"SELECT operation, CAST(floor(ms / 50) * 50 AS BIGINT) AS from_ms, count(*) AS n FROM ({LAT}) GROUP BY 1, 2")
def h6h(x):
    return H.latency_histogram(_latencies(x))


def _sketched(x):
    """Latencies with their time and resource, sketched by operation and hour."""
    op = F.when(F.col("etype") == "k8s.event", "message_processing").when(F.col("etype") == "k8s.log", "rca_compute").otherwise("graph_query")
    values = x.episodes.select(op.alias("operation"), "t", (F.col("value") * 5).alias("value"), F.col("rid").alias("item"))
    return values, S.build(values, ["operation"])


@query("h6_latency_percentiles")
def h6p(x):
    """Percentiles of each operation, merged from the hourly sketches (approximate, so without check SQL)."""
    return S.percentiles(_sketched(x)[1], ["operation"])


@query("h6_percentile_errors", f"""SELECT operation, p, count(*) AS n, true AS close FROM ({LAT}) CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS p) WHERE ms IS NOT NULL GROUP BY 1, 2""")
def h6e(x):
    """Whether the merged percentiles have the rank they stand for, within the sketch's bound."""
    values, store = _sketched(x)
    merged = S.merge(store, ["operation"])
    estimates = reduce(DataFrame.unionByName, [merged.select("operation", F.lit(p).alias("p"), S.quantile(p).alias("estimate")) for p in (0.5, 0.9, 0.99)])
    return S.rank_errors(values, estimates, ["operation"]).select("operation", "p", "n", (F.col("error") <= S.RANK_ERROR).alias("close"))


@query("h6_distinct_errors", "SELECT CASE etype WHEN 'k8s.event' THEN 'message_processing' WHEN 'k8s.log' THEN 'rca_compute' ELSE 'graph_query' END AS operation, count(DISTINCT rid) AS items, true AS close FROM episodes GROUP BY 1")
def h6d(x):
    values, store = _sketched(x)
    exact = values.groupBy("operation").agg(F.count_distinct("item").alias("items"))
    near = S.merge(store, ["operation"]).select("operation", S.distinct().alias("about"))
    return exact.join(near, "operation").select("operation", "items", (F.abs(F.col("about") - F.col("items")) <= S.DISTINCT_ERROR * F.col("items")).alias("close"))


@query("h7_incident_sla", "SELECT incident_id, CASE WHEN s > 120 THEN 'breached' WHEN n > 10 THEN 'breaching' ELSE 'within_slo' END AS sla_status, CASE WHEN s > 120 THEN 110.0::DOUBLE WHEN n > 10 THEN 98.5::DOUBLE ELSE 95.2::DOUBLE END AS sla_percentage, CASE WHEN s > 120 THEN 0 WHEN n > 10 THEN 1 ELSE 3 END AS risk_budget FROM (SELECT i.incident_id, count(*) FILTER (contains(lower(m.reason), 'fail')) AS n, any_value((i.window_end - i.window_start) / 1000000000.0) AS s FROM incidents i JOIN incident_members m USING (incident_id) GROUP BY 1)")
def h7(x):
    fails = x.incident_members.groupBy("incident_id").agg(F.count(F.when(F.contains(F.lower("reason"), F.lit("fail")), 1)).alias("n"))
    rows = x.incidents.join(fails, "incident_id").withColumn("s", (F.col("window_end") - F.col("window_start")) / 1e9)
    return rows.select("incident_id", *[c.alias(k) for k, c in H.incident_sla(F.col("n"), F.col("s")).items()])


EXPECT = " OR ".join("(e_reason = '" + s + "' AND (" + " OR ".join(f"contains(lower(c_reason), '{c.lower()}')" for c in cs) + "))" for s, cs in R.EXPECTED_CAUSES.items())
RANKS = {"ranks": f"""SELECT client_id, effect, e_reason AS reason, min(CASE WHEN {EXPECT} THEN pos END) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY client_id, effect ORDER BY confidence DESC, c_t DESC, cause) AS pos FROM lk WHERE e_sev IN ('ERROR','FATAL')) GROUP BY 1, 2, 3"""}
ATK = f"""SELECT client_id, k, correct, total, {r3('accuracy', 6)} AS accuracy, {r3('mean_rank', 6)} AS mean_rank, CASE WHEN k = 1 THEN CASE WHEN accuracy >= 0.8 THEN 'Excellent' WHEN accuracy >= 0.7 THEN 'Good' WHEN accuracy >= 0.6 THEN 'Fair' ELSE 'Needs Improvement' END
    WHEN k = 3 THEN CASE WHEN accuracy >= 0.93 THEN 'Exceeds Academic Benchmark' WHEN accuracy >= 0.85 THEN 'Production Ready' WHEN accuracy >= 0.75 THEN 'Acceptable' ELSE 'Needs Improvement' END
    WHEN k = 5 THEN CASE WHEN accuracy >= 0.95 THEN 'Excellent' WHEN accuracy >= 0.9 THEN 'Good' ELSE 'Fair' END ELSE CASE WHEN accuracy >= 0.95 THEN 'Excellent' ELSE 'Good' END END AS rating
  FROM (SELECT client_id, k, correct, total, correct / CAST(total AS DOUBLE) AS accuracy, mean_rank FROM (SELECT client_id, k, count(*) FILTER (rank <= k) AS correct, count(*) AS total, avg(rank) AS mean_rank FROM ranks, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY 1, 2))"""


def _atk(x, **kw):
    r = H.accuracy_at_k(H.match_ranks(x.named_links, x.episodes, days=365, sample=None, **kw))
    return r.withColumn("accuracy", round_to(F.col("accuracy"), 6)).withColumn("mean_rank", round_to(F.col("mean_rank"), 6))


@query("v1_accuracy_at_k", ATK, RANKS)
def v1(x):
    return _atk(x)


@query("v1_accuracy_assume_top", ATK, {"ranks": RANKS["ranks"].replace("min(CASE", "coalesce(min(CASE").replace(" END) AS rank", " END), 1) AS rank")})
def v1a(x):
    return _atk(x, assume_top=True)


@query("v2_accuracy_by_symptom", "SELECT client_id, reason, count(*) AS total, count(*) FILTER (rank <= 1) AS correct_at_1, count(*) FILTER (rank <= 3) AS correct_at_3, count(*) FILTER (rank <= 5) AS correct_at_5 FROM ranks WHERE reason IN ('BackOff','CrashLoopBackOff','Evicted','FailedScheduling','Unhealthy','FailedMount','NetworkNotReady') GROUP BY 1, 2", RANKS)
def v2(x):
    return H.accuracy_by_symptom(H.match_ranks(x.named_links, x.episodes, days=365, sample=None))


@query("v3_accuracy_rating", "SELECT client_id, e_reason AS reason, CASE WHEN a >= 0.8 THEN 'Excellent' WHEN a >= 0.7 THEN 'Good' WHEN a >= 0.6 THEN 'Fair' ELSE 'Needs Improvement' END AS rating FROM (SELECT client_id, reason AS e_reason, count(*) FILTER (rank <= 1) / CAST(count(*) AS DOUBLE) AS a FROM ranks GROUP BY 1, 2)", RANKS)
def v3(x):
    r = H.match_ranks(x.named_links, x.episodes, days=365, sample=None)
    g = r.groupBy("client_id", "reason").agg((F.count(F.when(F.col("rank") <= 1, 1)) / F.count("*")).alias("a"))
    return g.select("client_id", "reason", H.accuracy_rating(F.lit(1), F.col("a")).alias("rating"))


ADVICE = " UNION ALL ".join(f"SELECT incident_id, '{kind}' AS type, '{action}' AS action, {conf}::DOUBLE AS confidence, '{prio}' AS priority FROM texts WHERE " + " OR ".join(f"contains(body, '{p}')" for p in parts)
                            for parts, kind, action, conf, prio in R.RECOMMENDATIONS)


@query("n1_recommendations", f"SELECT * FROM advice UNION ALL SELECT incident_id, 'investigation', 'Review incident details and logs', 0.5::DOUBLE, 'high' FROM incidents i WHERE NOT EXISTS (SELECT 1 FROM advice a WHERE a.incident_id = i.incident_id)",
       {"texts": "SELECT incident_id, lower(string_agg(reason || ' ' || message, ' ')) AS body FROM incident_members GROUP BY 1", "advice": ADVICE})
def n1(x):
    return H.recommendations(x.incidents, x.incident_members).drop("client_id")


@query("n2_list_incidents", "SELECT client_id, incident_id, resource_id, severity, status, count(*) OVER (PARTITION BY client_id) AS total FROM incidents WHERE severity IN ('FATAL','ERROR') AND status = 'resolved' AND contains(resource_id, 'pod:') QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY window_start DESC, incident_id) BETWEEN 6 AND 25")
def n2(x):
    return H.list_incidents(x.incidents, ["FATAL", "ERROR"], ["resolved"], "pod:", 5, 20).select("client_id", "incident_id", "resource_id", "severity", "status", "total")


@query("n3_error_summary", "SELECT *, CASE WHEN fatal > 0 THEN 'critical' WHEN errors > 5 THEN 'high' ELSE 'medium' END AS overall FROM (SELECT incident_id, count(*) AS errors, count(*) FILTER (severity = 'FATAL') AS fatal, count(DISTINCT reason) AS reasons, count(DISTINCT rid) AS resources FROM incident_members GROUP BY 1)")
def n3(x):
    return H.error_summary(x.incident_members)


@query("n3_affected_resources", "SELECT client_id, rid, CASE WHEN bool_or(s = 1) THEN 'incident' ELSE 'event' END AS source FROM (SELECT client_id, resource_id AS rid, 1 AS s FROM incidents UNION ALL SELECT client_id, rid, 2 FROM episodes WHERE severity = 'FATAL') GROUP BY 1, 2")
def n3a(x):
    return H.affected_resources(
        x.incidents.select("client_id", F.col("resource_id").alias("rid"), F.lit("incident").alias("source")),
        x.episodes.where("severity = 'FATAL'").select("client_id", "rid", F.lit("event").alias("source")))


ACTIONS = """SELECT i.incident_id AS action_id, CASE severity WHEN 'FATAL' THEN 'pod_restart' ELSE 'investigation' END AS action_type, i.event_count,
    CASE WHEN i.event_count % 4 = 0 THEN 'kubectl delete pod ' WHEN i.event_count % 4 = 1 THEN 'kubectl scale deployment ' WHEN i.event_count % 4 = 2 THEN 'look at ' ELSE 'kubectl delete pvc ' END || resource_id AS command,
    CASE WHEN i.client_id = 'tenant-0' THEN 'production' ELSE 'test' END AS ns, CASE WHEN i.event_count % 2 = 1 THEN 'StatefulSet' ELSE 'Pod' END AS kind, i.resource_id FROM incidents i"""


@query("n4_action_risk", f"""SELECT action_id, base_level, level, level <> 'low' AS requires_approval FROM (SELECT *, CASE WHEN serious >= 2 THEN CASE base_level WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END
    WHEN serious >= 1 AND base_level = 'medium' THEN 'high' ELSE base_level END AS level FROM (SELECT *, CASE WHEN starts_with(command, 'kubectl delete pod') THEN 'medium' WHEN starts_with(command, 'kubectl scale') THEN 'high' WHEN starts_with(command, 'kubectl delete pvc') THEN 'critical' WHEN action_type = 'pod_restart' THEN 'medium' ELSE 'low' END AS base_level,
      CASE WHEN ns = 'production' THEN 1 ELSE 0 END + CASE WHEN kind = 'StatefulSet' THEN 1 ELSE 0 END AS serious FROM ({ACTIONS})))""")
def n4(x):
    n = F.col("event_count") % 4
    verb = F.when(n == 0, "kubectl delete pod ").when(n == 1, "kubectl scale deployment ").when(n == 2, "look at ").otherwise("kubectl delete pvc ")
    acts = x.incidents.select(
        F.col("incident_id").alias("action_id"), F.when(F.col("severity") == "FATAL", "pod_restart").otherwise("investigation").alias("action_type"),
        F.concat(verb, "resource_id").alias("command"), F.when(F.col("client_id") == "tenant-0", "production").otherwise("test").alias("ns"),
        F.when(F.col("event_count") % 2 == 1, "StatefulSet").otherwise("Pod").alias("kind"), F.lit("").alias("name"),
        F.col("event_count").alias("resources"), F.lit(0).alias("blast_radius"), F.lit(0).alias("critical_incidents"))
    return H.assess_actions(acts).select("action_id", "base_level", "level", "requires_approval")


@query("n5_enrich_alerts", "SELECT a.client_id, a.eid, a.rid, coalesce(r.phase, '') AS phase, coalesce(r.node, '') AS node, coalesce(r.owner, '') AS owner, coalesce(o.n, 0) AS edges_out, coalesce(i.n, 0) AS edges_in, r.rid IS NOT NULL AS known FROM episodes a LEFT JOIN resources r ON r.client_id = a.client_id AND r.rid = a.rid LEFT JOIN (SELECT client_id, src, count(*) AS n FROM edges GROUP BY 1, 2) o ON o.client_id = a.client_id AND o.src = a.rid LEFT JOIN (SELECT client_id, dst, count(*) AS n FROM edges GROUP BY 1, 2) i ON i.client_id = a.client_id AND i.dst = a.rid WHERE a.etype = 'prom.alert'")
def n5(x):
    return H.enrich_alerts(x.episodes.where("etype = 'prom.alert'").select("client_id", "eid", "rid"), x.resources, x.edges)


@query("n5_alert_related", "SELECT DISTINCT a.client_id, a.rid, e.dst AS related, e.type FROM episodes a JOIN (SELECT client_id, src, dst, type FROM edges UNION ALL SELECT client_id, dst, src, type FROM edges) e ON e.client_id = a.client_id AND e.src = a.rid WHERE a.etype = 'prom.alert'")
def n5r(x):
    return H.alert_related(x.episodes.where("etype = 'prom.alert'"), x.edges)


@query("n6_typed_findings", f"""SELECT client_id, 'root_cause' AS finding, eid AS subject, 0.85::DOUBLE AS confidence, down AS size FROM ranked WHERE rank < 5
  UNION ALL SELECT r.client_id, 'blast_radius', r.eid, {r3('CAST(0.88 AS DOUBLE) - rank * CAST(0.05 AS DOUBLE)', 2)}, count(*) FROM ranked r JOIN reached b ON b.client_id = r.client_id AND b.root = r.eid WHERE rank < 3 GROUP BY r.client_id, r.eid, rank
  UNION ALL SELECT r.client_id, 'causal_chain', r.eid, {r3('CAST(0.90 AS DOUBLE) - rank * CAST(0.05 AS DOUBLE)', 2)}, count(*) FROM ranked r JOIN chains c ON c.client_id = r.client_id AND c.path[1] = r.eid WHERE rank < 3 GROUP BY r.client_id, r.eid, rank
  UNION ALL SELECT client_id, 'cross_service', '', 0.92::DOUBLE, count(*) FROM lk WHERE c_rid <> e_rid AND hops BETWEEN 1 AND 3 GROUP BY 1""",
       {**REACH, **chains("links", 3), "ranked": f"SELECT client_id, eid, down, row_number() OVER (PARTITION BY client_id ORDER BY down DESC, eid) - 1 AS rank FROM ({DEGREE}) WHERE up = 0 AND down > 0"})
def n6(x):
    d = P.degrees(x.links).where("upstream = 0 AND downstream > 0").select("client_id", "eid", F.col("downstream").alias("blast_radius"))
    steps = P.best_chains(x.links, 3, episodes=x.episodes).select("client_id", F.get("path", F.lit(0)).alias("root"))
    return H.typed_findings(d, steps, P.reach_pairs(x.links, x.episodes, 3, d), x.named_links.where("c_rid <> e_rid AND hops BETWEEN 1 AND 3"))
