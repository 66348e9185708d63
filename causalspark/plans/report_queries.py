"""Named queries for reports (A rows)."""

from pyspark.sql import functions as F

from causalspark.operators import reports as A
from causalspark.operators.timejoin import top_per
from causalspark.plans.ingest_queries import LINES, _lines
from causalspark.plans.registry import query
from causalspark.plans.sqltables import r3

FAIL = "severity IN ('ERROR','FATAL')"
BAND = "CASE WHEN confidence >= 0.9 THEN '0.90-1.00 (High)' WHEN confidence >= 0.7 THEN '0.70-0.89 (Medium-High)' WHEN confidence >= 0.5 THEN '0.50-0.69 (Medium)' WHEN confidence >= 0.3 THEN '0.30-0.49 (Low-Medium)' ELSE '0.00-0.29 (Low)' END"
GAP = "CASE WHEN m < 1 THEN '< 1 min' WHEN m < 5 THEN '1-5 min' WHEN m < 15 THEN '5-15 min' WHEN m < 60 THEN '15-60 min' ELSE '> 1 hour' END"


def pct(n="n", over="()"):
    return r3(f"{n} * CAST(100.0 AS DOUBLE) / sum({n}) OVER {over}", 2)


TENANT_PCT = pct(over="(PARTITION BY client_id)")


def avg3(c):
    return f"floor(CAST(sum(CAST(round({c} * 1000) AS BIGINT)) AS DOUBLE) / count({c}) + 0.5) / CAST(1000.0 AS DOUBLE)"


@query("a1_graph_stats", " UNION ALL ".join(f"SELECT client_id, CASE WHEN g = 1 THEN '{m}_total' ELSE '{m}' END AS metric, CASE WHEN g = 1 THEN '' ELSE item END AS item, n FROM (SELECT client_id, {c} AS item, grouping({c}) AS g, count(*) AS n FROM {t} GROUP BY GROUPING SETS ((client_id, {c}), (client_id)))"
    for t, m, c in [("resources", "resources", "kind"), ("episodes", "events", "severity"), ("edges", "edges", "type"), ("incidents", "incidents", "status")]))
def a1(x):
    return A.graph_stats(x.resources, x.edges, x.episodes, x.incidents)


@query("a2_events_by_type", "SELECT client_id, etype, s_kind, severity, count(*) AS n FROM episodes GROUP BY 1, 2, 3, 4")
def a2(x):
    return A.counted(x.episodes, "client_id", "etype", "s_kind", "severity")


@query("a3_severity_distribution", f"SELECT client_id, severity, n, {TENANT_PCT} AS percentage FROM (SELECT client_id, severity, count(*) AS n FROM episodes GROUP BY 1, 2)")
def a3(x):
    return A.share(A.counted(x.episodes, "client_id", "severity"), by=["client_id"])


@query("a4_hourly_rates", "SELECT client_id, t // 3600000000 AS hour, count(*) AS total, count(*) FILTER (severity = 'FATAL') AS fatal, count(*) FILTER (severity = 'ERROR') AS error, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info FROM episodes GROUP BY 1, 2")
def a4(x):
    return A.hourly_rates(x.episodes)


@query("a5_top_reasons", f"SELECT * FROM (SELECT client_id, reason, n, {TENANT_PCT} AS percentage FROM (SELECT client_id, reason, count(*) AS n FROM episodes WHERE {FAIL} GROUP BY 1, 2)) QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY n DESC, reason) <= 10")
def a5(x):
    return A.top_reasons(x.episodes)


@query("a6_error_prone_resources", f"SELECT client_id, rid, count(*) AS errors, count(*) FILTER (severity = 'FATAL') AS fatal, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM episodes WHERE {FAIL} GROUP BY 1, 2 HAVING count(*) >= 5")
def a6(x):
    return A.error_prone_resources(x.episodes).withColumn("reasons", F.array_join("reasons", "|"))


@query("a7_recurring_failures", f"SELECT client_id, rid, reason, count(*) AS n, min(t) AS first_seen, max(t) AS last_seen, (max(t) - min(t)) // 60000000 AS duration_min FROM episodes WHERE {FAIL} GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def a7(x):
    return A.recurring_failures(x.episodes)


@query("a8_error_sequences", f"SELECT client_id, rid, eid, reason, row_number() OVER (PARTITION BY client_id, rid ORDER BY t, eid) AS step, length FROM (SELECT *, count(*) OVER (PARTITION BY client_id, rid) AS length FROM episodes WHERE {FAIL}) WHERE length >= 3")
def a8(x):
    return A.error_sequences(x.episodes).drop("t")


@query("a9_reason_spans", "SELECT client_id, rid, reason, count(*) AS n, min(t) AS first_seen, max(t) AS last_seen FROM episodes WHERE reason IN ('CrashLoopBackOff','BackOff','OOMKilled','Unhealthy') GROUP BY 1, 2, 3")
def a9(x):
    return A.reason_spans(x.episodes, ["CrashLoopBackOff", "BackOff", "OOMKilled", "Unhealthy"])


SCORES = ["confidence", "temporal_score", "distance_score", "domain_score"]


@query("a10_link_stats", "SELECT client_id, count(*) AS links, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, {avg3(c)} AS avg_{c}" for c in SCORES) + " FROM links GROUP BY 1")
def a10(x):
    return A.link_stats(x.links)


@query("a11_null_scores", "SELECT client_id, count(*) AS links, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in SCORES) + " FROM links GROUP BY 1")
def a11(x):
    return A.null_scores(x.links)


@query("a12_confidence_histogram", f"SELECT client_id, band, n, average, {TENANT_PCT} AS percentage FROM (SELECT client_id, {BAND} AS band, count(*) AS n, {avg3('confidence')} AS average FROM links GROUP BY 1, 2)")
def a12(x):
    return A.confidence_histogram(x.links)


@query("a13_links_per_event", f"SELECT client_id, causes, n, {TENANT_PCT} AS percentage FROM (SELECT client_id, causes, count(*) AS n FROM (SELECT client_id, effect, count(*) AS causes FROM links GROUP BY 1, 2) GROUP BY 1, 2)")
def a13(x):
    return A.links_per_event(x.links)


@query("a14_gap_distribution", f"SELECT client_id, band, n, min_minutes, max_minutes, {r3('s / CAST(n AS DOUBLE)', 2)} AS avg_minutes, {TENANT_PCT} AS percentage FROM (SELECT client_id, {GAP} AS band, count(*) AS n, min(m) AS min_minutes, max(m) AS max_minutes, sum(m) AS s FROM (SELECT client_id, time_gap_seconds // 60 AS m FROM links) GROUP BY 1, 2)")
def a14(x):
    return A.gap_distribution(x.links)


@query("a15_reason_pairs", f"SELECT client_id, c_reason, e_reason, count(*) AS n, {avg3('confidence')} AS average FROM lk GROUP BY 1, 2, 3")
def a15(x):
    return A.reason_pairs(x.named_links)


@query("a16_severity_transitions", f"SELECT client_id, c_severity, e_severity, n, {TENANT_PCT} AS percentage FROM (SELECT client_id, c_sev AS c_severity, e_sev AS e_severity, count(*) AS n FROM lk GROUP BY 1, 2, 3)")
def a16(x):
    return A.severity_transitions(x.named_links)


ROOTS = "SELECT client_id, c_reason, c_sev AS c_severity, count(DISTINCT client_id || effect) AS symptoms, array_to_string(list_sort(list_distinct(list(e_reason)))[1:5], '|') AS examples FROM lk {w} GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY symptoms DESC, c_reason, c_severity) <= 15"


@query("a17_common_root_causes", ROOTS.format(w=""))
def a17(x):
    return A.common_root_causes(x.named_links)


@query("a17_common_alert_causes", ROOTS.format(w="WHERE c_etype = 'prom.alert'"))
def a17a(x):
    return A.common_root_causes(x.named_links, etype="prom.alert")


@query("a18_many_causes", "SELECT client_id, effect, count(*) AS causes, max(confidence) AS best, min(confidence) AS least FROM links GROUP BY 1, 2 HAVING count(*) >= 3")
def a18(x):
    return A.many_causes(x.links, 3)


COVER = "SELECT {by}, errors, with_causes, errors - with_causes AS without_causes, {pc} AS coverage_percent, CASE WHEN o < 30 THEN 'Excellent' WHEN o < 50 THEN 'Good' WHEN o < 70 THEN 'Fair' ELSE 'Poor' END AS rating FROM (SELECT *, (errors - with_causes) * CAST(100.0 AS DOUBLE) / errors AS o FROM (SELECT {by}, count(*) AS errors, count(h) AS with_causes FROM episodes e LEFT JOIN (SELECT DISTINCT client_id AS hc, effect AS h FROM links) l ON hc = client_id AND h = eid WHERE severity IN ('ERROR','FATAL') GROUP BY {by}))"


@query("a19_rca_coverage", COVER.format(by="client_id", pc=r3("100.0 - o", 2)))
def a19(x):
    return A.rca_coverage(x.episodes, x.links, "client_id")


@query("a19_rca_coverage_by_namespace", COVER.format(by="client_id, s_ns", pc=r3("100.0 - o", 2)))
def a19n(x):
    return A.rca_coverage(x.episodes, x.links, "client_id", "s_ns")


@query("a20_readiness", f"SELECT *, {r3('links * CAST(100.0 AS DOUBLE) / errors', 2)} AS links_per_error, CASE WHEN links > 20000 AND event_types > 30 AND links * 100.0 / errors > 500 THEN 'ready' WHEN links > 1000 THEN 'adequate' ELSE 'insufficient' END AS status FROM (SELECT client_id, count(*) AS events, count(*) FILTER ({FAIL}) AS errors, count(DISTINCT reason) AS event_types FROM episodes GROUP BY 1) JOIN (SELECT client_id, count(*) AS links FROM links GROUP BY 1) USING (client_id) JOIN (SELECT client_id, count(*) AS resources FROM resources GROUP BY 1) USING (client_id)")
def a20(x):
    return A.readiness(x.episodes, x.links, x.resources)


@query("a21_pattern_confidence", f"SELECT client_id, c_reason, e_reason, count(*) AS n, {avg3('confidence')} AS average FROM lk WHERE (c_reason = 'OOMKilled' AND e_reason = 'BackOff') OR (c_reason = 'ImagePullBackOff' AND e_reason = 'Failed') OR (c_reason = 'Unhealthy' AND e_reason = 'Killing') OR (c_reason = 'FailedMount' AND e_reason = 'Failed') GROUP BY 1, 2, 3")
def a21(x):
    return A.pattern_confidence(x.named_links, [("OOMKilled", "BackOff"), ("ImagePullBackOff", "Failed"), ("Unhealthy", "Killing"), ("FailedMount", "Failed")])


@query("a22_catalogue", "SELECT client_id, ns, count(*) AS resources, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM resources GROUP BY 1, 2")
def a22(x):
    return A.catalogue(x.resources)


@query("a23_resource_catalogue", f"SELECT r.client_id, r.rid, r.kind, coalesce(e.n, 0) AS events, coalesce(e.errors, 0) AS errors, coalesce(d.n, 0) AS dependencies, count(*) OVER (PARTITION BY r.client_id) AS total FROM resources r LEFT JOIN (SELECT client_id, rid, count(*) AS n, count(*) FILTER ({FAIL}) AS errors FROM episodes, clock WHERE t >= now - 604800000000 GROUP BY 1, 2) e USING (client_id, rid) LEFT JOIN (SELECT client_id, src AS rid, count(*) AS n FROM edges GROUP BY 1, 2) d USING (client_id, rid) QUALIFY row_number() OVER (PARTITION BY r.client_id ORDER BY events DESC, r.rid) BETWEEN 21 AND 70")
def a23(x):
    return A.resource_catalogue(x.resources, x.episodes, x.edges, hours=168, offset=20, limit=50)


@query("a23_catalogue_dependencies", """SELECT client_id, rid, dependency, type, CAST(row_number() OVER (PARTITION BY client_id, rid ORDER BY dependency, type) AS INTEGER) AS position FROM (
    SELECT DISTINCT e.client_id, e.src AS rid, e.dst AS dependency, e.type FROM edges e JOIN (SELECT r.client_id, r.rid FROM resources r LEFT JOIN (SELECT client_id, rid, count(*) AS n FROM episodes, clock WHERE t >= now - 604800000000 GROUP BY 1, 2) v USING (client_id, rid)
      QUALIFY row_number() OVER (PARTITION BY r.client_id ORDER BY coalesce(v.n, 0) DESC, r.rid) BETWEEN 21 AND 70) p ON p.client_id = e.client_id AND p.rid = e.src)""")
def a23_dependencies(x):
    return A.catalogue_dependencies(a23(x), x.edges)


@query("a24_node_distribution", "SELECT client_id, node, count(*) AS pods, string_agg(DISTINCT ns, '|' ORDER BY ns) AS namespaces FROM pods GROUP BY 1, 2")
def a24(x):
    return A.node_distribution(x.resources.where("kind = 'Pod'"))


@query("a25_tenant_comparison", f"SELECT *, {r3('running * CAST(100.0 AS DOUBLE) / pods', 2)} AS health_percent FROM (SELECT client_id, count(*) AS pods, count(*) FILTER (phase = 'Running') AS running FROM pods GROUP BY 1) JOIN (SELECT client_id, count(*) AS events, count(*) FILTER ({FAIL}) AS errors FROM episodes GROUP BY 1) USING (client_id)")
def a25(x):
    return A.tenant_comparison(x.resources, x.episodes)


@query("a26_alerts_by_day", "SELECT client_id, t // 86400000000 AS day, severity, count(*) AS alerts FROM episodes WHERE etype = 'prom.alert' GROUP BY 1, 2, 3")
def a26(x):
    return A.alerts_by_day(x.episodes)


@query("a26_flapping_alerts", "SELECT client_id, rid, reason, count(*) AS n, min(t) AS first_seen, max(t) AS last_seen FROM episodes, clock WHERE etype = 'prom.alert' AND t >= now - 2592000000000 GROUP BY 1, 2, 3 HAVING count(*) > 2")
def a26f(x):
    return A.flapping_alerts(x.episodes, 2, 720)


@query("a27_deployment_scorecard", f"SELECT *, CASE WHEN errors = 0 THEN 'Healthy' WHEN errors < 10 THEN 'Warning' ELSE 'Critical' END AS status FROM (SELECT client_id, 'deployment:' || ns || ':' || deploy AS deployment, count(*) AS pods, CAST(sum(coalesce(n, 0)) AS BIGINT) AS errors, count(n) AS pods_with_errors FROM pods LEFT JOIN (SELECT client_id AS c, rid, count(*) AS n FROM episodes WHERE {FAIL} GROUP BY 1, 2) ON c = client_id AND rid = 'pod:' || ns || ':' || name GROUP BY 1, 2)")
def a27(x):
    return A.deployment_scorecard(x.episodes, x.edges)


@query("a28_freshness", "SELECT client_id, etype, newest, n, (now - newest) // 60000000 AS lag_minutes, CASE WHEN (now - newest) // 60000000 <= 5 THEN 'fresh' WHEN (now - newest) // 60000000 <= 60 THEN 'delayed' ELSE 'stale' END AS status FROM (SELECT client_id, etype, max(t) AS newest, count(*) AS n FROM episodes GROUP BY 1, 2), clock")
def a28(x):
    return A.freshness(x.episodes)


@query("a29_pipeline_counts", "SELECT 'events' AS stage, count(*) AS n FROM episodes UNION ALL SELECT 'resources', count(*) FROM resources UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'incidents', count(*) FROM incidents")
def a29(x):
    return A.pipeline_counts(events=x.episodes, resources=x.resources, edges=x.edges, links=x.links, incidents=x.incidents)


@query("a30_resource_age", "SELECT client_id, rid, count(*) AS changes, min(at_us) AS first_seen, (max(at_us) - min(at_us)) // 86400000000 AS age_days FROM resource_changes GROUP BY 1, 2 HAVING count(*) > 3 QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY changes DESC, rid) <= 50")
def a30(x):
    g = x.resource_changes.groupBy("client_id", "rid").agg(F.count("*").alias("changes"), F.min("at").alias("first_seen"), F.max("at").alias("last"))
    rows = g.where("changes > 3").withColumn("age_days", F.floor((F.col("last") - F.col("first_seen")) / 86400000000)).drop("last")
    return top_per(rows, ["client_id"], [F.desc("changes"), "rid"], 50)


@query("a33_expectations", """SELECT "check", bad, bad = 0 AS passed FROM (SELECT 'event without ' || c AS "check", 0::BIGINT AS bad FROM (SELECT unnest(['eid','client_id','reason','severity','rid']) AS c) UNION ALL SELECT 'confidence out of range', count(*) FROM links WHERE NOT confidence BETWEEN 0 AND 1
  UNION ALL SELECT 'effect before cause', count(*) FROM links WHERE time_gap_seconds < 0 UNION ALL SELECT 'self link', count(*) FROM links WHERE cause = effect)""")
def a33(x):
    return A.expectations(x.episodes, x.links)


@query("a34_confidence_percentiles", f"SELECT client_id, min(confidence) AS min, max(confidence) AS max, {r3('quantile_cont(confidence, 0.5)', 6)} AS p50, {r3('quantile_cont(confidence, 0.9)', 6)} AS p90, {r3('quantile_cont(confidence, 0.99)', 6)} AS p99 FROM links GROUP BY 1")
def a34(x):
    return A.confidence_percentiles(x.links)


@query("a35_log_patterns", "SELECT * FROM (SELECT CASE WHEN starts_with(id, 'doc-') THEN 'documents' ELSE 'events' END AS source, coalesce(level, '') AS severity, substr(line, 1, 100) AS pattern, count(*) AS n FROM lines GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, severity, pattern) <= 20", {"lines": LINES})
def a35(x):
    source = F.when(F.startswith(F.col("id"), F.lit("doc-")), "documents").otherwise("events")
    return A.log_patterns(_lines(x).select(source.alias("source"), F.coalesce("level", F.lit("")).alias("severity"), "line"))


@query("a36_subject_summary", f"SELECT client_id, rid, CAST(sum(n) AS BIGINT) AS failures, max({{'n': n, 'r': reason}}).r AS top_reason, arg_max(last_eid, last_t) AS latest_event, CASE WHEN max({{'n': n, 'r': reason}}).r IN ('OOMKilled','LOG_OOM_KILLED') THEN 'memory limit' WHEN max({{'n': n, 'r': reason}}).r IN ('BackOff','CrashLoopBackOff','Error','Failed') THEN 'application crash' WHEN contains(max({{'n': n, 'r': reason}}).r, 'Image') THEN 'image' ELSE 'other' END AS likely_cause, string_agg(reason || '=' || CAST(n AS STRING), ',' ORDER BY reason) AS reasons FROM (SELECT client_id, rid, reason, count(*) AS n, arg_max(eid, t) AS last_eid, max(t) AS last_t FROM episodes WHERE {FAIL} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def a36(x):
    kv = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return A.subject_summary(x.episodes).withColumn("reasons", kv)
