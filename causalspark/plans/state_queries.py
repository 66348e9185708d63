"""Named queries for state maintenance (C rows)."""

from pyspark.sql import functions as F

from causalspark.operators import causality, state as S
from causalspark.plans.registry import query

LIVE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, rid ORDER BY at_us DESC, offset_ DESC) AS n FROM resource_changes) WHERE n = 1 AND op <> 'DELETE'"
LIVE_EDGES = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, id ORDER BY at_us DESC, offset_ DESC) AS n FROM edge_changes) WHERE n = 1 AND op <> 'DELETE'"


@query("c1_current_resources", f"SELECT client_id, rid, at_us AS changed_at, offset_ AS change, image, phase FROM ({LIVE})")
def c1(x):
    return S.current_resources(x.resource_changes).withColumnsRenamed({"at": "changed_at", "offset": "change"})


@query("c2_current_edges", f"SELECT client_id, id, src, dst, at_us AS changed_at FROM ({LIVE_EDGES})")
def c2(x):
    return S.current_edges(x.edge_changes).select("client_id", "id", "src", "dst", F.col("at").alias("changed_at"))


@query("c2_endpoint_stubs", f"""SELECT client_id, rid, false AS stub FROM ({LIVE}) UNION ALL SELECT client_id, rid, true FROM (
    SELECT client_id, src AS rid FROM ({LIVE_EDGES}) UNION SELECT client_id, dst FROM ({LIVE_EDGES})) s
  WHERE NOT EXISTS (SELECT 1 FROM ({LIVE}) l WHERE l.client_id = s.client_id AND l.rid = s.rid)""")
def c2s(x):
    return S.with_endpoint_stubs(S.current_resources(x.resource_changes), S.current_edges(x.edge_changes)
                                 ).select("client_id", "rid", "stub")


@query("c2_endpoint_properties", """SELECT e.client_id, e.rid, NOT coalesce(l.live, false) AS stub, split_part(e.rid, ':', 2) AS ns, CASE WHEN e.rid[1:4] = 'pod:' THEN coalesce(CASE WHEN l.phase = 'F' THEN l.image END, 'Pod') ELSE 'Service' END AS kind,
    split_part(e.rid, ':', 3) AS name FROM ends e LEFT JOIN live l ON l.client_id = e.client_id AND l.rid = e.rid
  UNION ALL SELECT client_id, rid, false, NULL, CASE WHEN phase = 'F' THEN image END, NULL FROM live l WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.client_id = l.client_id AND e.rid = l.rid)""",
       {"live": f"SELECT client_id, rid, image, phase, true AS live FROM ({LIVE})",
        "ends": f"SELECT client_id, src AS rid FROM ({LIVE_EDGES}) UNION SELECT client_id, dst FROM ({LIVE_EDGES})"})
def c2p(x):
    """Resources that know their kind only in part: the edges' ends tell the rest."""
    known = S.current_resources(x.resource_changes).select("client_id", "rid", F.when(F.col("phase") == "F", F.col("image")).alias("kind"))
    return S.with_endpoint_properties(known, S.current_edges(x.edge_changes)).select("client_id", "rid", "stub", "ns", "kind", "name")


@query("c3_detach_edges", f"""SELECT e.client_id, e.id FROM ({LIVE_EDGES}) e JOIN ({LIVE}) l ON l.client_id = e.client_id AND l.rid = e.dst""")
def c3(x):
    live = S.current_resources(x.resource_changes)
    edges = S.current_edges(x.edge_changes)
    services = edges.select("client_id", F.col("src").alias("rid")).distinct()
    return S.current_edges(x.edge_changes, live.select("client_id", "rid").unionByName(services)).select("client_id", "id")


@query("c4_upsert_episodes", "SELECT client_id, eid, rid, CASE WHEN severity IN ('ERROR','FATAL') THEN message || ' (again)' ELSE message END AS message FROM episodes")
def c4(x):
    again = x.episodes.where(F.col("severity").isin("ERROR", "FATAL")).withColumn(
        "message", F.concat("message", F.lit(" (again)"))).withColumn("updated_at", F.col("t") + 1)
    rows = x.episodes.withColumn("updated_at", F.col("t")).unionByName(again)
    return S.upsert_episodes(rows).select("client_id", "eid", "rid", "message")


@query("c5_target_scrapes", """SELECT client_id, 'target-' || name AS target_id, 'pod:' || ns || ':' || name AS rid FROM pods
  UNION ALL SELECT client_id, 'target-' || name, 'service:' || ns || ':svc-' || app FROM pods""")
def c5(x):
    pods = x.resources.where("kind = 'Pod'")
    targets = pods.select("client_id", "ns", F.concat(F.lit("target-"), "name").alias("target_id"),
                          F.col("name").alias("pod"), F.concat(F.lit("svc-"), "app").alias("service"))
    return S.target_scrapes(targets, x.resources)


def _rules(x):
    return x.episodes.where("etype = 'prom.alert'").groupBy("client_id", "s_ns", "service", "reason").agg(
        F.count("*").alias("n")).select("client_id", F.col("s_ns").alias("ns"), "service", F.col("reason").alias("rule"))


RULES = "SELECT DISTINCT client_id, s_ns AS ns, service, reason AS rule FROM episodes WHERE etype = 'prom.alert'"


@query("c6_rule_scopes", f"SELECT r.client_id, r.rule, s.rid FROM ({RULES}) r JOIN resources s ON s.kind = 'Service' AND s.client_id = r.client_id AND s.ns = r.ns AND s.name = r.service")
def c6(x):
    return S.rule_scopes(_rules(x), x.resources)


@query("c7_rule_emits", f"SELECT e.client_id, r.rule, e.eid FROM (SELECT DISTINCT client_id, rule FROM ({RULES})) r JOIN episodes e ON e.client_id = r.client_id AND e.reason = r.rule")
def c7(x):
    return S.rule_emits(_rules(x), x.episodes)


@query("c8_apply_updates", """SELECT client_id, rid, coalesce(u.phase, r.phase) AS phase, coalesce(r.node, '') AS node FROM (SELECT * FROM resources WHERE kind = 'Pod') r
  FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, rid ORDER BY at_us DESC, offset_ DESC) AS n FROM resource_changes) WHERE n = 1) u USING (client_id, rid)
  WHERE coalesce(u.op, 'UPSERT') <> 'DELETE'""")
def c8(x):
    pods = x.resources.where("kind = 'Pod'").select("client_id", "rid", "phase", "node")
    updates = x.resource_changes.select("client_id", "rid", "at", "offset", "op", "phase")
    return S.apply_updates(pods, updates, ["client_id", "rid"]).na.fill("", ["node"])


EDGE_UPDATES = {
    "selects": "SELECT client_id, id FROM edges WHERE type = 'SELECTS'",
    "crcs": "SELECT DISTINCT client_id, id, op FROM (SELECT *, row_number() OVER (PARTITION BY client_id, id ORDER BY at_us DESC, offset_ DESC) AS n FROM edge_changes) WHERE n = 1",
}


@query("c8_apply_edge_updates", "SELECT client_id, id FROM selects ANTI JOIN crcs USING (client_id, id) UNION ALL SELECT client_id, id FROM crcs WHERE op <> 'DELETE'", EDGE_UPDATES)
def c8e(x):
    current = x.edges.where("type = 'SELECTS'").select("client_id", "id", "src", "dst", "type")
    return S.apply_updates(current, x.edge_changes, ["client_id", "id"]).select("client_id", "id")


@query("c8_update_counts", """SELECT client_id, count(*) FILTER (op <> 'DELETE' AND k IS NULL) AS created, count(*) FILTER (op <> 'DELETE' AND k IS NOT NULL) AS changed, count(*) FILTER (op = 'DELETE' AND k IS NOT NULL) AS deleted
  FROM (SELECT *, row_number() OVER (PARTITION BY client_id, rid ORDER BY at_us DESC, offset_ DESC) AS n FROM resource_changes) LEFT JOIN (SELECT client_id, rid, 1 AS k FROM resources WHERE kind = 'Pod') USING (client_id, rid) WHERE n = 1 GROUP BY 1""")
def c8c(x):
    pods = x.resources.where("kind = 'Pod'").select("client_id", "rid")
    return S.update_counts(pods, x.resource_changes, ["client_id", "rid"])


def _incident_updates(x):
    return x.incidents.select("incident_id", F.when(F.col("severity") == "FATAL", "acknowledged").when(
        F.col("event_count") == 3, "closed?").alias("new_status"))


@query("c9_update_incidents", "SELECT incident_id, CASE WHEN severity = 'FATAL' THEN 'acknowledged' ELSE status END AS status FROM incidents")
def c9(x):
    return S.update_incidents(x.incidents, _incident_updates(x))[0].select("incident_id", "status")


@query("c9_rejected_updates", "SELECT incident_id, 'closed?' AS new_status FROM incidents WHERE severity <> 'FATAL' AND event_count = 3")
def c9r(x):
    return S.update_incidents(x.incidents, _incident_updates(x))[1]


@query("c10_retention", "SELECT client_id, cause, effect FROM lk, clock WHERE c_t >= now - 604800000000 AND e_t >= now - 604800000000")
def c10(x):
    return S.retain_with_links(x.episodes, x.links, 7)[1].select("client_id", "cause", "effect")


@query("c11_drop_empty_incidents", "SELECT DISTINCT incident_id FROM incident_members, clock WHERE t >= now - 604800000000")
def c11(x):
    return S.drop_empty_incidents(x.incidents, S.retain(x.incident_members, 7, x.episodes.select(F.max("t")).scalar())).select("incident_id")


@query("c12_backfill_confidence", "SELECT client_id, cause, effect, distance_score, domain_score, confidence FROM links")
def c12(x):
    """Links that have lost their scores are scored anew from their events."""
    hole = F.col("rank") > 2
    lost = x.links
    for column in ("temporal_score", "distance_score", "domain_score", "confidence"):
        lost = lost.withColumn(column, F.when(~hole, F.col(column)))
    return causality.rescore_links(lost, x.episodes, x.edges).select("client_id", "cause", "effect", "distance_score", "domain_score", "confidence")
