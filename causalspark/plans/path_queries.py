"""Named queries for walks over causal links (G rows)."""

from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import is_failure, round_to
from causalspark.operators import causality as L, paths as P
from causalspark.plans.registry import query
from causalspark.plans.sqltables import r3

DEGREE = """SELECT client_id, eid, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM (SELECT client_id, effect AS eid, count(*) AS up FROM links GROUP BY 1, 2)
    FULL JOIN (SELECT client_id, cause AS eid, count(*) AS down FROM links GROUP BY 1, 2) USING (client_id, eid)"""


def chains(links: str, hops: int, roots: str | None = None) -> dict:
    """SQL rounds: one best state per event and length."""
    start = roots or f"SELECT DISTINCT client_id, cause AS eid FROM {links}"
    out = {"b0": f"SELECT client_id, eid, CAST(1.0 AS DOUBLE) AS overall, [eid] AS path FROM ({start})"}
    for h in range(1, hops + 1):
        out[f"b{h}"] = f"""SELECT client_id, eid, overall, path FROM (SELECT b.client_id, l.effect AS eid, b.overall * l.confidence AS overall, list_append(b.path, l.effect) AS path,
            row_number() OVER (PARTITION BY b.client_id, l.effect ORDER BY b.overall * l.confidence DESC, list_append(b.path, l.effect)) AS n
            FROM b{h - 1} b JOIN {links} l ON l.client_id = b.client_id AND l.cause = b.eid) WHERE n = 1"""
    union = " UNION ALL ".join(f"SELECT *, {h} AS hops FROM b{h}" for h in range(1, hops + 1))
    out["chains"] = f"""SELECT client_id, eid AS target, overall, path, CAST(hops AS INTEGER) AS hops FROM (SELECT *, row_number() OVER (PARTITION BY client_id, eid ORDER BY overall DESC, hops, path) AS n FROM ({union})) WHERE n = 1"""
    return out


REACH = {
    "r1": "SELECT client_id, cause AS root, effect AS eid, confidence AS product, confidence AS first FROM links",
    "r2": "SELECT r.client_id, r.root, l.effect AS eid, max(r.product * l.confidence) AS product, max(r.first) AS first FROM r1 r JOIN links l ON l.client_id = r.client_id AND l.cause = r.eid GROUP BY 1, 2, 3",
    "r3": "SELECT r.client_id, r.root, l.effect AS eid, max(r.product * l.confidence) AS product, max(r.first) AS first FROM r2 r JOIN links l ON l.client_id = r.client_id AND l.cause = r.eid GROUP BY 1, 2, 3",
    "reached": "SELECT client_id, root, eid, CAST(min(h) AS INTEGER) AS hops, max(product) AS product, max(first) AS first FROM (SELECT *, 1 AS h FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3) GROUP BY 1, 2, 3",
}
FAIL = "severity IN ('ERROR','FATAL')"


@query("g1_root_causes", f"""SELECT e.client_id, e.eid, e.reason, e.s_kind, e.s_ns, e.s_name, up AS upstream_causes, down AS blast_radius FROM episodes e JOIN ({DEGREE}) d USING (client_id, eid)
  WHERE up = 0 AND down > 0 QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY down DESC, t, eid) <= 10""")
def g1(x):
    links = L.build_causality(x.episodes, x.edges)
    return P.root_causes(x.episodes, links, hours=24 * 365).drop("t")


@query("g2_root_causes_lenient", f"""SELECT e.client_id, e.eid, e.reason, up AS upstream_causes, down AS blast_radius FROM episodes e JOIN ({DEGREE}) d USING (client_id, eid)
  WHERE up <= 10 AND down > 0 AND etype IN ('k8s.event','prom.alert') AND reason NOT IN ('Pulled','Created','Started','Scheduled','Completed','SuccessfulCreate','SuccessfulDelete','Killing','SawCompletedJob','LOG_INFO')
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY down DESC, t, eid) <= 50""")
def g2(x):
    return P.root_causes(x.episodes, x.links, hours=24 * 365, limit=50, max_upstream=10, exclude=R.NORMAL_REASONS,
                         etypes=["k8s.event", "prom.alert"]).select("client_id", "eid", "reason", "upstream_causes", "blast_radius")


@query("g3_best_chains", f"SELECT client_id, target, hops, {r3('overall', 6)} AS overall, array_to_string(path, '>') AS path FROM chains", chains("links", 3))
def g3(x):
    return P.best_chains(x.links, 3, episodes=x.episodes).select("client_id", "target", "hops", round_to(F.col("overall"), 6).alias("overall"), F.array_join("path", ">").alias("path"))


@query("g3_chain_steps", f"""SELECT c.client_id, c.target, CAST(i AS INTEGER) AS step, c.path[i] AS eid, e.reason, CASE WHEN i = 1 THEN 'root' WHEN i = c.hops + 1 THEN 'effect' ELSE 'intermediate' END AS role,
    coalesce(l.confidence, 0) AS confidence_to_next, {r3('c.overall', 6)} AS overall_confidence
  FROM (SELECT *, unnest(range(1, hops + 2)) AS i FROM chains) c JOIN episodes e ON e.client_id = c.client_id AND e.eid = c.path[i]
  LEFT JOIN links l ON l.client_id = c.client_id AND l.cause = c.path[i] AND l.effect = c.path[i + 1]""", chains("links", 3))
def g3s(x):
    s = P.chain_steps(P.best_chains(x.links, 3, episodes=x.episodes), x.episodes)
    return s.drop("rid").withColumn("overall_confidence", round_to(F.col("overall_confidence"), 6))


@query("g3_best_chains_deep", f"SELECT client_id, target, hops, {r3('overall', 6)} AS overall FROM chains", chains("links", 10))
def g3d(x):
    return P.best_chains(x.links, 10, episodes=x.episodes).select("client_id", "target", "hops", round_to(F.col("overall"), 6).alias("overall"))


@query("g4_complete_chains", f"SELECT client_id, target, hops, {r3('overall', 6)} AS overall, array_to_string(path, '>') AS path FROM chains WHERE overall >= 0.1",
       chains("links", 5, "SELECT DISTINCT client_id, cause AS eid FROM links l WHERE NOT EXISTS (SELECT 1 FROM links u WHERE u.client_id = l.client_id AND u.effect = l.cause)"))
def g4(x):
    return P.best_chains(x.links, 5, from_roots=True, min_overall=0.1, episodes=x.episodes).select(
        "client_id", "target", "hops", round_to(F.col("overall"), 6).alias("overall"), F.array_join("path", ">").alias("path"))


@query("g5_event_blast_radius", f"SELECT client_id, root, eid, hops, {r3('product', 6)} AS product, first FROM reached WHERE (client_id, root) IN (SELECT (client_id, eid) FROM episodes WHERE severity = 'FATAL')".replace("(client_id, root) IN (SELECT (client_id, eid)", "(client_id || root) IN (SELECT client_id || eid"), REACH)
def g5(x):
    pairs = P.reach_pairs(x.links, x.episodes, 3, x.episodes.where("severity = 'FATAL'"))
    return pairs.withColumn("product", round_to(F.col("product"), 6))


@query("g6_blast_by_resource", "SELECT r.client_id, r.root, e.s_kind, e.s_ns, count(*) AS affected, min(e.t) AS first_impact, max(e.t) AS last_impact FROM reached r JOIN episodes e USING (client_id, eid) GROUP BY 1, 2, 3, 4", REACH)
def g6(x):
    return P.blast_by_resource(P.reach_pairs(x.links, x.episodes, 3, carry=("s_kind", "s_ns", "t")))


TYPED = {
    "ut": "SELECT client_id, src AS a, dst AS b, type FROM edges UNION SELECT client_id, dst, src, type FROM edges",
    "want": "SELECT DISTINCT client_id, c_rid, e_rid, hops FROM lk WHERE c_rid <> e_rid AND hops BETWEEN 1 AND 3",
    "typed": """SELECT client_id, c_rid, e_rid, min(types) AS types FROM (
      SELECT w.*, x.type AS types FROM want w JOIN ut x ON x.client_id = w.client_id AND x.a = c_rid AND x.b = e_rid WHERE hops = 1
      UNION ALL SELECT w.*, array_to_string(list_sort([x.type, y.type]), ',') FROM want w JOIN ut x ON x.client_id = w.client_id AND x.a = c_rid JOIN ut y ON y.client_id = w.client_id AND y.a = x.b AND y.b = e_rid WHERE hops = 2
      UNION ALL SELECT w.*, array_to_string(list_sort([x.type, y.type, z.type]), ',') FROM want w JOIN ut x ON x.client_id = w.client_id AND x.a = c_rid JOIN ut z ON z.client_id = w.client_id AND z.b = e_rid
        JOIN ut y ON y.client_id = w.client_id AND y.a = x.b AND y.b = z.a WHERE hops = 3) GROUP BY 1, 2, 3""",
}


@query("g7_cross_service_failures", "SELECT l.client_id, cause, effect, hops, confidence, types FROM lk l JOIN typed t ON t.client_id = l.client_id AND t.c_rid = l.c_rid AND t.e_rid = l.e_rid WHERE hops BETWEEN 1 AND 3", TYPED)
def g7(x):
    placed = x.episodes.select("client_id", "eid", "rid").join(P.typed_labels(x.edges), ["client_id", "rid"])
    named = L.named_links(x.links.where("hops BETWEEN 1 AND 3"), placed, ["rid", "spots"])
    return P.cross_service_failures(named, x.edges).select("client_id", "cause", "effect", "hops", "confidence", "types")


@query("g8_direct_cascades", "SELECT client_id, cause AS trigger, c_reason AS reason, count(*) AS cascade_count, count(DISTINCT e_rid) AS resources FROM lk WHERE c_sev IN ('ERROR','FATAL') AND e_t - c_t <= 900000000 GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def g8(x):
    return P.direct_cascades(x.named_links)


@query("g8_deep_cascades", "SELECT r.client_id, r.root AS trigger, t.reason, count(*) AS cascade_count, count(DISTINCT e.rid) AS resources FROM reached r JOIN episodes t ON t.client_id = r.client_id AND t.eid = r.root JOIN episodes e ON e.client_id = r.client_id AND e.eid = r.eid WHERE t.severity IN ('ERROR','FATAL') AND e.t - t.t <= 900000000 GROUP BY 1, 2, 3 HAVING count(*) >= 5", REACH)
def g8d(x):
    failures = x.episodes.where(is_failure(F.col("severity")))
    return P.deep_cascades(P.reach_pairs(x.links, x.episodes, 3, failures, carry=("rid", "t")), x.episodes)


@query("g9_chain_depths", "SELECT client_id, CAST(depth AS INTEGER) AS depth, CAST(sum(n) AS BIGINT) AS chains, count(*) AS ends FROM (SELECT *, 1 AS depth FROM n1 UNION ALL SELECT *, 2 FROM n2 UNION ALL SELECT *, 3 FROM n3 UNION ALL SELECT *, 4 FROM n4 UNION ALL SELECT *, 5 FROM n5) GROUP BY 1, 2",
       {"n1": "SELECT client_id, effect AS eid, count(*) AS n FROM links GROUP BY 1, 2",
        **{f"n{d}": f"SELECT l.client_id, l.effect AS eid, sum(p.n) AS n FROM n{d - 1} p JOIN links l ON l.client_id = p.client_id AND l.cause = p.eid GROUP BY 1, 2" for d in range(2, 6)}})
def g9(x):
    return P.chain_depths(x.links, 5)


@query("g10_reason_sequences", "SELECT a.client_id, a.c_reason AS a, a.e_reason AS b, b.e_reason AS c, count(*) AS occurrences FROM lk a JOIN lk b ON a.client_id = b.client_id AND a.effect = b.cause GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3")
def g10(x):
    return P.reason_sequences(x.named_links)


@query("g11_causal_search", f"SELECT c.client_id, c.target, e.reason, hops, {r3('overall', 6)} AS overall, array_to_string(path, '>') AS path FROM chains c JOIN episodes e ON e.client_id = c.client_id AND e.eid = c.target WHERE contains(lower(e.reason), 'failed')",
       {"strong": "SELECT * FROM links WHERE confidence >= 0.5", **chains("strong", 3)})
def g11(x):
    return P.causal_search(x.links, x.episodes, "failed").select("client_id", "target", "reason", "hops", round_to(F.col("overall"), 6).alias("overall"), F.array_join("path", ">").alias("path"))


CARDS = f"""SELECT e.client_id, e.eid, e.rid, coalesce(c.n, 0) AS causes, coalesce(c.top_cause, '') AS top_cause, coalesce(c.top, 0) AS top_confidence, coalesce(nb.n, 0) AS neighbours, e.timeline_events, coalesce(m.incident_id, '') AS incident_id,
    CASE WHEN contains(low, 'oom') THEN 'Increase memory limits' WHEN contains(low, 'crash') OR contains(low, 'backoff') THEN 'Investigate application logs' WHEN contains(low, 'image') OR contains(low, 'pull') THEN 'Verify image configuration' ELSE 'Review event details' END AS action
  FROM (SELECT *, lower(reason) AS low, count(*) OVER (PARTITION BY client_id, rid ORDER BY t RANGE BETWEEN 1800000000 PRECEDING AND 1800000000 FOLLOWING) AS timeline_events FROM episodes) e
  LEFT JOIN (SELECT client_id, effect, count(*) AS n, max({{'a': confidence, 'cause': cause}}).cause AS top_cause, max(confidence) AS top FROM links WHERE confidence >= 0.5 GROUP BY 1, 2) c ON c.client_id = e.client_id AND c.effect = e.eid
  LEFT JOIN (SELECT client_id, a, count(*) AS n FROM undirected GROUP BY 1, 2) nb ON nb.client_id = e.client_id AND nb.a = e.rid
  LEFT JOIN incident_members m ON m.client_id = e.client_id AND m.eid = e.eid WHERE e.severity IN ('ERROR','FATAL')"""


@query("g12_rca_cards", "SELECT * FROM cards", {"cards": CARDS})
def g12(x):
    return P.rca_cards(x.episodes, x.links, x.edges, x.incident_members).drop("action_confidence", "priority")


@query("g12_rca_related", """SELECT client_id, rid, related, CAST(min(h) AS INTEGER) AS hops FROM (
    SELECT client_id, a AS rid, b AS related, 1 AS h FROM undirected
    UNION ALL SELECT DISTINCT x.client_id, x.a, y.b, 2 FROM undirected x JOIN undirected y ON x.client_id = y.client_id AND x.b = y.a)
  WHERE rid <> related AND (client_id, rid) IN (SELECT (client_id, rid) FROM episodes WHERE severity IN ('ERROR','FATAL')) GROUP BY 1, 2, 3""")
def g12_related(x):
    return P.rca_related(x.episodes, x.edges, 2)


@query("g12_rca_causes", """SELECT client_id, effect AS eid, cause, c_rid AS cause_rid, hops, confidence FROM lk
  WHERE e_sev IN ('ERROR','FATAL') AND confidence >= 0.5 AND hops <= 2 AND (hops > 0 OR c_rid = e_rid)""")
def g12_causes(x):
    return P.rca_causes(x.episodes, x.links, max_hops=2)


@query("g13_rca_by_resource", "SELECT client_id, rid, count(*) AS failures, CAST(sum(causes) AS BIGINT) AS causes, max(top_confidence) AS best_confidence, count(DISTINCT nullif(incident_id, '')) AS incidents FROM cards GROUP BY 1, 2", {"cards": CARDS})
def g13(x):
    return P.rca_by_resource(P.rca_cards(x.episodes, x.links, x.edges, x.incident_members))


@query("g14_root_impact", "SELECT r.client_id, r.root, count(*) AS impact FROM reached r WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.client_id = r.client_id AND l.effect = r.root) GROUP BY 1, 2 HAVING count(*) > 3", REACH)
def g14(x):
    return P.reach_pairs(x.links, x.episodes, 3, P.true_roots(x.links)).groupBy("client_id", "root").agg(F.count("*").alias("impact")).where("impact > 3")


@query("g15_sibling_impact", """SELECT a.client_id, a.deployment, a.eid, count(*) AS sibling_events, count(DISTINCT b.rid) AS sibling_pods FROM placed a JOIN placed b ON a.client_id = b.client_id AND a.deployment = b.deployment AND a.rid <> b.rid
    AND b.t > a.t AND b.t <= a.t + 1800000000 WHERE a.severity IN ('ERROR','FATAL') GROUP BY 1, 2, 3""",
       {"placed": "SELECT e.*, 'deployment:' || ns || ':' || deploy AS deployment FROM episodes e JOIN pods p ON p.client_id = e.client_id AND e.rid = 'pod:' || p.ns || ':' || p.name"})
def g15(x):
    return P.sibling_impact(x.episodes, x.edges, 1800)


@query("g16_trigger_cascades", """SELECT e.client_id, e.eid, own - 1 AS own_events, coalesce(n.near_events, 0) AS near_events, CAST(coalesce(n.nearest, 0) AS INTEGER) AS nearest
  FROM (SELECT *, count(*) OVER (PARTITION BY client_id, rid ORDER BY t RANGE BETWEEN CURRENT ROW AND 900000000 FOLLOWING) AS own FROM episodes) e LEFT JOIN (
    SELECT c.client_id, c.eid, count(*) AS near_events, min(n.hops) AS nearest FROM episodes c JOIN episodes e ON c.client_id = e.client_id AND e.t > c.t AND e.t <= c.t + 900000000
    JOIN near n ON n.client_id = c.client_id AND n.a = c.rid AND n.b = e.rid GROUP BY 1, 2) n ON n.client_id = e.client_id AND n.eid = e.eid WHERE e.severity IN ('ERROR','FATAL')""")
def g16(x):
    return P.trigger_cascades(x.episodes, x.edges, 15)


@query("g17_failure_context", """SELECT e.client_id, e.eid, e.rid, around, error_logs, 1::BIGINT AS services, 'node::' || p.node AS node_rid, 2::BIGINT AS owners FROM (
    SELECT *, count(*) OVER (PARTITION BY client_id, rid ORDER BY t RANGE BETWEEN 600000000 PRECEDING AND 300000000 FOLLOWING) AS around,
      count(*) FILTER (etype = 'k8s.log' AND severity IN ('ERROR','FATAL')) OVER (PARTITION BY client_id, rid ORDER BY t RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS error_logs
    FROM episodes WHERE s_kind = 'Pod') e JOIN pods p ON p.client_id = e.client_id AND e.rid = 'pod:' || p.ns || ':' || p.name WHERE e.severity IN ('ERROR','FATAL')""")
def g17(x):
    return P.failure_context(x.episodes, x.edges)
