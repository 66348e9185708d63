"""Named queries for topology (T rows)."""

from pyspark.sql import functions as F

from causalspark.operators import reach, topology as T
from causalspark.plans.registry import query
from causalspark.session import cut_lineage


def _selectors(x):
    """Services of the sample (one label) plus one per (app, team) with a two-label selector."""
    one = x.resources.where("kind = 'Service'").select(
        "client_id", "ns", "rid", F.create_map(F.lit("app"), F.col("app")).alias("selector"))
    pods = x.resources.where("kind = 'Pod'")
    two = pods.select("client_id", "ns", "app", "team").distinct().select(
        "client_id", "ns", F.concat_ws(":", F.lit("service"), "ns", F.concat_ws("-", F.lit("svc"), "app", "team")).alias("rid"),
        F.create_map(F.lit("app"), F.col("app"), F.lit("team"), F.col("team")).alias("selector"))
    labelled = pods.select("client_id", "ns", "rid", F.create_map(
        F.lit("app"), F.col("app"), F.lit("team"), F.col("team")).alias("labels"))
    return one.unionByName(two), labelled


SELECTED = """SELECT client_id, 'service:' || ns || ':svc-' || app AS src, 'pod:' || ns || ':' || name AS dst FROM pods
  UNION ALL SELECT client_id, 'service:' || ns || ':svc-' || app || '-' || team, 'pod:' || ns || ':' || name FROM pods"""


@query("t1_selects_by_labels", SELECTED)
def t1(x):
    return T.selects_by_labels(*_selectors(x)).select("client_id", "src", "dst")


def _short_services(x):
    return x.resources.where("kind = 'Pod'").select("client_id", "ns", F.substring("name", 1, 5).alias("name")).distinct().withColumn(
        "rid", F.concat(F.lit("service:"), "ns", F.lit(":"), "name"))


@query("t2_selects_by_name", """SELECT s.client_id, s.rid AS src, p.rid AS dst FROM (
    SELECT DISTINCT client_id, ns, substr(name, 1, 5) AS name, 'service:' || ns || ':' || substr(name, 1, 5) AS rid FROM pods) s
  JOIN resources p ON p.kind = 'Pod' AND p.client_id = s.client_id AND p.ns = s.ns AND contains(p.name, s.name)""")
def t2(x):
    return T.selects_by_name(_short_services(x), x.resources.where("kind = 'Pod'")).select("client_id", "src", "dst")


@query("t3_edge_diff", """SELECT client_id, src, dst, 'UPSERT' AS op FROM (SELECT client_id, 'service:' || ns || ':svc-' || app || '-' || team AS src, 'pod:' || ns || ':' || name AS dst FROM pods)
  UNION ALL SELECT client_id, src, dst, 'DELETE' FROM edges WHERE type IN ('CONTROLS', 'RUNS_ON')""")
def t3(x):
    return T.edge_diff(x.edges, T.selects_by_labels(*_selectors(x))).select("client_id", "src", "dst", "op")


@query("t4_runs_on", "SELECT client_id, src, dst FROM edges WHERE type = 'RUNS_ON'")
def t4(x):
    return T.runs_on(x.resources.where("kind = 'Pod'")).select("client_id", "src", "dst")


@query("t5_controls_by_owner", "SELECT client_id, src, dst, id FROM edges WHERE type = 'CONTROLS'")
def t5(x):
    return T.controls_by_owner(x.resources).select("client_id", "src", "dst", "id")


@query("t6_controls_by_prefix", """SELECT d.client_id, d.rid AS src, r.rid AS dst FROM (
    SELECT DISTINCT client_id, ns, substr(rs, 1, 4) AS name, 'deployment:' || ns || ':' || substr(rs, 1, 4) AS rid FROM pods) d
  JOIN resources r ON r.kind = 'ReplicaSet' AND r.client_id = d.client_id AND r.ns = d.ns AND starts_with(r.name, d.name)""")
def t6(x):
    rs = x.resources.where("kind = 'ReplicaSet'")
    owners = rs.select("client_id", "ns", F.substring("name", 1, 4).alias("name")).distinct().withColumn(
        "rid", F.concat(F.lit("deployment:"), "ns", F.lit(":"), "name"))
    return T.controls_by_prefix(owners, rs).select("client_id", "src", "dst")


@query("t7_controller_changes", """SELECT client_id, 'edge:' || prev || '->' || rid AS id, at_us AS t, offset_ AS change FROM (
    SELECT *, lag(image) OVER (PARTITION BY client_id, rid ORDER BY at_us, offset_) AS prev FROM resource_changes) WHERE prev <> image""")
def t7(x):
    log = x.resource_changes.select("client_id", "rid", F.col("at").alias("t"), "offset", F.col("image").alias("controller"))
    return T.controller_changes(log).select("client_id", "id", "t", F.col("offset").alias("change"))


@query("t8_endpoint_pods", "SELECT client_id, src, dst FROM edges WHERE type = 'SELECTS'")
def t8(x):
    """One endpoint record per (service, node), unfolded again."""
    subset = T.service_map(x.edges).groupBy("client_id", "service", "node").agg(
        F.collect_list(F.struct(F.lit("Pod").alias("kind"),
                                F.substring_index("pod", ":", -1).alias("name"))).alias("targets"))
    parts = F.split("service", ":")
    return T.endpoint_pods(subset.select(
        "client_id", parts[1].alias("ns"), parts[2].alias("name"),
        F.array(F.struct("targets")).alias("subsets")))


@query("t9_dependencies_from_env", f"""SELECT DISTINCT e.client_id, e.src, e.dst, 0.7::DOUBLE AS confidence FROM (
    SELECT 't' AS client_id, 'page-' || CAST(page_id % 7 AS STRING) AS src, regexp_extract(url, 'https?://([^:/]*)', 1) AS dst FROM pages) e
  WHERE dst <> '' AND NOT starts_with(dst, 'localhost') AND dst IN (SELECT h FROM (SELECT regexp_extract(url, 'https?://([^:/]*)', 1) AS h FROM pages) GROUP BY h HAVING count(*) >= 2)""")
def t9(x):
    """Page addresses as environment values; hosts seen at least twice are known services."""
    env = x.raw("pages").select(F.lit("t").alias("client_id"),
                                F.concat(F.lit("page-"), (F.col("page_id") % 7).cast("string")).alias("service"),
                                F.lit("UPSTREAM_URL").alias("name"), F.col("url").alias("value"))
    known = env.groupBy("client_id", F.regexp_extract("value", r"https?://([^:/]*)", 1).alias("service")
                        ).count().where("count >= 2")
    return T.dependencies_from_env(env, known).drop("type")


@query("t10_topology_totals", """SELECT client_id, kind AS item, count(*) AS n, 'node' AS part FROM resources GROUP BY 1, 2
  UNION ALL SELECT client_id, type, count(*), 'edge' FROM edges GROUP BY 1, 2""")
def t10(x):
    return T.snapshot_totals(x.resources, x.edges)


@query("t11_topology_all_tenants", f"""SELECT client_id, src, dst, type FROM edges""")
def t11(x):
    """All edge builders in one pass over every tenant."""
    services, pods = _selectors(x)
    built = (T.selects_by_labels(services, pods)
             .join(x.resources.select("client_id", F.col("rid").alias("src")), ["client_id", "src"], "left_semi")
             .unionByName(T.runs_on(x.resources.where("kind = 'Pod'"))).unionByName(T.controls_by_owner(x.resources)))
    return built.select("client_id", "src", "dst", "type")


@query("t12_repair_tenant", """SELECT client_id, verdict, count(*) AS n FROM (
    SELECT s.client_id, CASE WHEN d.client_id IS NULL THEN 'missing end' WHEN s.client_id <> d.client_id THEN 'cross tenant' ELSE 'ok' END AS verdict
    FROM edges e JOIN resources s ON s.client_id = e.client_id AND s.rid = e.src
    LEFT JOIN resources d ON d.rid = e.dst AND d.client_id = CASE WHEN e.type = 'RUNS_ON' THEN 'tenant-0' ELSE e.client_id END) GROUP BY ALL""")
def t12(x):
    """Edges without tenant; RUNS_ON edges wrongly point at the nodes of one tenant."""
    broken = x.edges.select(
        F.lit(None).cast("string").alias("client_id"), F.concat_ws("::", "client_id", "src").alias("src_key"),
        F.concat_ws("::", F.when(F.col("type") == "RUNS_ON", "tenant-0").otherwise(F.col("client_id")), "dst").alias("dst_key"))
    return T.repair_tenant(broken, x.resources).groupBy("client_id", "verdict").agg(F.count("*").alias("n"))


@query("t12_coverage_by_topology", "SELECT client_id, hops, count(*) AS links FROM links GROUP BY 1, 2")
def t12c(x):
    return T.coverage_by_topology(x.links)


@query("t13_hops", """SELECT DISTINCT l.client_id, c_rid AS src, e_rid AS dst, CAST(n.hops AS INTEGER) AS hops
  FROM lk l JOIN near n ON n.client_id = l.client_id AND n.a = c_rid AND n.b = e_rid""")
def t13(x):
    """Distance of the resource pairs that are causally linked."""
    pairs = x.named_links.select("client_id", F.col("c_rid").alias("src"), F.col("e_rid").alias("dst"))
    return reach.hops(pairs, x.edges)


NEIGHBOURS = """SELECT r.client_id, r.rid AS root, n.b AS node, n.hops AS depth FROM resources r JOIN near n ON n.client_id = r.client_id AND n.a = r.rid WHERE r.kind = 'Deployment'"""


@query("t14_neighbourhood", f"SELECT client_id, root, node, CAST(depth AS INTEGER) AS depth FROM ({NEIGHBOURS}) UNION ALL SELECT client_id, rid, rid, 0 FROM resources WHERE kind = 'Deployment'")
def t14(x):
    roots = x.resources.where("kind = 'Deployment'").select("client_id", F.col("rid").alias("root"))
    return T.neighbourhood(roots, x.edges, 3)


@query("t14_neighbour_relations", """SELECT f.client_id, f.root, f.node, CAST(f.depth AS INTEGER) AS depth, array_to_string(list_sort(list_distinct(list(s.relation))), ',') AS relations
  FROM found f JOIN steps s ON s.client_id = f.client_id AND s.b = f.node JOIN found p ON p.client_id = f.client_id AND p.root = f.root AND p.node = s.a AND p.depth = f.depth - 1 GROUP BY 1, 2, 3, 4""",
       {"found": f"SELECT client_id, root, node, depth FROM ({NEIGHBOURS}) UNION ALL SELECT client_id, rid, rid, 0 FROM resources WHERE kind = 'Deployment'",
        "steps": "SELECT client_id, src AS a, dst AS b, type || ':out' AS relation FROM edges UNION ALL SELECT client_id, dst, src, type || ':in' FROM edges"})
def t14r(x):
    roots = x.resources.where("kind = 'Deployment'").select("client_id", F.col("rid").alias("root"))
    return T.neighbour_relations(T.neighbourhood(roots, x.edges, 3), x.edges)


@query("t15_resource_blast_radius", f"""SELECT n.client_id, n.root, n.node, CAST(n.depth AS INTEGER) AS depth, coalesce(c.errors, 0) AS errors,
    CASE WHEN coalesce(c.errors, 0) > 10 THEN 'high' WHEN coalesce(c.errors, 0) > 0 THEN 'medium' ELSE 'low' END AS impact
  FROM ({NEIGHBOURS}) n LEFT JOIN (SELECT client_id, rid, count(*) AS errors FROM episodes, clock WHERE severity IN ('ERROR','FATAL') AND t >= now - 864000000000 GROUP BY 1, 2) c
  ON c.client_id = n.client_id AND c.rid = n.node""")
def t15(x):
    roots = x.resources.where("kind = 'Deployment'").select("client_id", F.col("rid").alias("root"))
    return T.resource_blast_radius(roots, x.edges, x.episodes, 3, hours=240)


@query("t16_flow_blast_radius", """SELECT client_id, root, node, CAST(min(d) AS INTEGER) AS depth FROM (
    SELECT DISTINCT client_id, src AS root, src AS node, 0 AS d FROM service_flows UNION ALL SELECT client_id, src, dst, 1 FROM service_flows
    UNION ALL SELECT a.client_id, a.src, b.dst, 2 FROM service_flows a JOIN service_flows b ON a.client_id = b.client_id AND a.dst = b.src) GROUP BY 1, 2, 3""")
def t16_flows(x):
    flows = cut_lineage(x.service_flows)
    return T.dependency_blast_radius(flows, flows.select("client_id", F.col("src").alias("service")).distinct())


@query("t17_service_map", """SELECT client_id, 'service:' || ns || ':svc-' || app AS service, 'pod:' || ns || ':' || name AS pod, 'node::' || node AS node,
    'replicaset:' || ns || ':' || rs AS controller FROM pods""")
def t17(x):
    return T.service_map(x.edges)


@query("t18_path_counts", """SELECT client_id, 1 AS hops, count(*) AS paths FROM undirected GROUP BY 1
  UNION ALL SELECT x.client_id, 2, count(*) FROM undirected x JOIN undirected y ON x.client_id = y.client_id AND x.b = y.a AND x.a <> y.b GROUP BY 1
  UNION ALL SELECT x.client_id, 3, count(*) FROM undirected x JOIN undirected y ON x.client_id = y.client_id AND x.b = y.a AND x.a <> y.b
    JOIN undirected z ON z.client_id = y.client_id AND z.a = y.b AND z.b <> y.a GROUP BY 1""")
def t18(x):
    return T.path_counts(x.edges)


@query("t19_orphans", """SELECT client_id, rid, kind, 'events' AS missing FROM resources r WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.client_id = r.client_id AND e.rid = r.rid)
  UNION ALL SELECT client_id, rid, kind, 'edges' FROM resources r WHERE NOT EXISTS (SELECT 1 FROM undirected u WHERE u.client_id = r.client_id AND u.a = r.rid)
  UNION ALL SELECT client_id, rid, kind, 'replica set' FROM resources r WHERE kind = 'Deployment' AND NOT EXISTS (SELECT 1 FROM edges u WHERE u.client_id = r.client_id AND u.src = r.rid)
  UNION ALL SELECT client_id, rid, kind, 'pods' FROM resources r WHERE kind = 'Service' AND NOT EXISTS (SELECT 1 FROM edges u WHERE u.client_id = r.client_id AND u.src = r.rid)""")
def t19(x):
    return T.orphans(x.resources, x.edges, x.episodes)


@query("t20_flow_cycle_counts", """SELECT client_id, v AS service, CAST(2 AS INTEGER) AS length, CAST(count(*) AS BIGINT) AS cycles FROM mutual GROUP BY 1, 2
  UNION ALL SELECT f.client_id, f.dst, 3, CAST(sum(n) AS BIGINT) FROM service_flows f JOIN two ON two.client_id = f.client_id AND two.a = f.dst AND two.b = f.src GROUP BY 1, 2
  UNION ALL SELECT * FROM c4 WHERE cycles > 0 UNION ALL SELECT * FROM c5 WHERE cycles > 0""",
       {"mutual": "SELECT x.client_id, x.src AS v, x.dst AS w FROM service_flows x JOIN service_flows y ON x.client_id = y.client_id AND x.src = y.dst AND x.dst = y.src",
        "two": "SELECT x.client_id, x.src AS a, y.dst AS b, count(*) AS n, list(x.dst) AS mids FROM service_flows x JOIN service_flows y ON x.client_id = y.client_id AND x.dst = y.src GROUP BY 1, 2, 3",
        "c4": """SELECT p.client_id, p.a AS service, 4 AS length, CAST(sum(p.n * q.n - len(list_intersect(p.mids, q.mids))) AS BIGINT) AS cycles FROM two p JOIN two q
          ON p.client_id = q.client_id AND p.a = q.b AND p.b = q.a WHERE p.a <> p.b GROUP BY 1, 2""",
        "c5": """SELECT p.client_id, p.a AS service, 5 AS length, CAST(sum(len(list_filter(p.mids, lambda m: m <> f.dst)) * len(list_filter(q.mids, lambda m: m <> f.src))
            - len(list_intersect(p.mids, q.mids))) AS BIGINT) AS cycles FROM two p JOIN service_flows f ON f.client_id = p.client_id AND f.src = p.b
          JOIN two q ON q.client_id = p.client_id AND q.a = f.dst AND q.b = p.a WHERE p.a <> p.b AND f.dst <> p.a GROUP BY 1, 2"""})
def t20_flows(x):
    return T.dependency_cycle_counts(x.service_flows)


@query("t21_node_failure_impact", "SELECT client_id, 'node::' || node AS node, count(DISTINCT ns || name) AS pods, count(DISTINCT ns || app) AS services FROM pods GROUP BY 1, 2")
def t21(x):
    return T.node_failure_impact(x.edges)


@query("t22_used_by", """SELECT r.client_id, r.rid, count(DISTINCT e.src) AS users FROM resources r LEFT JOIN edges e ON e.client_id = r.client_id AND e.dst = r.rid AND e.type = 'RUNS_ON' WHERE r.kind = 'Node' GROUP BY 1, 2
  UNION ALL SELECT r.client_id, r.rid, count(DISTINCT e.src) FROM resources r LEFT JOIN edges e ON e.client_id = r.client_id AND e.dst = r.rid AND e.type = 'CONTROLS' WHERE r.kind = 'Service' GROUP BY 1, 2""")
def t22(x):
    return T.used_by(x.resources, x.edges, "Node", "RUNS_ON").unionByName(
        T.used_by(x.resources, x.edges, "Service", "CONTROLS"))


@query("t23_related_services", f"""SELECT a.client_id, a.src AS service, b.src AS other, count(*) AS shared_pods FROM ({SELECTED}) a JOIN ({SELECTED}) b
  ON a.client_id = b.client_id AND a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2, 3""")
def t23(x):
    return T.related_services(T.selects_by_labels(*_selectors(x)))
