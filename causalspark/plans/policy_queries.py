"""Named queries for policies, storage, configuration and ingresses (T21, T22)."""

from pyspark.sql import functions as F

from causalspark.functions.scalar import round_to
from causalspark.operators import policies as P
from causalspark.plans.registry import query
from causalspark.plans.sqltables import r3
from causalspark.sources import testmap as m


def _pods(x):
    """Pods with labels, configuration references, security context and claims, all from the user number."""
    labels = F.map_filter(F.create_map(F.lit("app"), F.col("app"), F.lit("team"), F.col("team"), F.lit("phase"), F.col("phase"),
                                       F.lit("canary"), F.when(F.col("u") % 6 == 0, "yes")), lambda _, v: v.isNotNull())
    ref = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    refs = F.array(ref("ConfigMap", F.concat(F.lit("cfg-"), "app")), ref("Secret", F.when(F.col("u") % 2 == 0, F.concat(F.lit("sec-"), "team"))))
    return x.pods.withColumn("rid", F.concat(F.lit("pod:"), "ns", F.lit(":"), "name")).withColumns({
        "labels": labels, "refs": refs, "privileged": F.col("u") % 11 == 0,
        "run_as_user": F.when(F.col("u") % 3 != 0, F.col("u") % 13)})


def _policies(x):
    """Five policies per namespace and app, one for each form of selector."""
    apps = x.pods.select("client_id", "ns", "app").distinct()
    app, lit, need = F.col("app"), F.lit, P.requirement
    forms = {
        "a": F.array(need(lit("app"), "In", app), need(lit("team"), "NotIn", lit("team-0"), lit("team-2"))),
        "b": F.array(need(lit("team"), "Exists"), need(lit("canary"), "DoesNotExist")),
        "c": F.array(need(lit("app"), "NotIn", app)),
        "d": F.array().cast("array<struct<key:string,operator:string,values:array<string>>>"),
        "e": F.concat(P.from_labels(F.create_map(lit("app"), app)), F.array(need(lit("phase"), "In", lit("Running"), lit("Pending"))))}
    rows = None
    for form, requirements in forms.items():
        ways = F.array(lit("Ingress"), lit("Egress")) if form in "ae" else F.array(lit("Egress" if form == "c" else "Ingress"))
        part = apps.select("client_id", "ns", F.concat(lit(f"networkpolicy:{form}-"), app).alias("rid"), requirements.alias("requirements"), ways.alias("directions"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


FORMS = {"policies": """SELECT client_id, ns, app, form, 'networkpolicy:' || form || '-' || app AS src
    FROM (SELECT DISTINCT client_id, ns, app FROM pods) CROSS JOIN (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS form)""",
    "taken": """SELECT s.client_id, s.ns, s.src, s.form, 'pod:' || p.ns || ':' || p.name AS dst FROM policies s JOIN pods p ON p.client_id = s.client_id AND p.ns = s.ns
    WHERE CASE s.form WHEN 'a' THEN p.app = s.app AND p.team NOT IN ('team-0', 'team-2') WHEN 'b' THEN p.u % 6 <> 0 WHEN 'c' THEN p.app <> s.app
      WHEN 'd' THEN TRUE ELSE p.app = s.app AND p.phase IN ('Running', 'Pending') END"""}


@query("t22_selector_expressions", "SELECT client_id, ns, src, dst FROM taken", FORMS)
def t22_selectors(x):
    return P.selected(_policies(x), _pods(x))


@query("t22_selector_counts", "SELECT s.client_id, s.ns, s.src, count(t.dst) AS pods FROM policies s LEFT JOIN taken t USING (client_id, ns, src) GROUP BY 1, 2, 3", FORMS)
def t22_counts(x):
    return P.selected_counts(_policies(x), _pods(x))


@query("t22_pod_isolation", """SELECT p.client_id, p.ns, 'pod:' || p.ns || ':' || p.name AS rid, count(*) FILTER (t.form <> 'c') AS ingress, count(*) FILTER (t.form IN ('a', 'c', 'e')) AS egress
  FROM pods p LEFT JOIN taken t ON t.client_id = p.client_id AND t.dst = 'pod:' || p.ns || ':' || p.name GROUP BY 1, 2, 3""", FORMS)
def t22_isolation(x):
    return P.pod_isolation(_policies(x), _pods(x))


CLAIMS = {"vols": f"""SELECT {m.TENANT} AS client_id, 'pv-' || CAST(u AS STRING) AS volume, CASE WHEN u % 4 <> 0 THEN u END AS claimed, u % 9 = 0 AS other, size
    FROM (SELECT p_partkey AS u, CAST(p_size AS BIGINT) AS size FROM part)""",
    "asks": "SELECT *, 'data-' || CAST(u AS STRING) AS claim, CASE WHEN u % 5 <> 0 THEN 'pv-' || CAST(u AS STRING) END AS volume FROM pods WHERE u % 3 <> 0"}


@query("t22_claim_bindings", """SELECT a.client_id, a.ns, a.claim, a.volume, CASE WHEN a.volume IS NULL THEN 'Pending' WHEN v.volume IS NULL THEN 'Lost' WHEN v.claimed IS NOT NULL AND NOT v.other THEN 'Bound' ELSE 'Mismatched' END AS state,
    v.size AS capacity, CAST(CASE WHEN a.u % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pods FROM asks a LEFT JOIN vols v ON v.client_id = a.client_id AND v.volume = a.volume
  UNION ALL SELECT v.client_id, '', NULL, v.volume, CASE WHEN v.claimed IS NULL THEN 'Available' WHEN v.other OR k.u IS NULL THEN 'Released' ELSE 'Reserved' END, v.size, 0
    FROM vols v LEFT JOIN asks k ON k.u = v.claimed WHERE NOT EXISTS (SELECT 1 FROM asks a WHERE a.client_id = v.client_id AND a.volume = v.volume)""", CLAIMS)
def t22_claims(x):
    """Claims of two pods of three; volumes from the parts, a ninth of them held for a namespace that is not there."""
    own = _pods(x).where("u % 3 <> 0").withColumn("claim", F.expr("'data-' || CAST(u AS STRING)"))
    claims = own.select("client_id", "ns", F.col("claim").alias("name"), F.expr("CASE WHEN u % 5 <> 0 THEN 'pv-' || CAST(u AS STRING) END").alias("volume"))
    mounts = own.where("u % 2 = 0").select("client_id", "ns", F.col("name").alias("pod"), "claim")
    volumes = x.raw("part").select(F.col("p_partkey").alias("u"), F.col("p_size").cast("long").alias("capacity")).select(
        F.expr(m.TENANT).alias("client_id"), F.expr("'pv-' || CAST(u AS STRING)").alias("name"), "capacity",
        F.expr(f"CASE WHEN u % 9 = 0 THEN 'gone' ELSE {m.NAMESPACE} END").alias("claim_ns"),
        F.expr("CASE WHEN u % 4 <> 0 THEN 'data-' || CAST(u AS STRING) END").alias("claim_name"))
    return P.claim_bindings(claims, volumes, mounts)


def _configs(x):
    pods = x.pods
    have = lambda kind, name: pods.select("client_id", "ns", F.lit(kind).alias("kind"), F.expr(name).alias("name")).distinct()
    return have("ConfigMap", "'cfg-' || app").unionByName(have("ConfigMap", "'cfg-unused'")).unionByName(have("Secret", "'sec-team-0'"))


@query("t22_config_usage", """SELECT client_id, ns, 'ConfigMap' AS kind, 'cfg-' || app AS name, count(*) AS users, 'used' AS state FROM pods GROUP BY client_id, ns, app
  UNION ALL SELECT DISTINCT client_id, ns, 'ConfigMap', 'cfg-unused', 0, 'unused' FROM pods
  UNION ALL SELECT client_id, ns, 'Secret', 'sec-' || team, count(*), 'missing' FROM pods WHERE u % 2 = 0 AND team <> 'team-0' GROUP BY client_id, ns, team
  UNION ALL SELECT client_id, ns, 'Secret', 'sec-team-0', count(*) FILTER (team = 'team-0'), CASE WHEN count(*) FILTER (team = 'team-0') > 0 THEN 'used' ELSE 'unused' END FROM pods GROUP BY client_id, ns""")
def t22_configs(x):
    return P.config_usage(_pods(x), _configs(x))


@query("t22_config_users", """SELECT client_id, ns, 'ConfigMap' AS kind, 'cfg-' || app AS name, 'pod:' || ns || ':' || name AS rid FROM pods
  UNION ALL SELECT client_id, ns, 'Secret', 'sec-' || team, 'pod:' || ns || ':' || name FROM pods WHERE u % 2 = 0""")
def t22_users(x):
    return P.config_users(_pods(x))


@query("t22_quota_usage", """SELECT q.client_id, q.ns, q.kind, hard, used, CASE WHEN used > hard THEN 'exceeded' WHEN used = hard THEN 'full' WHEN used >= hard * CAST(0.8 AS DOUBLE) THEN 'near' ELSE 'ok' END AS state FROM (
    SELECT client_id, ns, kind, hard, (SELECT count(*) FROM resources r WHERE r.client_id = q.client_id AND r.ns = q.ns AND r.kind = q.kind) AS used FROM (
      SELECT DISTINCT client_id, ns, kind, CAST(CASE kind WHEN 'Pod' THEN 7 * (1 + ascii(right(ns, 1)) - 48) WHEN 'Service' THEN 5 ELSE 9 END AS BIGINT) AS hard FROM (
        SELECT client_id, ns, unnest(['Pod', 'Service', 'Job']) AS kind FROM pods)) q) q""")
def t22_quotas(x):
    hard = F.expr("CASE kind WHEN 'Pod' THEN 7 * (1 + ascii(right(ns, 1)) - 48) WHEN 'Service' THEN 5 ELSE 9 END").cast("long")
    quotas = x.pods.select("client_id", "ns", F.explode(F.array(*[F.lit(k) for k in ("Pod", "Service", "Job")])).alias("kind")).distinct().withColumn("hard", hard)
    return P.quota_usage(quotas, x.resources)


@query("t22_privileged_pods", """SELECT client_id, ns, name, CASE WHEN u % 11 = 0 AND u % 3 <> 0 AND u % 13 = 0 THEN 'privileged, runs as root' WHEN u % 11 = 0 THEN 'privileged' ELSE 'runs as root' END AS findings
  FROM pods WHERE u % 11 = 0 OR (u % 3 <> 0 AND u % 13 = 0)""")
def t22_privileged(x):
    return P.privileged_pods(_pods(x)).select("client_id", "ns", "name", "findings")


ROUTES = {"routes": "SELECT DISTINCT client_id, 'ingress:' || ns || ':ing-' || team AS ingress, 'service:' || ns || ':svc-' || app AS service FROM pods",
          "backed": "SELECT client_id, 'service:' || ns || ':svc-' || app AS service, 'node::' || node AS node, name FROM pods",
          "hit": """SELECT b.client_id, b.node, b.service, count(*) AS lost, (SELECT count(*) FROM backed a WHERE a.client_id = b.client_id AND a.service = b.service) AS every FROM backed b GROUP BY 1, 2, 3"""}


@query("t21_node_failure_reach", f"""SELECT client_id, 'node::' || node AS node, 'Pod' AS kind, 'pod:' || ns || ':' || name AS rid, CAST(1 AS DOUBLE) AS share FROM pods
  UNION ALL SELECT client_id, node, 'Service', service, {r3('lost / CAST(every AS DOUBLE)', 6)} FROM hit
  UNION ALL SELECT h.client_id, h.node, 'Ingress', r.ingress, {r3('count(*) FILTER (lost = every) / CAST((SELECT count(*) FROM routes a WHERE a.client_id = h.client_id AND a.ingress = r.ingress) AS DOUBLE)', 6)}
    FROM hit h JOIN routes r ON r.client_id = h.client_id AND r.service = h.service GROUP BY h.client_id, h.node, r.ingress""", ROUTES)
def t21_reach(x):
    """An ingress per namespace and team, before the services that the team's pods belong to."""
    ingresses = x.pods.groupBy("client_id", "ns", F.concat(F.lit("ingress:"), "ns", F.lit(":ing-"), "team").alias("rid")).agg(
        F.collect_set(F.concat(F.lit("svc-"), "app")).alias("backends"))
    edges = x.edges.select("client_id", "src", "dst", "type", "id").unionByName(P.ingress_routes(ingresses))
    return P.node_failure_reach(edges).withColumn("share", round_to(F.col("share"), 6))
