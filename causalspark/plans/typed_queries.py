"""Named queries over typed state topics (S1): records in, merged state out.

The records come from the sample with every form a producer may send: the tenant in the key or in the payload, deletes in
any case, tombstones, values that cannot be read, ids made of the key or of the payload.
"""

from pyspark.sql import functions as F

from causalspark import schemas
from causalspark.operators import state as S
from causalspark.plans.registry import query
from causalspark.session import shared_folder
from causalspark.sources import topics, typed

START, LATER = "2024-01-01T00:00:00Z", "2024-01-02T00:00:00.5Z"
LATER_US = 1704153600500000
_DONE: dict = {}


def _records(x, topic):
    """The records of a topic, written as JSON files once per session and read back."""
    key = (x.spark.sparkContext.applicationId, x.directory)
    path = f"{shared_folder(x.spark)}/state-topics/{''.join(c if c.isalnum() else '_' for c in x.directory)}"
    if key not in _DONE:
        rows = None
        for part in (_resource_records(x), _edge_records(x), _target_records(x), _rule_records(x)):
            rows = part if rows is None else rows.unionByName(part)
        rows.write.mode("overwrite").json(path)
        _DONE[key] = path
    return topics.read_topic(x.spark, topic, path=path)


def _record(rows, topic, key, value, later=False):
    at = F.lit(LATER_US if later else 0).cast("long")
    return rows.select(F.expr(key).alias("key"), value.cast("string").alias("value"), F.lit(topic).alias("topic"), at.alias("timestamp"),
                       F.monotonically_increasing_id().alias("offset"))


def _json(**fields):
    return F.to_json(F.struct(*[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))


def _resource_records(x):
    p, topic = x.pods, "state.k8s.resource"
    first = _json(op="'UPSERT'", at=f"'{START}'", client_id="CASE WHEN u % 2 = 0 THEN client_id END", kind="'Pod'", namespace="ns", name="name", node="node",
                  labels=F.create_map(F.lit("app"), F.col("app")), replicas="CAST(u AS INT)", more="'not read'")
    return (_record(p, topic, "client_id || '::Pod:' || ns || ':' || name", F.when(F.col("u") % 7 == 3, F.concat(F.lit("{oops "), "name")).otherwise(first))
            .unionByName(_record(p.where("u % 7 = 1"), topic, "client_id || '|POD:' || ns || ':' || name", F.when(F.col("u") % 2 == 0, ""), True))
            .unionByName(_record(p.where("u % 7 = 2"), topic, "client_id || '::Pod:' || ns || ':' || name", _json(op="'delete'", at=f"'{LATER}'"))))


def _edge_records(x):
    e, topic = x.edges, "state.k8s.topology"
    body = lambda op, at: _json(op=f"'{op}'", at=f"'{at}'", id="CASE WHEN type = 'CONTROLS' THEN id END", **{"from": "upper(src)", "to": "dst"}, type="lower(replace(type, '_', ' '))")
    return (_record(e, topic, "client_id || '::' || CASE WHEN type = 'CONTROLS' THEN 'any' ELSE id END", body("UPSERT", START))
            .unionByName(_record(e.where("type = 'SELECTS'"), topic, "client_id || '::' || id", body("Delete", LATER))))


def _target_records(x):
    p, topic = x.pods, "state.prom.targets"
    labels = F.create_map(F.lit("namespace"), F.col("ns"), F.lit("job"), F.concat(F.lit("svc-"), "app"), F.lit("pod"), F.col("name"), F.lit("instance"), F.col("name"))
    body = _json(op="'UPSERT'", at=f"'{START}'", client_id="client_id", cluster="'c1'", labels=labels, scrapeUrl="'http://' || name", health="'up'")
    return (_record(p, topic, "CASE WHEN u % 2 = 0 THEN '' ELSE client_id || '::target-' || name END", body)
            .unionByName(_record(p.where("u % 10 = 5"), topic, "client_id || '::target-' || name", F.lit(None), True)))


def _rule_records(x):
    r, topic = x.episodes.where("etype = 'prom.alert'").select("client_id", "s_ns", "service", "reason").distinct(), "state.prom.rules"
    body = _json(op="'UPSERT'", at=f"'{START}'", group="s_ns || '/' || service", rule="reason", type="'Alerting'", expr="'up == 0'",
                 labels=F.create_map(F.lit("namespace"), F.col("s_ns"), F.lit("service"), F.col("service")))
    return _record(r, topic, "client_id || '::'", body).unionByName(
        _record(r, topic, "client_id || '::' || s_ns || '/' || service || '|' || reason", F.lit(None), True))


@query("s1_resource_topic", "SELECT client_id, 'pod:' || ns || ':' || name AS rid, 'Pod' AS kind, ns, name, node, app, CAST(u AS INTEGER) AS replicas FROM pods WHERE u % 7 NOT IN (1, 2, 3)")
def s1_resources(x):
    live = S.current_resources(typed.resource_changes(_records(x, "state.k8s.resource")))
    return live.select("client_id", "rid", "kind", "ns", "name", "node", F.col("labels")["app"].alias("app"), "replicas")


@query("s1_malformed_records", "SELECT client_id || '::Pod:' || ns || ':' || name AS key, '{oops ' || name AS value FROM pods WHERE u % 7 = 3")
def s1_malformed(x):
    return typed.malformed(_records(x, "state.k8s.resource"), schemas.RESOURCE_CHANGE).select("key", "value")


@query("s1_topology_topic", "SELECT client_id, id, src, dst, type FROM edges WHERE type <> 'SELECTS'")
def s1_edges(x):
    return S.current_edges(typed.edge_changes(_records(x, "state.k8s.topology"))).select("client_id", "id", "src", "dst", "type")


@query("s1_target_topic", """SELECT client_id, CASE WHEN u % 2 = 0 THEN 'c1|svc-' || app || '|' || ns || '||' || name ELSE 'target-' || name END AS target_id, ns, 'svc-' || app AS service, name AS pod,
    'http://' || name AS scrape_url, 'UP' AS health FROM pods WHERE u % 10 <> 5""")
def s1_targets(x):
    rows = S.latest_rows(typed.target_changes(_records(x, "state.prom.targets")), ["client_id", "target_id"]).where("op <> 'DELETE'")
    return rows.select("client_id", "target_id", "ns", "service", "pod", "scrape_url", "health")


@query("s1_rule_topic", """SELECT DISTINCT client_id, s_ns || '/' || service || '|' || reason AS rule_key, reason AS rule, s_ns || '/' || service AS "group", 'alerting' AS type, s_ns AS ns, service
  FROM episodes WHERE etype = 'prom.alert'""")
def s1_rules(x):
    rows = S.latest_rows(typed.rule_changes(_records(x, "state.prom.rules")), ["client_id", "rule_key"])
    return rows.select("client_id", "rule_key", "rule", "group", "type", "ns", "service")
