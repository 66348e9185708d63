"""Check SQL for the engine tables over the sample directory, written for a second engine."""

from __future__ import annotations

import re

from causalspark.functions import rules
from causalspark.sources import testmap as m


def _test(col: str, pattern: str) -> str:
    return f"contains({col}, '{pattern[1:]}')" if pattern.startswith("~") else f"{col} = '{pattern}'"


def _tests(col: str, patterns) -> str:
    return "(" + " OR ".join(_test(col, p) for p in patterns) + ")"


def domain_case(rows, default, extra: str = "") -> str:
    branches = " ".join(f"WHEN {_test('c.reason', c)} AND {_tests('e.reason', e)} THEN {s}"
                        for c, e, s in rows)
    return f"CAST(CASE {branches} {extra} ELSE {default} END AS DOUBLE)"


def lookup_case(col: str, table: dict, default: str) -> str:
    return (f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
            + f" ELSE {default} END")


WINDOW = ("CASE " + " ".join(f"WHEN {_tests('c.reason', p)} THEN {n}"
                             for p, n in rules.ADAPTIVE_WINDOWS)
          + f" ELSE {rules.ADAPTIVE_WINDOW_DEFAULT} END")


def r3(x: str, digits: int = 3) -> str:
    s = float(10 ** digits)
    return f"floor(({x}) * {s} + 0.5) / {s}"


TEMPORAL = ("CAST(CASE WHEN gap <= 0 THEN 0.0 WHEN gap >= 300 THEN 0.1 "
            "ELSE 1.0 - (CAST(gap AS DOUBLE) / 300.0) * 0.9 END AS DOUBLE)")

TABLES = {
    "ev": """SELECT event_id, user_id AS u, event_type, value, epoch_us(ts) AS t,
        CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
        'node-' || CAST(c_nationkey AS STRING) AS node, 'svc-' || lower(c_mktsegment) AS service
      FROM events JOIN customer ON c_custkey = user_id""",
    "ev1": f"SELECT *, {m.TENANT} AS client_id, {m.NAMESPACE} AS ns, {m.ETYPE} AS etype, "
           f"{m.REASON} AS reason, {m.SEVERITY} AS severity FROM ev",
    "ev2": f"SELECT *, {m.MESSAGE} AS message, {m.SUBJECT_KIND} AS s_kind FROM ev1",
    "ev3": f"SELECT *, {m.SUBJECT_NS} AS s_ns, {m.SUBJECT_NAME} AS s_name FROM ev2",
    "episodes": f"""SELECT client_id, 'evt-' || CAST(event_id AS STRING) AS eid, t, etype, severity,
        reason, message, s_kind, s_ns, s_name, {m.RID} AS rid, service, node, value FROM ev3""",
    "clock": "SELECT max(t) AS now FROM episodes",
    "pods": f"""SELECT u, {m.TENANT} AS client_id, {m.NAMESPACE} AS ns,
        'pod-' || CAST(u AS STRING) AS name, 'node-' || CAST(c_nationkey AS STRING) AS node,
        lower(c_mktsegment) AS app, 'team-' || CAST(u % 4 AS STRING) AS team,
        'rs-' || CAST(u % 30 AS STRING) AS rs, 'deploy-' || CAST(u % 15 AS STRING) AS deploy,
        {m.PHASE} AS phase
      FROM (SELECT DISTINCT user_id AS u FROM events) JOIN customer ON c_custkey = u""",
    "resources": """SELECT *, lower(kind) || ':' || ns || ':' || name AS rid FROM (
        SELECT client_id, 'Pod' AS kind, ns, name, node, app, team, phase, 'ReplicaSet/' || rs AS owner FROM pods
        UNION ALL SELECT DISTINCT client_id, 'Node', '', node, '', '', '', 'Active', '' FROM pods
        UNION ALL SELECT DISTINCT client_id, 'Service', ns, 'svc-' || app, '', app, '', 'Active', '' FROM pods
        UNION ALL SELECT DISTINCT client_id, 'ReplicaSet', ns, rs, '', '', '', 'Active', 'Deployment/' || deploy FROM pods
        UNION ALL SELECT DISTINCT client_id, 'Deployment', ns, deploy, '', '', '', 'Active', '' FROM pods)""",
    "edges": """SELECT *, 'edge:' || src || '->' || dst AS id FROM (
        SELECT client_id, 'pod:' || ns || ':' || name AS src, 'node::' || node AS dst, 'RUNS_ON' AS type FROM pods
        UNION ALL SELECT client_id, 'service:' || ns || ':svc-' || app, 'pod:' || ns || ':' || name, 'SELECTS' FROM pods
        UNION ALL SELECT client_id, 'replicaset:' || ns || ':' || rs, 'pod:' || ns || ':' || name, 'CONTROLS' FROM pods
        UNION ALL SELECT DISTINCT client_id, 'deployment:' || ns || ':' || deploy, 'replicaset:' || ns || ':' || rs, 'CONTROLS' FROM pods)""",
    "service_flows": f"""SELECT DISTINCT {m.TENANT} AS client_id, src, dst FROM (
        SELECT o_custkey AS u, 'svc-' || CAST(l_suppkey AS STRING) AS src, 'svc-' || CAST(l_partkey % 100 AS STRING) AS dst
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE src <> dst""",
    "resource_changes": f"""SELECT {m.TENANT} AS client_id,
        'pod:' || {m.NAMESPACE} || ':pod-' || CAST(u AS STRING) AS rid, at_us, offset_, op, image, phase FROM (
        SELECT o_custkey AS u, o_orderkey AS offset_, epoch_us(o_orderdate) AS at_us,
          CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'DELETE' ELSE 'UPSERT' END AS op,
          o_orderpriority AS image, o_orderstatus AS phase FROM orders)""",
    "edge_changes": f"""SELECT *, 'edge:' || src || '->' || dst AS id FROM (SELECT {m.TENANT} AS client_id,
        'service:shop:svc-' || CAST(l_suppkey AS STRING) AS src,
        'pod:' || {m.NAMESPACE} || ':pod-' || CAST(u AS STRING) AS dst, epoch_us(l_shipdate) AS at_us,
        l_orderkey * 10 + l_linenumber AS offset_, 'SELECTS' AS type,
        CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'UPSERT' END AS op
        FROM lineitem JOIN (SELECT o_orderkey, o_custkey AS u FROM orders) ON o_orderkey = l_orderkey)""",
    "undirected": """SELECT client_id, src AS a, dst AS b FROM edges
        UNION SELECT client_id, dst, src FROM edges""",
    "near": """SELECT client_id, a, b, min(h) AS hops FROM (
        SELECT client_id, a, b, 1 AS h FROM undirected
        UNION ALL SELECT DISTINCT x.client_id, x.a, y.b, 2 FROM undirected x JOIN undirected y
          ON x.client_id = y.client_id AND x.b = y.a
        UNION ALL SELECT DISTINCT p.client_id, p.a, z.b, 3 FROM (
            SELECT DISTINCT x.client_id, x.a, y.b FROM undirected x JOIN undirected y
            ON x.client_id = y.client_id AND x.b = y.a) p
          JOIN undirected z ON p.client_id = z.client_id AND p.b = z.a)
      WHERE a <> b GROUP BY client_id, a, b""",
    "batch_pairs": f"""SELECT c.client_id, c.eid AS cause, e.eid AS effect, c.rid AS c_rid, e.rid AS e_rid,
        (e.t - c.t) // 1000000 AS gap, e.t - c.t AS gap_us,
        {domain_case(rules.BATCH_DOMAIN_RULES, rules.BATCH_DOMAIN_DEFAULT)} AS domain_score,
        c.s_name AS c_name, e.s_name AS e_name, c.s_ns AS c_ns, e.s_ns AS e_ns, c.s_kind AS c_kind, e.s_kind AS e_kind
      FROM episodes c JOIN episodes e ON c.client_id = e.client_id AND e.t > c.t
        AND e.t < c.t + 60000000 * CAST({WINDOW} AS BIGINT)""",
    "batch_scored": f"""SELECT p.*, {TEMPORAL} AS temporal_score,
        CAST(CASE WHEN c_name = e_name THEN 0.95 WHEN hops = 1 THEN 0.85 WHEN hops = 2 THEN 0.70
          WHEN hops = 3 THEN 0.55 WHEN c_ns = e_ns AND c_kind = e_kind THEN 0.40 ELSE 0.20 END AS DOUBLE) AS distance_score,
        coalesce(hops, 0) AS hops
      FROM batch_pairs p LEFT JOIN near n ON n.client_id = p.client_id AND n.a = p.c_rid AND n.b = p.e_rid""",
    "batch_conf": """SELECT *, 0.4 * temporal_score + 0.3 * distance_score + 0.3 * domain_score AS conf
      FROM batch_scored""",
    "links": f"""SELECT client_id, cause, effect, CAST(hops AS INTEGER) AS hops, {r3('temporal_score')} AS temporal_score,
        {r3('distance_score')} AS distance_score, {r3('domain_score')} AS domain_score,
        {r3('conf')} AS confidence, gap AS time_gap_seconds, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY client_id, effect ORDER BY conf DESC, gap_us, cause) AS INTEGER) AS rank
        FROM batch_conf WHERE conf > 0.3) WHERE rank <= 5""",
    "lk": """SELECT l.*, c.reason AS c_reason, c.severity AS c_sev, c.rid AS c_rid, c.t AS c_t, c.etype AS c_etype,
        c.s_name AS c_name, c.s_ns AS c_ns, c.s_kind AS c_kind,
        e.reason AS e_reason, e.severity AS e_sev, e.rid AS e_rid, e.t AS e_t, e.etype AS e_etype,
        e.s_name AS e_name, e.s_ns AS e_ns, e.s_kind AS e_kind
      FROM links l JOIN episodes c ON c.client_id = l.client_id AND c.eid = l.cause
      JOIN episodes e ON e.client_id = l.client_id AND e.eid = l.effect""",
    "failures": """SELECT *, sum(new) OVER (PARTITION BY client_id, rid ORDER BY t, eid ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client_id, rid ORDER BY t, eid) <= 43200000000 THEN 0 ELSE 1 END AS new
        FROM episodes WHERE severity IN ('ERROR','FATAL'))""",
    "incident_groups": """SELECT client_id, rid, g, min(t) AS window_start, max(t) AS window_end, count(*) AS event_count,
        CASE WHEN bool_or(severity = 'FATAL') THEN 'FATAL' ELSE 'ERROR' END AS severity FROM failures GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "incidents": """SELECT 'inc-' || substr(md5(client_id || '|' || rid || '|' || CAST(window_start AS STRING)), 1, 12) AS incident_id,
        client_id, rid AS resource_id, g, window_start, window_end, event_count, severity,
        CASE WHEN (SELECT now FROM clock) - window_end <= 86400000000 THEN 'open' ELSE 'resolved' END AS status FROM incident_groups""",
    "incident_members": """SELECT i.incident_id, f.client_id, f.eid, f.rid, f.t, f.reason, f.severity, f.message
      FROM failures f JOIN incidents i ON i.client_id = f.client_id AND i.resource_id = f.rid AND i.g = f.g""",
}


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
    return [name for name in TABLES if name in words]


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the tables that it (transitively) names."""
    extra = extra or {}
    body_text = body + " ".join(extra.values())
    used: set[str] = set()
    todo = _needs(body_text)
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            todo += _needs(TABLES[name])
    parts = [f"{n} AS MATERIALIZED ({TABLES[n]})" for n in TABLES if n in used]
    parts += [f"{n} AS MATERIALIZED ({t})" for n, t in extra.items()]
    recursive = any(re.search(rf"\b{n}\b", t) for n, t in extra.items())
    return (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else "") + body
