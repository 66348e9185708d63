"""Named queries for causal linking (L rows of the inventory)."""

import uuid

from pyspark.sql import functions as F

from causalspark.functions import rules
from causalspark.functions.scalar import DAY_US, MINUTE_US, round_to
from causalspark.operators import causality as L
from causalspark.operators import linktable
from causalspark.plans.registry import query
from causalspark.plans.sqltables import TEMPORAL, domain_case, r3
from causalspark.session import shared_folder

STREAM_PAIRS = """SELECT c.client_id, c.eid AS cause, e.eid AS effect, CAST(n.hops AS INTEGER) AS hops, e.t - c.t AS gap_us,
    c.reason AS c_reason, e.reason AS e_reason, c.message AS c_message, e.message AS e_message, c.severity AS c_sev, e.severity AS e_sev
  FROM episodes c JOIN episodes e ON c.client_id = e.client_id AND e.t >= c.t AND e.t <= c.t + 900000000 AND c.rid <> e.rid
  JOIN near n ON n.client_id = c.client_id AND n.a = c.rid AND n.b = e.rid"""
STREAM_DOMAIN = domain_case(rules.STREAM_REASON_RULES, rules.STREAM_DOMAIN_DEFAULT,
    "WHEN regexp_matches(c.message, '(?i)(connection refused|timeout)') AND e.severity = 'ERROR' THEN 0.70 "
    "WHEN regexp_matches(c.message, '(?i)(database|deadlock)') AND regexp_matches(e.message, '(?i)(api|service)') THEN 0.65 "
    "WHEN c.severity = 'ERROR' AND e.severity = 'ERROR' THEN 0.50")
STREAM_SCORED = f"""SELECT s.*, {STREAM_DOMAIN} AS domain_score, 1.0 - (gap_us // 1000) / CAST(900000 AS DOUBLE) AS temporal_score,
    1.0 / (hops + CAST(1.0 AS DOUBLE)) AS distance_score
  FROM stream_pairs s JOIN episodes c ON c.eid = s.cause JOIN episodes e ON e.eid = s.effect"""


@query("l1_link_causes", "SELECT client_id, cause, effect, hops, gap_us FROM stream_pairs",
       {"stream_pairs": STREAM_PAIRS})
def l1(x):
    return L.link_causes(x.episodes, x.edges)


@query("l2_score_links_stream", f"""SELECT client_id, cause, effect, hops, {r3('temporal_score', 6)} AS temporal_score,
    {r3('distance_score', 6)} AS distance_score, domain_score,
    {r3('temporal_score * 0.3 + distance_score * 0.3 + domain_score * 0.4', 6)} AS confidence FROM stream_scored""",
       {"stream_pairs": STREAM_PAIRS, "stream_scored": STREAM_SCORED})
def l2(x):
    scored = L.scored_causes_stream(x.episodes, x.edges)
    return scored.select("client_id", "cause", "effect", "hops",
                         round_to(F.col("temporal_score"), 6).alias("temporal_score"),
                         round_to(F.col("distance_score"), 6).alias("distance_score"),
                         "domain_score", round_to(F.col("confidence"), 6).alias("confidence"))


@query("l3_build_causality", "SELECT client_id, cause, effect, hops, temporal_score, distance_score, domain_score, confidence, time_gap_seconds FROM links")
def l3(x):
    return L.build_causality(x.episodes, x.edges).drop("rank")


@query("l4_top_causes", "SELECT client_id, effect, cause, confidence, rank FROM links")
def l4(x):
    return x.links.select("client_id", "effect", "cause", "confidence", "rank")


@query("l4_top_causes_dense", "SELECT client_id, effect, cause, confidence, rank FROM links")
def l4_dense(x):
    """Built anew, not read from the stored links."""
    return L.build_causality(x.episodes, x.edges).select(
        "client_id", "effect", "cause", "confidence", "rank")


@query("l5_basic_causality", f"""SELECT client_id, cause, effect, {r3('temporal_score')} AS temporal_score,
    {r3('distance_score')} AS distance_score, {r3('domain_score')} AS domain_score, {r3('conf')} AS confidence, gap AS time_gap_seconds
  FROM (SELECT *, 0.4 * temporal_score + 0.3 * distance_score + 0.3 * domain_score AS conf FROM basic2) WHERE conf > 0.3""",
       {"basic": """SELECT c.client_id, c.eid AS cause, e.eid AS effect, (e.t - c.t) // 1000000 AS gap,
    CAST(CASE WHEN c.s_name = e.s_name THEN 0.95 WHEN c.s_ns = e.s_ns AND c.s_kind = e.s_kind THEN 0.60 WHEN c.s_ns = e.s_ns THEN 0.40 ELSE 0.20 END AS DOUBLE) AS distance_score,
    CAST(CASE WHEN c.reason = 'OOMKilled' AND e.reason IN ('BackOff','Failed','Killing') THEN 0.95
      WHEN contains(c.reason, 'ImagePull') AND e.reason IN ('Failed','BackOff') THEN 0.90
      WHEN c.reason = 'Failed' AND contains(c.message, 'pull') AND e.reason = 'BackOff' THEN 0.90
      WHEN c.reason = 'Unhealthy' AND e.reason IN ('BackOff','Failed','Killing') THEN 0.80
      WHEN c.reason = 'Failed' AND e.reason = 'BackOff' THEN 0.85
      WHEN c.reason IN ('FailedMount','FailedScheduling') AND e.reason IN ('BackOff','Failed') THEN 0.80
      WHEN c.s_name = e.s_name THEN 0.65 WHEN c.s_ns = e.s_ns AND c.s_kind = e.s_kind THEN 0.50
      WHEN c.s_ns = e.s_ns THEN 0.40 ELSE 0.30 END AS DOUBLE) AS domain_score
    FROM episodes c JOIN episodes e ON c.client_id = e.client_id AND e.t > c.t AND e.t < c.t + 600000000""",
        "basic2": f"SELECT *, {TEMPORAL} AS temporal_score FROM basic"})
def l5(x):
    return L.build_causality_basic(x.episodes)


@query("l6_links_per_tenant", "SELECT client_id, count(*) AS links, count(DISTINCT effect) AS effects FROM links GROUP BY client_id")
def l6(x):
    return x.links.groupBy("client_id").agg(F.count("*").alias("links"),
                                            F.countDistinct("effect").alias("effects"))


@query("l7_rebuild_counts", """SELECT client_id, sum(b) AS links_before, sum(a) AS links_after, sum(a) - sum(b) AS added FROM (
    SELECT client_id, 0::BIGINT AS b, count(*) AS a FROM links GROUP BY 1
    UNION ALL SELECT client_id, count(*), 0 FROM links WHERE confidence >= 0.6 GROUP BY 1) GROUP BY 1""")
def l7(x):
    return L.rebuild_counts(x.links.where("confidence >= 0.6"), x.links)


NEWEST = "SELECT client_id, eid, t, rid FROM episodes, clock WHERE t > now - 86400000000"
FIRST_NODE = "SELECT u.client_id, u.src, u.dst FROM edges u JOIN (SELECT client_id, min(dst) AS dst FROM edges WHERE type = 'RUNS_ON' GROUP BY 1) USING (client_id, dst) WHERE type = 'RUNS_ON'"


def _link_table_after_changes(x):
    """The link table built without the newest day's events and without the pods of each tenant's first node, then repaired."""
    path = f"{shared_folder(x.spark)}/links/{uuid.uuid4().hex}"
    newest = x.episodes.where(F.col("t") > x.episodes.select(F.max("t") - DAY_US).scalar())
    first = x.edges.where("type = 'RUNS_ON'").groupBy("client_id").agg(F.min("dst").alias("dst"), F.first("type").alias("type"))
    before = x.edges.join(first, ["client_id", "dst", "type"], "left_anti")
    linktable.rebuild(path, x.episodes.join(newest, ["client_id", "eid"], "left_anti"), before)
    return path, linktable.apply_changes(path, x.episodes, x.edges, newest, before)


@query("l7_incremental_rebuild", "SELECT client_id, cause, effect, hops, temporal_score, distance_score, domain_score, confidence, time_gap_seconds, rank FROM links")
def l7_incremental(x):
    """The same links as a full build."""
    path, _ = _link_table_after_changes(x)
    return linktable.read(x.spark, path).drop("day")


@query("l7_rewritten_slices", """SELECT DISTINCT client_id, CAST(day AS BIGINT) AS day FROM (
    SELECT client_id, t // 86400000000 AS day FROM newest UNION ALL SELECT client_id, (t + 900000000) // 86400000000 FROM newest
    UNION ALL SELECT e.client_id, e.t // 86400000000 FROM episodes e JOIN reached r ON r.client_id = e.client_id AND r.rid = e.rid)""",
       {"newest": NEWEST, "first_node": FIRST_NODE, "ends": "SELECT client_id, src AS rid FROM first_node UNION SELECT client_id, dst FROM first_node",
        "reached": "SELECT client_id, rid FROM ends UNION SELECT n.client_id, n.b FROM near n JOIN ends s ON s.client_id = n.client_id AND s.rid = n.a WHERE n.hops <= 2"})
def l7_slices(x):
    """The slices that the repair has written."""
    return _link_table_after_changes(x)[1]


@query("l8_correlated_failures", """SELECT c.client_id, c.rid, c.eid AS first_event, e.eid AS second_event, e.t - c.t AS gap_us,
    l.cause IS NOT NULL AS linked
  FROM episodes c JOIN episodes e ON c.client_id = e.client_id AND c.rid = e.rid AND e.t > c.t AND e.t <= c.t + 900000000
  LEFT JOIN links l ON l.client_id = c.client_id AND l.cause = c.eid AND l.effect = e.eid
  WHERE c.severity IN ('WARNING','ERROR') AND e.severity IN ('ERROR','FATAL')""")
def l8(x):
    pairs = L.with_link_flag(L.correlated_failures(x.episodes, 900), x.links)
    return pairs.select("client_id", "rid", F.col("c_eid").alias("first_event"),
                        F.col("e_eid").alias("second_event"), "gap_us", "linked")


@query("l9_sequence_pairs", """SELECT c.client_id, c.s_kind AS kind, c.reason AS first_reason, e.reason AS second_reason, count(*) AS n,
    min(e.t - c.t) AS min_gap_us
  FROM episodes c JOIN episodes e ON c.client_id = e.client_id AND c.rid = e.rid AND e.t > c.t AND e.t <= c.t + 3600000000
  WHERE c.reason IN ('LOG_ERROR','Unhealthy','LOG_OOM_KILLED','LOG_WARNING') AND e.reason IN ('BackOff','CrashLoopBackOff','Killing','OOMKilled')
  GROUP BY ALL""")
def l9(x):
    first = x.episodes.where(F.col("reason").isin("LOG_ERROR", "Unhealthy", "LOG_OOM_KILLED", "LOG_WARNING"))
    second = x.episodes.where(F.col("reason").isin("BackOff", "CrashLoopBackOff", "Killing", "OOMKilled"))
    pairs = L.sequence_pairs(first, second, ["client_id", "rid"], 3600)
    return pairs.groupBy("client_id", F.col("c_s_kind").alias("kind"),
                         F.col("c_reason").alias("first_reason"),
                         F.col("e_reason").alias("second_reason")).agg(
        F.count("*").alias("n"), F.min("gap_us").alias("min_gap_us"))


@query("l10_warnings_with_failures", """SELECT w.client_id, w.eid, w.rid, w.reason, count(f.eid) AS failures,
    coalesce(max(f.t - w.t), 0) AS last_gap_us, coalesce(arg_min(f.reason, f.t), '') AS first_failure
  FROM episodes w LEFT JOIN episodes f ON w.client_id = f.client_id AND w.rid = f.rid AND f.t > w.t AND f.t <= w.t + 3600000000
    AND f.severity IN ('ERROR','FATAL') WHERE w.severity = 'WARNING' GROUP BY w.client_id, w.eid, w.rid, w.reason""")
def l10(x):
    return L.warnings_with_failures(x.episodes, 3600)


@query("l11_concurrent_failures", """SELECT c.client_id, c.eid AS first_event, e.eid AS second_event, abs(e.t - c.t) AS gap_us
  FROM episodes c JOIN episodes e ON c.client_id = e.client_id AND c.rid <> e.rid AND (c.t < e.t OR (c.t = e.t AND c.eid < e.eid))
    AND e.t - c.t <= 300000000 WHERE c.severity IN ('ERROR','FATAL') AND e.severity IN ('ERROR','FATAL')""")
def l11(x):
    return L.concurrent_failures(x.episodes, ["client_id"], 300).select(
        "client_id", F.col("c_eid").alias("first_event"), F.col("e_eid").alias("second_event"), "gap_us")


@query("l12_alerts_with_events", """SELECT a.client_id, a.rid, a.eid AS alert, k.eid AS event, k.t - a.t AS gap_us
  FROM episodes a JOIN episodes k ON a.client_id = k.client_id AND a.rid = k.rid AND abs(k.t - a.t) <= 1800000000
  WHERE a.etype = 'prom.alert' AND k.etype = 'k8s.event'""")
def l12(x):
    return L.alerts_with_events(x.episodes, 1800).select(
        "client_id", "rid", F.col("c_eid").alias("alert"), F.col("e_eid").alias("event"), "gap_us")


@query("l13_errors_before_fatal", """SELECT f.client_id, f.eid, f.rid, count(e.eid) AS errors_before,
    coalesce(arg_max(e.eid, e.t), '') AS last_error, coalesce(arg_max(e.reason, e.t), '') AS last_error_reason
  FROM episodes f LEFT JOIN episodes e ON e.client_id = f.client_id AND e.rid = f.rid AND e.severity = 'ERROR'
    AND e.t >= f.t - 86400000000 AND e.t <= f.t WHERE f.severity = 'FATAL' GROUP BY f.client_id, f.eid, f.rid""")
def l13(x):
    return L.errors_before_fatal(x.episodes, 86400).drop("t")


@query("l14_changes_before", """SELECT i.client_id, i.incident_id, count(*) AS changes, count(DISTINCT ch.rid) AS changed
  FROM incidents i JOIN episodes ch ON ch.client_id = i.client_id AND ch.t <= i.window_start AND ch.t >= i.window_start - 1800000000
  WHERE ch.reason IN ('Created','Killing','Scheduled') GROUP BY 1, 2""")
def l14(x):
    changes = x.episodes.where(F.col("reason").isin("Created", "Killing", "Scheduled")).select(
        "client_id", "rid", "t")
    return L.changes_before(changes, x.incidents.select("client_id", "incident_id", "window_start"), 30
                            ).groupBy("client_id", "incident_id").agg(
        F.count("*").alias("changes"), F.countDistinct("rid").alias("changed"))


@query("l15_temporal_validity", """SELECT client_id, ordering, n, floor(n * 100.0 / sum(n) OVER (PARTITION BY client_id) * 100.0 + 0.5) / 100.0 AS percentage FROM (
    SELECT client_id, CASE WHEN (e_t - c_t) // 1000000 > 0 THEN 'cause before effect' WHEN (e_t - c_t) // 1000000 = 0 THEN 'same time' ELSE 'cause after effect' END AS ordering,
    CAST(count(*) AS BIGINT) AS n FROM lk GROUP BY 1, 2)""")
def l15(x):
    return L.temporal_validity(x.named_links)


@query("l16_cross_tenant", """SELECT 'links' AS checked, count(*) AS n FROM links l JOIN episodes c ON c.eid = l.cause JOIN episodes e ON e.eid = l.effect
    WHERE c.client_id <> e.client_id
  UNION ALL SELECT 'edges', count(*) FROM edges g JOIN resources a ON a.rid = g.src JOIN resources b ON b.rid = g.dst WHERE a.client_id <> b.client_id""")
def l16(x):
    ids = x.episodes.select("client_id", "eid")
    links = L.cross_tenant_rows(x.links.drop("client_id"), ids, ids, "cause", "effect", "eid")
    nodes = x.resources.select("client_id", "rid")
    edges = L.cross_tenant_rows(x.edges.drop("client_id"), nodes, nodes, "src", "dst", "rid")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("checked"), "n")
    return count(links, "links").unionByName(count(edges, "edges"))


@query("l17_adjust_confidence", f"""SELECT client_id, cause, effect, recent, {r3('least(1.0, confidence * f1 * f2)', 6)} AS adjusted FROM (
    SELECT l.*, r.recent, CAST(CASE WHEN recent > 5 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS f1,
      CAST(CASE WHEN c_reason IN ('OOMKilled','CrashLoopBackOff') AND recent > 3 THEN 1.3 ELSE 1.0 END AS DOUBLE) AS f2
    FROM lk l JOIN (SELECT client_id, eid, count(*) OVER (PARTITION BY client_id, reason ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM episodes) r
    ON r.client_id = l.client_id AND r.eid = l.cause)""")
def l17(x):
    return L.adjust_confidence(x.named_links, x.episodes, 1440).select(
        "client_id", "cause", "effect", "recent", round_to(F.col("adjusted"), 6).alias("adjusted"))


@query("l18_error_cascades", """SELECT a.client_id, a.eid, a.reason, count(b.eid) FILTER (b.t > a.t) AS followers, max(b.t) - any_value(a.t) AS span_us,
    array_to_string(list_sort(list_distinct(list(b.reason))), '|') AS reasons
  FROM episodes a JOIN episodes b ON a.client_id = b.client_id AND b.t >= a.t AND b.t <= a.t + 300000000
  WHERE a.severity IN ('ERROR','FATAL') AND b.severity IN ('ERROR','FATAL') GROUP BY 1, 2, 3""")
def l18(x):
    return L.error_cascades(x.episodes).drop("t").withColumn("reasons", F.array_join("reasons", "|"))
