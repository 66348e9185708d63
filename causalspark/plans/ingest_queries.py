"""Named queries for sources (S rows) and scalar derivations (P rows)."""

from pyspark.sql import functions as F

from causalspark import schemas
from causalspark.functions import classify as K, rules as R, scalar as C
from causalspark.plans.registry import query
from causalspark.plans.sqltables import lookup_case, r3
from causalspark.sources import alerts as A, export, records, topics
from causalspark.sources.testmap import Sample
from causalspark.session import write_table

TEXT_TIME = "strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f')"


def _sql_contains(col, parts):
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


def _sql_case(branches, default):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in branches) + f" ELSE {default} END"


# --- lines used for the log classifiers: event messages in several formats, and documents ----

LINES = """SELECT eid AS id, CASE etype WHEN 'k8s.event' THEN message
      WHEN 'k8s.log' THEN CASE severity WHEN 'ERROR' THEN 'E0123 10:11:12.345678 ' WHEN 'FATAL' THEN 'panic: ' WHEN 'WARNING' THEN '[warn] ' ELSE 'I0123 10:11:12.345678 ' END || message
      ELSE message END AS line, CASE WHEN etype = 'prom.alert' THEN CASE severity WHEN 'FATAL' THEN 'panic' ELSE lower(severity) END END AS level FROM episodes
    UNION ALL SELECT 'doc-' || CAST(doc_id AS STRING), text, NULL FROM documents"""


def _lines(x):
    sev, msg = F.col("severity"), F.col("message")
    prefix = F.when(sev == "ERROR", "E0123 10:11:12.345678 ").when(sev == "FATAL", "panic: ").when(
        sev == "WARNING", "[warn] ").otherwise("I0123 10:11:12.345678 ")
    level = F.when(F.col("etype") == "prom.alert", F.when(sev == "FATAL", "panic").otherwise(F.lower(sev)))
    ev = x.episodes.select(F.col("eid").alias("id"), F.when(F.col("etype") == "k8s.log", F.concat(prefix, msg)).otherwise(msg).alias("line"),
                           level.alias("level"))
    docs = x.raw("documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
                                     F.col("text").alias("line"), F.lit(None).cast("string").alias("level"))
    return ev.unionByName(docs)


@query("p1_split_tenant_key", """SELECT eid, CASE WHEN etype = 'prom.alert' THEN '' ELSE client_id END AS tenant,
    CASE WHEN etype = 'k8s.log' THEN rid WHEN etype = 'k8s.event' THEN rid ELSE rid END AS raw FROM episodes""")
def p1(x):
    key = F.when(F.col("etype") == "k8s.event", F.concat_ws("::", "client_id", "rid")).when(
        F.col("etype") == "k8s.log", F.concat_ws("|", "client_id", "rid")).otherwise(
        F.when(F.contains(F.col("rid"), F.lit("::")), F.concat(F.lit("|"), "rid")).otherwise(F.col("rid")))
    key = F.when((F.col("etype") != "k8s.event") & F.contains(F.col("rid"), F.lit("::")),
                 F.concat(F.when(F.col("etype") == "k8s.log", F.col("client_id")).otherwise(""), F.lit("::"), "rid")).otherwise(key)
    tenant, raw = C.split_tenant_key(key)
    return x.episodes.select("eid", F.coalesce(tenant, F.lit("")).alias("tenant"), raw.alias("raw"))


@query("p2_resource_ids", """SELECT rid, lower(kind) || ':' || CASE WHEN ns = '' THEN ':' || name ELSE ns || ':' || name END AS by_name, lower(kind) || ':u-' || name AS by_uid,
    kind = 'Replicaset' OR kind IN ('Pod','Node','Service','Deployment') AS same_kind, upper(substr(kind, 1, 1)) || lower(substr(kind, 2)) AS kind, lower(ns) AS ns, lower(name) AS name FROM (SELECT DISTINCT rid, kind, ns, name FROM resources)""")
def p2(x):
    r = x.resources.select("rid", "kind", "ns", "name").distinct()
    p = C.parse_rid(F.col("rid"))
    none = F.lit("")
    return r.select("rid", C.resource_id(F.col("kind"), none, F.col("ns"), F.col("name")).alias("by_name"),
                    C.resource_id(F.col("kind"), F.concat(F.lit("u-"), "name"), none, none).alias("by_uid"),
                    (p["kind"] == F.col("kind")).alias("same_kind"), p["kind"].alias("kind"), p["ns"].alias("ns"), p["name"].alias("name"))


@query("p3_safe_names", r"""SELECT p_partkey, regexp_replace(p_brand, '[^\p{L}\p{Nd}_]', '_', 'g') AS label, regexp_replace(upper(p_name), '[^\p{L}\p{Nd}_]', '_', 'g') AS relation,
    'L_' || CAST(p_size AS STRING) AS numbered FROM part""")
def p3(x):
    return x.raw("part").select("p_partkey", C.safe_label(F.col("p_brand")).alias("label"), C.safe_relation(F.col("p_name")).alias("relation"),
                                C.safe_label(F.col("p_size").cast("string")).alias("numbered"))


@query("p4_labels_kv", "SELECT client_id, 'pod:' || ns || ':' || name AS rid, 'app=' || app || ',team=' || team AS kv FROM pods")
def p4(x):
    pods = x.resources.where("kind = 'Pod'")
    m = F.create_map(F.lit("team"), F.col("team"), F.lit("app"), F.col("app"))
    return pods.select("client_id", "rid", F.array_join(C.labels_kv(m), ",").alias("kv"))


@query("p5_tenant_fill", "SELECT eid, CASE WHEN etype = 'prom.alert' THEN 'shared' ELSE client_id END AS client_id FROM episodes WHERE etype = 'prom.alert' OR client_id <> 'tenant-2'")
def p5(x):
    given = F.when(F.col("etype") == "k8s.event", F.col("client_id")).otherwise("")
    key = F.when(F.col("etype") == "k8s.log", F.concat_ws("::", "client_id", "eid")).otherwise(F.col("eid"))
    rows = x.episodes.select("eid", topics.tenant_column(given, key, "shared").alias("client_id"))
    return rows.where("client_id <> 'tenant-2'")


def _raw_events(x):
    """Exporter payloads built from the events; some are broken on purpose."""
    e = x.episodes
    iso = C.text_time(F.col("t"))
    info = F.col("severity") == "INFO"
    body = F.struct(
        "client_id",
        F.struct(F.when(F.col("etype") == "prom.alert", "").otherwise(F.concat(F.lit("uid-"), "eid")).alias("uid"),
                 F.col("s_ns").alias("namespace")).alias("metadata"),
        F.when(F.col("etype") == "k8s.log", "  ").otherwise(F.col("reason")).alias("reason"), "message",
        F.when(info, "Normal").otherwise("Warning").alias("type"),
        F.when(F.col("severity") == "FATAL", "not a time").otherwise(
            F.when(F.col("severity") != "WARNING", F.concat(iso, F.lit("Z")))).alias("eventTime"),
        F.when(F.col("severity") == "WARNING", F.concat(iso, F.lit("Z"))).alias("lastTimestamp"),
        F.struct(F.col("node").alias("host")).alias("source"),
        F.struct(F.col("s_kind").alias("kind"), F.col("s_ns").alias("namespace"), F.col("s_name").alias("name"),
                 F.create_map(F.lit("app"), F.col("service")).alias("labels")).alias("involvedObject"))
    text = F.to_json(body)
    broken = F.col("reason") == "LOG_INFO"
    return e.select(F.when(F.col("etype") == "prom.alert", F.concat(F.lit("key-"), "eid")).alias("key"),
                    F.when(broken, F.concat(F.lit("{broken "), "eid")).otherwise(text).alias("value"),
                    F.col("t").alias("timestamp"))


@query("p6_normalize_events", f"""SELECT CASE WHEN etype = 'prom.alert' THEN 'key-' || eid ELSE 'uid-' || eid END AS eid, client_id, t, 'k8s.event' AS etype,
    CASE WHEN severity = 'INFO' THEN 'INFO' ELSE 'WARNING' END AS severity, CASE WHEN etype = 'k8s.log' THEN 'Unknown' ELSE reason END AS reason, message, s_kind, s_ns, s_name, service, node
  FROM episodes WHERE reason <> 'LOG_INFO' AND severity <> 'FATAL'""")
def p6(x):
    ok, _ = records.normalize_events(_raw_events(x))
    return ok.drop("abstract_type", "s_uid")


@query("s6_dead_letters", "SELECT CASE WHEN reason = 'LOG_INFO' THEN 'malformed record' ELSE 'bad timestamp' END AS error, t AS at_us FROM episodes WHERE reason = 'LOG_INFO' OR severity = 'FATAL'")
def s6(x):
    _, dead = records.normalize_events(_raw_events(x))
    return dead.select("error", F.col("at").alias("at_us"))


@query("p7_severity_by_reason", """SELECT eid, CASE WHEN reason IN ('OOMKilled','CrashLoopBackOff','Error') OR (reason = 'Failed' AND contains(lower(message), 'pod')) THEN 'FATAL'
    WHEN reason IN ('FailedScheduling','FailedMount','ImagePullBackOff','NodeNotReady','Evicted') OR (reason = 'Unhealthy' AND contains(lower(message), 'liveness')) THEN 'ERROR'
    WHEN reason IN ('BackOff','Unhealthy') THEN 'WARNING' ELSE severity END AS severity FROM episodes""")
def p7(x):
    return x.episodes.select("eid", K.event_severity_by_reason(F.col("reason"), F.col("message"), F.col("severity")).alias("severity"))


ABSTRACT = lookup_case("reason", R.ABSTRACT_TYPES, _sql_case([(_sql_contains("reason", p), v) for p, v in R.ABSTRACT_TYPE_PARTS], "'CUSTOM'"))
GUESSED = _sql_case([(_sql_contains("reason", R.ERROR_REASON_PARTS), "ERROR"), (_sql_contains("reason", R.WARNING_REASON_PARTS), "WARNING")], "'INFO'")


@query("p8_abstract_type", f"SELECT eid, {ABSTRACT} AS abstract_type FROM episodes")
def p8(x):
    return x.episodes.select("eid", K.abstract_type(F.col("reason")).alias("abstract_type"))


@query("p9_event_severity", f"SELECT eid, CASE WHEN etype = 'k8s.event' THEN CASE WHEN severity = 'INFO' THEN 'INFO' ELSE 'WARNING' END ELSE {GUESSED} END AS severity FROM episodes")
def p9(x):
    kind = F.when(F.col("etype") == "k8s.event", F.when(F.col("severity") == "INFO", "Normal").otherwise("Warning")).otherwise("other")
    return x.episodes.select("eid", K.event_severity(kind, F.col("reason")).alias("severity"))


@query("p10_service_from_labels", "SELECT client_id, 'pod:' || ns || ':' || name AS rid, app AS service FROM pods")
def p10(x):
    pods = x.resources.where("kind = 'Pod'")
    labels = F.when(F.col("team") == "team-1", F.create_map(F.lit("k8s-app"), F.col("app"))).otherwise(
        F.create_map(F.lit("app"), F.col("app"), F.lit("k8s-app"), F.lit("other")))
    return pods.select("client_id", "rid", K.service_of(labels).alias("service"))


LOG_SEVERITY = r"""CASE WHEN s = 'INFO' AND (contains(low, 'exception') OR contains(low, 'traceback') OR contains(low, 'stack trace')) THEN 'ERROR'
    WHEN s = 'INFO' AND (contains(low, 'fatal error') OR contains(low, 'panic') OR contains(low, 'segfault')) THEN 'FATAL'
    WHEN s = 'INFO' AND (contains(low, 'failed') OR contains(low, 'failure') OR contains(low, 'cannot')) THEN 'WARNING' ELSE s END"""
LOG_TABLES = {"lines": LINES, "l1": r"""SELECT *, lower(line) AS low, CASE WHEN level IN ('debug','trace') THEN 'DEBUG' WHEN level IN ('warn','warning') THEN 'WARNING'
      WHEN level IN ('error','critical') THEN 'ERROR' WHEN level IN ('fatal','panic') THEN 'FATAL' ELSE 'INFO' END AS s0 FROM lines""",
    "l2": r"""SELECT *, CASE regexp_extract(line, '^([IWEF])\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+', 1) WHEN 'I' THEN 'INFO' WHEN 'W' THEN 'WARNING' WHEN 'E' THEN 'ERROR' WHEN 'F' THEN 'FATAL' ELSE s0 END AS s1 FROM l1""",
    "l3": r"""SELECT *, CASE WHEN regexp_matches(low, '^(debug:|\[debug\])') THEN 'DEBUG' WHEN regexp_matches(low, '^(info:|\[info\])') THEN 'INFO'
      WHEN regexp_matches(low, '^(warn:|warning:|\[warn\])') THEN 'WARNING' WHEN regexp_matches(low, '^(error:|\[error\]|err:)') THEN 'ERROR'
      WHEN regexp_matches(low, '^(fatal:|\[fatal\]|panic:)') THEN 'FATAL' ELSE s1 END AS s FROM l2""",
    "sev": f"SELECT id, line, low, level, {LOG_SEVERITY} AS severity FROM l3"}


def _severity_lines(x):
    rows = _lines(x).withColumn("low", F.lower("line"))
    return rows.withColumn("severity", K.log_severity(F.col("line"), F.col("level"), F.lit(None).cast("string"), F.col("low")))


@query("p11_log_severity", "SELECT id, severity FROM sev", LOG_TABLES)
def p11(x):
    return _severity_lines(x).select("id", "severity")


@query("p12_unwrap_json", "SELECT id, md5(line) AS digest FROM lines", {"lines": LINES})
def p12(x):
    """Lines wrapped in JSON no, one or two times, by the length of the line."""
    one = F.to_json(F.struct(F.col("line").alias("message")))
    two = F.to_json(F.struct(one.alias("log")))
    n = F.length("line") % 3
    wrapped = F.when(n == 0, F.col("line")).when(n == 1, one).otherwise(two)
    return _lines(x).select("id", F.md5(records.unwrap(wrapped)).alias("digest"))


WRAPPED = {"lines": LINES, "wrapped": "SELECT id, line, length(line) % 3 AS n FROM lines"}


@query("p12_merged_fields", """SELECT id, md5(line) AS digest, CASE n WHEN 0 THEN '' WHEN 1 THEN 'attempt,level' ELSE 'attempt,level,pod' END AS names,
    CASE n WHEN 1 THEN 'warn' WHEN 2 THEN 'error' END AS level, CASE WHEN n > 0 THEN length(line) END AS attempt, CASE WHEN n = 2 THEN 'p-' || id END AS pod_name FROM wrapped""", WRAPPED)
def p12_merged(x):
    """Lines inside no, one or two JSON records with fields of their own; a level occurs in both."""
    attempt = F.length("line").cast("long").alias("attempt")
    one = F.to_json(F.struct(F.col("line").alias("message"), F.lit("warn").alias("level"), attempt))
    inner = F.to_json(F.struct(F.col("line").alias("message"), F.lit("error").alias("level"), F.struct(F.concat(F.lit("p-"), "id").alias("name")).alias("pod")))
    two = F.to_json(F.struct(inner.alias("log"), F.lit("warn").alias("level"), attempt))
    n = F.length("line") % 3
    rows = records.merge_record(_lines(x).select("id", "line"), F.when(n == 0, F.col("line")).when(n == 1, one).otherwise(two))
    names = F.array_join(F.array_sort(F.map_keys("fields")), ",")
    of = lambda name, path, kind: F.try_variant_get(F.try_element_at("fields", F.lit(name)), path, kind)
    return rows.select("id", F.md5("line").alias("digest"), F.coalesce(names, F.lit("")).alias("names"), records.field(F.col("fields"), "level").alias("level"),
                       of("attempt", "$", "bigint").alias("attempt"), of("pod", "$.name", "string").alias("pod_name"))


@query("p13_log_error_type", "SELECT id, coalesce(" + _sql_case([(f"regexp_matches(line, '(?i){p}')", v) for p, v in R.LOG_ERROR_PATTERNS], "NULL") + ", '') AS error_type FROM lines", {"lines": LINES})
def p13(x):
    return _lines(x).select("id", F.coalesce(K.log_error_type(F.col("line")), F.lit("")).alias("error_type"))


@query("p14_stack_trace", r"""SELECT doc_id, md5(array_to_string(list_filter(string_split('x.Exception' || chr(10) || '  at ' || replace(text, chr(10), chr(10) || ' at '), chr(10)),
    lambda v: starts_with(trim(v, ' ' || chr(9) || chr(13)), 'at '))[1:10], chr(10))) AS digest FROM documents""")
def p14(x):
    """Every document as the frames of a Java trace."""
    msg = F.concat(F.lit("x.Exception\n  at "), F.replace("text", F.lit("\n"), F.lit("\n at ")))
    return x.raw("documents").select("doc_id", F.md5(K.stack_trace(msg)).alias("digest"))


@query("p15_log_level", """SELECT id, CASE WHEN level IS NOT NULL THEN CASE level WHEN 'info' THEN 'INFO' WHEN 'warning' THEN 'WARNING' WHEN 'error' THEN 'ERROR' WHEN 'panic' THEN 'CRITICAL' ELSE 'INFO' END
    WHEN regexp_matches(line, '(?i)(fatal|critical|panic)') THEN 'CRITICAL' WHEN regexp_matches(line, '(?i)error') THEN 'ERROR' WHEN regexp_matches(line, '(?i)(warn|warning)') THEN 'WARNING' ELSE 'INFO' END AS level,
    CAST(length(substr(line, 1, 1000)) AS INTEGER) AS kept FROM lines""", {"lines": LINES})
def p15(x):
    return _lines(x).select("id", K.log_level(F.col("line"), F.col("level")).alias("level"), F.length(F.substring("line", 1, 1000)).alias("kept"))


CATEGORY = _sql_case([("severity IN ('ERROR','FATAL')", "severity")] + [
    ("(" + " OR ".join("(" + " AND ".join(f"contains(low, '{t}')" for t in terms) + ")" for terms in alts) + ")", name)
    for name, alts in R.HIGH_SIGNAL_LOGS], "NULL")


@query("p16_high_signal_logs", f"SELECT id, category FROM (SELECT id, {CATEGORY} AS category FROM sev) WHERE category IS NOT NULL", LOG_TABLES)
def p16(x):
    rows = _severity_lines(x).select("id", K.high_signal_category(F.col("severity"), F.col("low")).alias("category"))
    return records.high_signal(rows)


@query("p17_log_reason", "SELECT id, " + _sql_case([(_sql_contains("low", p), v) for p, v in R.LOG_REASONS] + [("severity = 'FATAL'", "LOG_FATAL"), ("severity = 'ERROR'", "LOG_ERROR"), ("severity = 'WARNING'", "LOG_WARNING")], "'LOG_INFO'") + " AS reason FROM sev", LOG_TABLES)
def p17(x):
    return _severity_lines(x).select("id", K.log_reason(F.col("severity"), F.col("low")).alias("reason"))


@query("p18_log_subject", "SELECT eid AS log_key, 'Pod' AS s_kind, CASE WHEN etype = 'k8s.log' THEN 'a-' || eid WHEN etype = 'prom.alert' THEN 'b-' || eid ELSE '' END AS s_uid, s_ns, s_name FROM episodes")
def p18(x):
    e = x.episodes
    none = F.lit(None).cast("string")
    raw = e.select(F.col("eid").alias("key"), "client_id", "t", "message", none.alias("log"), none.alias("level"), none.alias("severity"),
                   F.when(F.col("etype") == "k8s.log", F.concat(F.lit("a-"), "eid")).otherwise("").alias("pod_uid"),
                   F.col("s_ns").alias("pod_namespace"), F.col("s_name").alias("pod_name"),
                   F.struct(F.when(F.col("etype") == "prom.alert", F.concat(F.lit("b-"), "eid")).alias("pod_uid")).alias("kubernetes"), "eid")
    logs = records.normalize_logs(raw.withColumn("key", F.col("eid")))
    keyed = raw.select(F.col("eid").alias("log_key"), "client_id", "t", "pod_namespace", "pod_name")
    return logs.join(keyed, [logs["t"] == keyed["t"], logs["client_id"] == keyed["client_id"], logs["s_name"] == keyed["pod_name"]]).select(
        "log_key", "s_kind", F.coalesce("s_uid", F.lit("")).alias("s_uid"), "s_ns", "s_name")


def _webhooks(x):
    """Alerts packed into webhooks per (tenant, resource, day)."""
    a = x.episodes.where("etype = 'prom.alert'")
    labels = F.create_map(F.lit("alertname"), F.col("reason"), F.lit("severity"), F.lower("severity"),
                          F.lit("eid"), F.col("eid"), F.lower("s_kind"), F.col("s_name"))
    alert = F.struct(F.lit("firing").alias("status"), labels.alias("labels"),
                     F.create_map(F.lit("summary"), F.col("message")).alias("annotations"),
                     F.lit("").alias("startsAt"), F.lit("").alias("endsAt"),
                     F.when(F.col("severity") == "INFO", "").otherwise(F.md5("eid")).alias("fingerprint"))
    day = F.floor(F.col("t") / C.DAY_US)
    g = a.groupBy("client_id", "rid", "s_ns", day.alias("day")).agg(F.collect_list(alert).alias("alerts"))
    body = F.struct(F.lit("firing").alias("status"), F.lit("hooks").alias("receiver"), F.when(F.col("day") % 2 == 0, F.col("rid")).otherwise("").alias("groupKey"),
                    F.create_map(F.lit("namespace"), F.col("s_ns"), F.lit("alertname"), F.lit("ignored")).alias("commonLabels"),
                    F.create_map(F.lit("job"), F.col("client_id")).alias("groupLabels"), "alerts")
    return g.select(F.to_json(body).alias("value")).select(F.from_json("value", schemas.ALERT_WEBHOOK).alias("v")).select("v.*")


@query("s4_explode_alerts", "SELECT eid, client_id AS job, CASE WHEN s_ns = '' THEN '' ELSE s_ns END AS namespace, reason AS alertname, message AS summary FROM episodes WHERE etype = 'prom.alert'")
def s4(x):
    a = A.explode_alerts(_webhooks(x))
    return a.select(F.col("labels")["eid"].alias("eid"), F.col("labels")["job"].alias("job"), F.col("labels")["namespace"].alias("namespace"),
                    F.col("labels")["alertname"].alias("alertname"), F.col("annotations")["summary"].alias("summary"))


@query("s8_stable_alert_key", """SELECT eid, CASE WHEN severity <> 'INFO' THEN md5(eid) WHEN (t // 86400000000) % 2 = 0 THEN rid
    ELSE client_id || '|' || CASE WHEN s_ns = '' THEN 'default' ELSE s_ns END || '|' || CASE WHEN s_kind = 'Service' THEN s_name ELSE client_id END END AS key FROM episodes WHERE etype = 'prom.alert'""")
def s8(x):
    a = A.explode_alerts(_webhooks(x))
    return a.select(F.col("labels")["eid"].alias("eid"), A.stable_key(F.col("fingerprint"), F.col("groupKey"), F.col("labels")).alias("key"))


@query("p19_alerts_to_events", """SELECT eid, reason, CASE WHEN severity IN ('WARNING','INFO') THEN severity ELSE 'WARNING' END AS severity, message, s_kind,
    CASE WHEN s_ns = '' THEN 'default' ELSE s_ns END AS s_ns, s_name FROM episodes WHERE etype = 'prom.alert'""")
def p19(x):
    a = A.explode_alerts(_webhooks(x)).withColumn("eid", F.col("labels")["eid"])
    return A.alerts_to_events(a).select("eid", "reason", "severity", "message", "s_kind", "s_ns", "s_name")


@query("p20_alert_type", "SELECT eid, " + lookup_case("reason", R.ALERT_TYPES, _sql_case([(_sql_contains("lower(reason)", p), v) for p, v in R.ALERT_TYPE_PARTS], "'custom'")) + " AS fault_type, CASE WHEN severity IN ('WARNING','INFO') THEN lower(severity) ELSE 'warning' END AS severity FROM episodes")
def p20(x):
    return x.episodes.select("eid", K.alert_type(F.col("reason")).alias("fault_type"), K.alert_severity(F.col("severity")).alias("severity"))


@query("p21_cluster_event_type", "SELECT eid, " + lookup_case("reason", R.CLUSTER_REASON_TYPES, "CASE WHEN severity = 'WARNING' THEN 'error_rate_high' ELSE 'custom' END") + " AS event_type, CASE severity WHEN 'WARNING' THEN 'warning' WHEN 'ERROR' THEN 'critical' ELSE 'info' END AS severity FROM episodes")
def p21(x):
    kind = F.initcap("severity")
    return x.episodes.select("eid", K.cluster_event_type(F.col("reason"), kind).alias("event_type"), K.cluster_event_severity(kind).alias("severity"))


@query("p22_fault_type", f"SELECT eid, {lookup_case('a', R.FAULT_TYPES, chr(39) + 'custom' + chr(39))} AS fault_type FROM (SELECT eid, {ABSTRACT} AS a FROM episodes)")
def p22(x):
    return x.episodes.select("eid", K.fault_type(K.abstract_type(F.col("reason"))).alias("fault_type"))


@query("p23_signature", "SELECT eid, reason || '|' || regexp_replace(service, '-[^-]{9,}$', '-*') || '|' || severity AS signature FROM episodes")
def p23(x):
    return x.episodes.select("eid", K.signature(F.col("reason"), F.col("service"), F.col("severity")).alias("signature"))


@query("p24_pattern_matches", """SELECT p.reason AS p_kind, p.ps AS p_service, count(*) AS n FROM (SELECT DISTINCT reason, severity, regexp_replace(service, '-[^-]{9,}$', '-*') AS ps FROM episodes WHERE severity = 'FATAL') p
  JOIN episodes e ON e.reason = p.reason AND e.severity = p.severity AND (CASE WHEN ends_with(ps, '*') THEN starts_with(e.service, replace(ps, '*', '')) ELSE e.service = ps END) GROUP BY 1, 2""")
def p24(x):
    p = x.episodes.where("severity = 'FATAL'").select(F.col("reason").alias("p_kind"), F.col("severity").alias("p_severity"),
                                                      K.service_pattern(F.col("service")).alias("p_service")).distinct()
    e = x.episodes.select("reason", "severity", "service")
    return e.join(p, K.pattern_accepts(F.col("reason"), F.col("service"), F.col("severity"), F.col("p_kind"), F.col("p_service"), F.col("p_severity"))
                  ).groupBy("p_kind", "p_service").agg(F.count("*").alias("n"))


@query("p25_message_category", """SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(line, 'Database') THEN 'Database Errors' WHEN contains(line, 'timeout') THEN 'Timeout Errors' WHEN contains(line, 'HTTP') THEN 'HTTP Errors'
    WHEN contains(line, 'exception') OR contains(line, 'Exception') THEN 'Exceptions' WHEN contains(line, 'Failed') OR contains(line, 'failed') THEN 'Operation Failures' ELSE 'Other' END AS category FROM lines) GROUP BY 1""", {"lines": LINES})
def p25(x):
    return _lines(x).groupBy(K.message_category(F.col("line")).alias("category")).agg(F.count("*").alias("n"))


@query("p26_bands", """SELECT CASE WHEN confidence >= 0.9 THEN '0.90-1.00 (High)' WHEN confidence >= 0.7 THEN '0.70-0.89 (Medium-High)' WHEN confidence >= 0.5 THEN '0.50-0.69 (Medium)' WHEN confidence >= 0.3 THEN '0.30-0.49 (Low-Medium)' ELSE '0.00-0.29 (Low)' END AS band,
    CASE WHEN m < 1 THEN '< 1 min' WHEN m < 5 THEN '1-5 min' WHEN m < 15 THEN '5-15 min' ELSE '15-60 min' END AS gap, count(*) AS n FROM (SELECT *, time_gap_seconds // 60 AS m FROM links) GROUP BY 1, 2""")
def p26(x):
    return x.links.groupBy(C.confidence_band(F.col("confidence")).alias("band"), C.gap_band(F.floor(F.col("time_gap_seconds") / 60)).alias("gap")).agg(F.count("*").alias("n"))


@query("p27_filtered_events", "SELECT eid, rid FROM episodes, clock WHERE client_id = 'tenant-1' AND s_ns IN ('ns-1','ns-2') AND s_kind = 'Pod' AND severity IN ('ERROR','FATAL') AND t >= now - 1728000000000 AND contains(lower(message), 'timeout')")
def p27(x):
    from causalspark.operators.search import filter_events
    return filter_events(x.episodes, client_id="tenant-1", namespaces=["ns-1", "ns-2"], kinds=["Pod"], severities=["ERROR", "FATAL"], hours=480, text="timeout").select("eid", "rid")


@query("p28_label_match", "SELECT client_id, 'pod:' || ns || ':' || name AS rid FROM pods WHERE team = 'team-2'")
def p28(x):
    m = F.create_map(F.lit("team"), F.col("team"), F.lit("app"), F.col("app"))
    return x.resources.where("kind = 'Pod'").where(F.try_element_at(m, F.lit("team")) == "team-2").select("client_id", "rid")


@query("p29_status_match", "SELECT client_id, rid FROM resources WHERE regexp_matches(phase, '(?i)(failed|crashloop|pending)')")
def p29(x):
    status = F.to_json(F.struct(F.struct("phase").alias("status")))
    return x.resources.where(F.rlike(F.get_json_object(status, "$.status.phase"), F.lit("(?i)(failed|crashloop|pending)"))).select("client_id", "rid")


@query("p30_search_text", "SELECT eid, reason || ' | ' || severity || ' | ' || s_kind || CASE WHEN s_ns = '' THEN '' ELSE ' | ' || s_ns END || ' | ' || s_name || ' | ' || message AS body FROM episodes")
def p30(x):
    return x.episodes.select("eid", C.search_text(F.col("reason"), F.col("severity"), F.col("s_kind"), F.col("s_ns"), F.col("s_name"), F.col("message")).alias("body"))


@query("p31_event_ids", f"SELECT eid, 'evt-' || substr(sha256(eid || ':' || {TEXT_TIME}), 1, 16) AS hashed, md5(message) AS cache_key, sha1(CAST(t AS STRING) || '|' || etype || '|' || s_ns || '/' || s_name || '|' || reason) AS fallback FROM episodes")
def p31(x):
    return x.episodes.select("eid", F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws(":", "eid", C.text_time(F.col("t"))), 256), 1, 16)).alias("hashed"),
                             F.md5("message").alias("cache_key"), F.sha1(F.concat_ws("|", F.col("t").cast("string"), "etype", F.concat_ws("/", "s_ns", "s_name"), "reason")).alias("fallback"))


@query("p32_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM documents")
def p32(x):
    return x.raw("documents").select("doc_id", C.preview(F.col("text")).alias("shown"))


@query("p33_rounding", f"SELECT eid, {r3('value / 7.0')} AS r3, {r3('value / 7.0', 2)} AS r2 FROM (SELECT eid, CAST(value AS DOUBLE) AS value FROM episodes)".replace("/ 7.0", "/ CAST(7.0 AS DOUBLE)"))
def p33(x):
    v = F.col("value") / 7.0
    return x.episodes.select("eid", C.round_to(v).alias("r3"), C.round_to(v, 2).alias("r2"))


@query("p34_client_log_level", "SELECT id, level, 'client::' || id AS key FROM (SELECT id, " + _sql_case([(_sql_contains("line", ["ERROR", "error", "Error"]), "ERROR"), (_sql_contains("line", ["FATAL", "fatal", "Fatal"]), "FATAL"), (_sql_contains("line", ["WARN", "warn", "Warning"]), "WARN")], "'INFO'") + " AS level FROM lines) WHERE level IN ('ERROR','FATAL','WARN')", {"lines": LINES})
def p34(x):
    rows = _lines(x).select("id", K.client_log_level(F.col("line")).alias("level"), F.concat_ws("::", F.lit("client"), "id").alias("key"))
    return rows.where(F.col("level").isin("ERROR", "FATAL", "WARN"))


# --- sources and sinks ---------------------------------------------------------------------

def _topic_path(x):
    """The events as JSON topic files in the shared folder."""
    from causalspark.session import shared_folder
    folder = "".join(c if c.isalnum() else "_" for c in x.directory)
    path = f"{shared_folder(x.spark)}/topics/{folder}"
    body = topics.to_records(x.episodes.select("client_id", "eid", "t", "reason", "severity", "rid", "etype"), "events.normalized",
                             F.col("client_id"), F.col("eid"))
    body.withColumn("topic", F.when(F.get_json_object("value", "$.etype") == "k8s.log", "logs.normalized").otherwise(F.col("topic"))).withColumn(
        "timestamp", F.get_json_object("value", "$.t").cast("long")).withColumn("offset", F.col("timestamp")).write.mode("overwrite").json(path)
    return path


@query("s1_read_topic", "SELECT client_id || '::' || eid AS key, client_id, eid, t, reason FROM episodes WHERE etype <> 'k8s.log'")
def s1(x):
    rows = topics.read_topic(x.spark, "events.normalized", path=_topic_path(x))
    from pyspark.sql import types as T
    return topics.parsed(rows, T.StructType.fromDDL("client_id STRING, eid STRING, t BIGINT, reason STRING")).select("key", "client_id", "eid", "t", "reason")


@query("s2_expired_rows", """SELECT topic, count(*) AS n FROM (SELECT t, CASE etype WHEN 'k8s.log' THEN 'logs.normalized' WHEN 'prom.alert' THEN 'alerts.normalized' ELSE 'events.normalized' END AS topic FROM episodes), clock
    WHERE t < now - 86400000000 * CASE topic WHEN 'logs.normalized' THEN 3 WHEN 'alerts.normalized' THEN 30 ELSE 7 END GROUP BY 1""")
def s2(x):
    topic = F.when(F.col("etype") == "k8s.log", "logs.normalized").when(F.col("etype") == "prom.alert", "alerts.normalized").otherwise("events.normalized")
    return topics.expired(x.episodes.withColumn("topic", topic)).groupBy("topic").agg(F.count("*").alias("n"))


@query("s3_bounded_replay", "SELECT client_id, eid, t FROM episodes, clock WHERE t >= now - 604800000000 AND s_ns = 'ns-1' AND contains(s_name, 'pod-') QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY t DESC, eid) <= 1000")
def s3(x):
    return topics.bounded_replay(x.episodes, 7 * 1440, "ns-1", "pod-").select("client_id", "eid", "t")


@query("s5_target_changes", """SELECT client_id, name AS target_id, CASE WHEN phase = 'Failed' THEN 'DELETE' ELSE 'UPSERT' END AS op FROM pods WHERE phase <> 'Pending' OR TRUE""")
def s5(x):
    pods = x.resources.where("kind = 'Pod'").select("client_id", F.col("name").alias("target_id"), "phase")
    before = pods.where("phase <> 'Pending'").drop("phase")
    return A.target_changes(before, pods.where("phase <> 'Failed'").drop("phase"))


@query("s7_publish_records", "SELECT client_id || '::' || eid AS key, 'events.normalized' AS topic, '{\"client_id\":\"' || client_id || '\",\"eid\":\"' || eid || '\",\"reason\":\"' || reason || '\"}' AS value FROM episodes")
def s7(x):
    return topics.to_records(x.episodes.select("client_id", "eid", "reason"), "events.normalized", F.col("client_id"), F.col("eid"))


@query("s9_export_documents", "SELECT client_id || '::' || id AS doc_id, '{\"client_id\":\"' || client_id || '\",\"src\":\"' || src || '\",\"dst\":\"' || dst || '\",\"id\":\"' || id || '\"}' AS doc FROM edges")
def s9(x):
    return export.json_documents(x.edges.select("client_id", "src", "dst", "id"), "client_id", "id")


@query("s10_tenants", "SELECT client_id, count(*) AS n, 'events' AS source FROM episodes GROUP BY 1 UNION ALL SELECT client_id, count(*), 'resources' FROM resources GROUP BY 1 UNION ALL SELECT client_id, count(*), 'changes' FROM resource_changes GROUP BY 1")
def s10(x):
    return topics.tenants(events=x.episodes, resources=x.resources, changes=x.resource_changes)


@query("s11_write_snapshot", "SELECT CAST(CAST(make_timestamp(t) AS DATE) AS STRING) AS day, count(*) AS n FROM episodes GROUP BY 1")
def s11(x):
    """Written by day, read back by day (the read prunes on the folder)."""
    from causalspark.session import shared_folder
    folder = "".join(c if c.isalnum() else "_" for c in x.directory)
    path = f"{shared_folder(x.spark)}/snapshots/{folder}"
    export.write_snapshot(x.episodes, path)
    return x.spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
