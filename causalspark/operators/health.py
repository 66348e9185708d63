"""Health, service levels, validation of links, and rule-based advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import DAY_US, HOUR_US, MINUTE_US, is_failure, round_to
from causalspark.operators.paths import true_roots
from causalspark.operators.timejoin import latest, top_per


def _count() -> Column:
    return F.count("*")


def _level(name: str) -> Column:
    return F.count(F.when(F.col("severity") == name, 1))


def resource_health(resources: DataFrame, episodes: DataFrame, incidents: DataFrame, hours: int = 24,
                    as_of=None) -> DataFrame:
    """Score 0..100 from recent events and open incidents, with a status."""
    now = latest(episodes, as_of)
    ev = episodes.where(F.col("t") >= now - hours * HOUR_US).groupBy("client_id", "rid").agg(
        _count().alias("events"), _level("FATAL").alias("fatal"), _level("ERROR").alias("error"),
        _level("WARNING").alias("warning"))
    inc = incidents.where("status <> 'resolved'").groupBy("client_id", F.col("resource_id").alias("rid")).agg(
        _count().alias("incidents"))
    rows = (resources.select("client_id", "rid", "kind").join(ev, ["client_id", "rid"], "left")
            .join(inc, ["client_id", "rid"], "left").na.fill(0))
    score = 100 - 15 * F.col("incidents") - 20 * F.col("fatal") - 10 * F.col("error") - 5 * F.col("warning")
    return rows.withColumn("health_score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")).withColumn(
        "status", F.when(F.col("health_score") >= 80, "healthy").when(F.col("health_score") >= 50, "degraded")
        .otherwise("critical"))


def health_checks(health: DataFrame) -> DataFrame:
    """Five named checks per resource."""
    def check(name, column, warn_below):
        c = F.col(column)
        low = (c < warn_below[0]) if warn_below[0] else (c == 0)
        return F.struct(F.lit(name).alias("check"), c.cast("long").alias("value"),
                        F.when(low, "ok").when(c < warn_below[1], "warning").otherwise("critical").alias("state"))
    checks = [check("Active Incidents", "incidents", (0, 3)), check("Fatal Events", "fatal", (0, 5)),
              check("Error Events", "error", (0, 10)), check("Warning Events", "warning", (0, 20)),
              check("Event Frequency", "events", (50, 100))]
    return health.select("client_id", "rid", F.explode(F.array(*checks)).alias("c")).select("client_id", "rid", "c.*")


def health_ratio(resources: DataFrame, episodes: DataFrame, hours: int = 24, below: float = 0.8,
                 as_of=None) -> DataFrame:
    ev = episodes.where(F.col("t") >= latest(episodes, as_of) - hours * HOUR_US).groupBy("client_id", "rid").agg(
        _count().alias("events"), _level("ERROR").alias("errors"), _level("FATAL").alias("fatal"))
    rows = resources.where(F.col("kind").isin("Pod", "Service", "Deployment")).select("client_id", "rid", "kind").join(
        ev, ["client_id", "rid"], "left").na.fill(0)
    ratio = 1.0 - (F.col("errors") * 0.5 + F.col("fatal") * 1.0) / F.greatest(F.col("events"), F.lit(1))
    return (rows.withColumn("ratio", ratio).where(F.col("ratio") < below)
            .withColumn("health_score", round_to(F.col("ratio"), 2))
            .withColumn("status", F.when(F.col("ratio") >= 0.9, "healthy").when(F.col("ratio") >= 0.7, "degraded")
                        .when(F.col("ratio") >= 0.5, "unhealthy").otherwise("critical")).drop("ratio"))


HEALTHY = ["Running", "Active", "Healthy", "Succeeded"]
UNHEALTHY = ["Failed", "Error", "CrashLoopBackOff", "OOMKilled", "Pending", "Unknown"]


def tenant_summary(resources: DataFrame, episodes: DataFrame, links: DataFrame, incident_hours: int = 1,
                   as_of=None) -> DataFrame:
    now = latest(episodes, as_of)
    r = resources.groupBy("client_id").agg(
        F.count(F.when(F.col("phase").isin(HEALTHY) | F.col("phase").isNull(), 1)).alias("healthy"),
        F.count(F.when(F.col("phase").isin(UNHEALTHY), 1)).alias("unhealthy"), _count().alias("total"))
    recent = episodes.where(F.col("t") >= now - incident_hours * HOUR_US).select("client_id", "eid")
    active = recent.join(true_roots(links), ["client_id", "eid"], "left_semi").groupBy("client_id").agg(
        _count().alias("active_incidents"))
    return r.join(active, "client_id", "left").na.fill(0)


def top_issues(episodes: DataFrame, hours: int = 24, limit: int = 5, as_of=None) -> DataFrame:
    rows = episodes.where(F.col("t") >= latest(episodes, as_of) - hours * HOUR_US)
    g = rows.groupBy("client_id", "reason").agg(_count().alias("n"))
    w = W.partitionBy("client_id").orderBy(F.desc("n"), "reason")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


FAILING_REASONS = ["Failed", "BackOff", "Unhealthy", "OOMKilled", "Error", "CrashLoopBackOff"]


def namespace_health(resources: DataFrame, episodes: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    """Pod phases per namespace and the failures of that namespace."""
    phase = lambda p: F.count(F.when(F.col("phase") == p, 1)).alias(p.lower())
    pods = resources.where("kind = 'Pod'").groupBy("client_id", "ns").agg(
        phase("Running"), phase("Failed"), phase("Pending"),
        F.count(F.when(~F.col("phase").isin("Running", "Failed", "Pending"), 1)).alias("other"))
    err = episodes.where(F.col("reason").isin(FAILING_REASONS)
                         & (F.col("t") >= latest(episodes, as_of) - hours * HOUR_US)).groupBy(
        "client_id", F.col("s_ns").alias("ns")).agg(_count().alias("recent_errors"))
    out = pods.join(err, ["client_id", "ns"], "left").na.fill(0)
    return out.withColumn("status", F.when((F.col("failed") == 0) & (F.col("pending") == 0), "healthy")
                          .otherwise("degraded")).withColumn(
        "alarm", F.when(F.col("recent_errors") > 10, "critical").when(F.col("recent_errors") > 0, "warning")
        .otherwise("healthy"))


def service_health(pods_of: DataFrame, resources: DataFrame) -> DataFrame:
    """Services by the share of unhealthy pods; pods_of: client_id, service, pod."""
    state = resources.select("client_id", F.col("rid").alias("pod"), F.when(F.col("phase").isin(HEALTHY), 0)
                             .otherwise(1).alias("bad"))
    g = pods_of.join(state, ["client_id", "pod"]).groupBy("client_id", "service").agg(
        _count().alias("pods"), F.sum("bad").alias("unhealthy"))
    return g.withColumn("health", F.when(F.col("unhealthy") == 0, "Healthy").when(
        F.col("unhealthy") < F.col("pods"), "Degraded").otherwise("Critical"))


def sla_labels(latencies: DataFrame, limits=None) -> DataFrame:
    """Violations per operation; latencies: operation, ms."""
    limits = limits or R.SLA_LIMITS_MS
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v[i])]),
                                      F.col("operation"))
    label = F.when(F.col("ms") > pick(1), "critical").when(F.col("ms") > pick(0), "warning").otherwise("ok")
    return latencies.groupBy("operation", label.alias("label")).agg(_count().alias("n"), F.max("ms").alias("worst_ms"))


def latency_histogram(latencies: DataFrame, step_ms: int = 50) -> DataFrame:
    return latencies.groupBy("operation", (F.floor(F.col("ms") / step_ms) * step_ms).alias("from_ms")).agg(_count().alias("n"))


def incident_sla(failures: Column, analysis_seconds: Column) -> dict[str, Column]:
    slow, many = analysis_seconds > 120, failures > 10
    pick = lambda a, b, c: F.when(slow, a).when(many, b).otherwise(c)
    return {"sla_status": pick("breached", "breaching", "within_slo"),
            "sla_percentage": pick(110.0, 98.5, 95.2), "risk_budget": pick(0, 1, 3)}


# --- validation ------------------------------------------------------------------------------

def _expected(cause: Column, symptom: Column, expected=None) -> Column:
    table = expected or R.EXPECTED_CAUSES
    tests = [(symptom == s) & R.contains_any(F.lower(cause), [c.lower() for c in causes])
             for s, causes in table.items()]
    return reduce(lambda a, b: a | b, tests)


def match_ranks(named: DataFrame, episodes: DataFrame, days: int = 7, sample: int | None = None, as_of=None,
                expected=None, assume_top: bool = False) -> DataFrame:
    """Rank of the first expected cause of each recent failure that has causes.

    ``sample`` takes the latest failures of each tenant, as many as it says; all without it.
    ``assume_top`` gives rank 1 where nothing matches; strict mode leaves the rank null.
    """
    fail = episodes.where(is_failure(F.col("severity"))
                          & (F.col("t") >= latest(episodes, as_of) - days * DAY_US))
    if sample:
        fail = top_per(fail, ["client_id"], [F.desc("t"), "eid"], sample)
    rows = named.where("e_t > c_t").join(fail.select("client_id", F.col("eid").alias("effect")),
                                         ["client_id", "effect"], "left_semi")
    w = W.partitionBy("client_id", "effect").orderBy(F.desc("confidence"), F.desc("c_t"), "cause")
    ranked = rows.withColumn("pos", F.row_number().over(w))
    hit = _expected(F.col("c_reason"), F.col("e_reason"), expected)
    out = ranked.groupBy("client_id", "effect", F.col("e_reason").alias("reason")).agg(
        F.min(F.when(hit, F.col("pos"))).alias("rank"))
    return out.withColumn("rank", F.coalesce("rank", F.lit(1))) if assume_top else out


def accuracy_at_k(ranks: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    g = ranks.groupBy("client_id").agg(_count().alias("total"), F.avg("rank").alias("mean_rank"),
                  *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"k{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("correct")) for k in ks])
    out = g.select("client_id", "total", "mean_rank", F.explode(rows).alias("r")).select("client_id", "r.*", "total", "mean_rank")
    accuracy = F.col("correct") / F.greatest(F.col("total"), F.lit(1))
    return out.withColumn("accuracy", accuracy).withColumn("rating", accuracy_rating(F.col("k"), accuracy))


def accuracy_by_symptom(ranks: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    known = ranks.where(F.col("reason").isin(list(R.EXPECTED_CAUSES)))
    return known.groupBy("client_id", "reason").agg(_count().alias("total"), *[
        F.count(F.when(F.col("rank") <= k, 1)).alias(f"correct_at_{k}") for k in ks])


def accuracy_rating(k: Column, a: Column) -> Column:
    return (F.when(k == 1, F.when(a >= 0.80, "Excellent").when(a >= 0.70, "Good").when(a >= 0.60, "Fair")
                   .otherwise("Needs Improvement"))
            .when(k == 3, F.when(a >= 0.93, "Exceeds Academic Benchmark").when(a >= 0.85, "Production Ready")
                  .when(a >= 0.75, "Acceptable").otherwise("Needs Improvement"))
            .when(k == 5, F.when(a >= 0.95, "Excellent").when(a >= 0.90, "Good").otherwise("Fair"))
            .otherwise(F.when(a >= 0.95, "Excellent").otherwise("Good")))


# --- advice ----------------------------------------------------------------------------------

def recommendations(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Advice per incident: a rule applies when the text of any member has one of its parts.

    The rule flags are summed per incident; the texts themselves are never gathered.
    """
    text = F.lower(F.concat_ws(" ", "reason", "message"))
    flags = [F.max(R.contains_any(text, parts)).alias(f"f{i}") for i, (parts, *_) in enumerate(R.RECOMMENDATIONS)]
    found = members.groupBy("incident_id").agg(*flags)
    item = lambda kind, action, conf, prio: F.struct(
        F.lit(kind).alias("type"), F.lit(action).alias("action"), F.lit(conf).alias("confidence"),
        (prio if isinstance(prio, Column) else F.lit(prio)).alias("priority"))
    given = F.array_compact(F.array(*[F.when(F.col(f"f{i}"), item(*rest))
                                      for i, (_, *rest) in enumerate(R.RECOMMENDATIONS)]))
    kind, action, conf = R.RECOMMENDATION_DEFAULT
    default = item(kind, action, conf, F.when(is_failure(F.col("severity")), "high").otherwise("medium"))
    rows = incidents.join(found, "incident_id", "left").withColumn("given", F.coalesce(given, F.array()))
    rows = rows.withColumn("given", F.when(F.size("given") == 0, F.array(default)).otherwise(F.col("given")))
    return rows.select("incident_id", "client_id", F.explode("given").alias("r")).select("incident_id", "client_id", "r.*")


def list_incidents(incidents: DataFrame, severity=None, status=None, resource=None, offset: int = 0,
                   limit: int = 50) -> DataFrame:
    """A page of each tenant's incidents, latest first, with the number of incidents that match."""
    rows = incidents
    if severity:
        rows = rows.where(F.col("severity").isin(severity))
    if status:
        rows = rows.where(F.col("status").isin(status))
    if resource:
        rows = rows.where(F.contains(F.col("resource_id"), F.lit(resource)))
    page = top_per(rows, ["client_id"], [F.desc("window_start"), "incident_id"], limit, offset)
    return page.join(rows.groupBy("client_id").agg(_count().alias("total")), "client_id")


def error_summary(members: DataFrame) -> DataFrame:
    g = members.groupBy("incident_id").agg(
        _count().alias("errors"), _level("FATAL").alias("fatal"), F.countDistinct("reason").alias("reasons"),
        F.countDistinct("rid").alias("resources"))
    return g.withColumn("overall", F.when(F.col("fatal") > 0, "critical").when(F.col("errors") > 5, "high")
                        .otherwise("medium"))


def affected_resources(*frames: DataFrame) -> DataFrame:
    """(client_id, rid, source): each resource once, with the first source in argument order."""
    parts = [f.select("client_id", "rid", F.lit(i).alias("order"), "source").distinct() for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("client_id", "rid").agg(F.min_by("source", "order").alias("source"))


LEVELS = ["low", "medium", "high", "critical"]


def assess_actions(actions: DataFrame) -> DataFrame:
    """Risk of proposed actions.

    actions: action_id, action_type, command, ns, kind, name, resources, blast_radius,
    critical_incidents.
    """
    low = F.lower("command")
    by_type = R.lookup(F.col("action_type"), R.ACTION_TYPE_LEVELS, F.lit("high"))
    base = R.first_match([(F.contains(low, F.lit(p)), v) for p, v in R.ACTION_LEVELS], by_type)
    ns, name = F.lower(F.coalesce("ns", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    factors = F.array_compact(F.array(
        F.when(R.contains_any(ns, ["prod", "prd"]), F.lit("Production namespace")),
        F.when(F.col("resources") > 5, F.lit("Multiple resources affected")),
        F.when(F.col("kind").isin("StatefulSet", "PersistentVolumeClaim"), F.lit("Stateful resources")),
        F.when(R.contains_any(name, R.CRITICAL_NAME_PARTS), F.lit("Critical service")),
        F.when(F.col("blast_radius") > 20, F.lit("High blast radius")),
        F.when(F.col("critical_incidents") > 0, F.lit("Active critical incidents")),
        F.when(F.col("action_type").isin("cluster_config", "namespace_operation"), F.lit("Cluster-wide operation"))))
    serious = F.size(F.filter("factors", lambda f: f.isin(
        "Production namespace", "Stateful resources", "Critical service", "Active critical incidents",
        "Cluster-wide operation")))
    rows = actions.withColumn("base_level", base).withColumn("factors", factors).withColumn("serious", serious)
    order = F.array(*[F.lit(x) for x in LEVELS])
    up = F.element_at(order, F.least(F.lit(4), F.array_position(order, F.col("base_level")).cast("int") + 1))
    level = (F.when(F.col("serious") >= 2, up)
             .when((F.col("serious") >= 1) & (F.col("base_level") == "medium"), "high")
             .otherwise(F.col("base_level")))
    return rows.withColumn("level", level).withColumn("requires_approval", F.col("level") != "low").drop("serious")


def enrich_alerts(alerts: DataFrame, resources: DataFrame, edges: DataFrame) -> DataFrame:
    """Alerts with their resource record and the number of edges on each side."""
    r = resources.select("client_id", "rid", "phase", "node", "owner", F.lit(True).alias("known"))
    out = edges.groupBy("client_id", F.col("src").alias("rid")).agg(_count().alias("edges_out"))
    into = edges.groupBy("client_id", F.col("dst").alias("rid")).agg(_count().alias("edges_in"))
    keys = ["client_id", "rid"]
    return (alerts.join(r, keys, "left").join(out, keys, "left").join(into, keys, "left")
            .na.fill(0, ["edges_out", "edges_in"]).na.fill("", ["phase", "node", "owner"])
            .withColumn("known", F.coalesce("known", F.lit(False))))


def alert_related(alerts: DataFrame, edges: DataFrame) -> DataFrame:
    """Related resources of the alerting resources, once per resource and not per alert."""
    seen = alerts.select("client_id", "rid").distinct()
    ends = edges.select("client_id", F.col("src").alias("rid"), F.col("dst").alias("related"), "type").unionByName(
        edges.select("client_id", F.col("dst").alias("rid"), F.col("src").alias("related"), "type"))
    return seen.join(ends, ["client_id", "rid"])


def typed_findings(roots: DataFrame, steps: DataFrame, blast: DataFrame, cross: DataFrame) -> DataFrame:
    """One frame of findings; the confidence falls by .05 per rank of the root cause.

    roots: client_id, eid, blast_radius; steps and blast: client_id, root; cross: client_id.
    """
    w = W.partitionBy("client_id").orderBy(F.desc("blast_radius"), "eid")
    ranked = roots.withColumn("n", F.row_number().over(w)).where("n <= 5").withColumn("rank", F.col("n") - 1)
    conf = lambda top: round_to(top - F.col("rank") * 0.05, 2)
    three = ranked.where("rank < 3").select("client_id", F.col("eid").alias("root"), "rank")
    chain = three.join(steps.groupBy("client_id", "root").agg(_count().alias("size")), ["client_id", "root"])
    area = three.join(blast.groupBy("client_id", "root").agg(_count().alias("size")), ["client_id", "root"])
    pick = lambda df, kind, subject, c, size: df.select(
        "client_id", F.lit(kind).alias("finding"), F.col(subject).alias("subject"), c.alias("confidence"), size.alias("size"))
    parts = [pick(ranked, "root_cause", "eid", F.lit(0.85), F.col("blast_radius")),
             pick(chain, "causal_chain", "root", conf(0.90), F.col("size")),
             pick(area, "blast_radius", "root", conf(0.88), F.col("size")),
             pick(cross.groupBy("client_id").agg(_count().alias("size")).withColumn("subject", F.lit("")),
                  "cross_service", "subject", F.lit(0.92), F.col("size"))]
    return reduce(lambda a, b: a.unionByName(b), parts)
