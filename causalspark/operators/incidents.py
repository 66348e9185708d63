"""Windows over events: escalation, incidents, anomalies, alert groups, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.functions.scalar import DAY_US, HOUR_US, MINUTE_US, blank_to_null, is_failure, joined, round_to
from causalspark.operators import reach
from causalspark.operators.timejoin import (
    islands, latest, near_join, numbered, slice_of, sliding, top_per)

RESOURCE = ["client_id", "rid"]


def escalate_severity(episodes: DataFrame, window_min: int = 5, threshold: int = 3) -> DataFrame:
    """Repeats of a reason on a resource inside ``[t - w, t]`` raise WARNING and ERROR by one.

    ``severity_raw`` keeps the reported value; link scoring uses that one.
    """
    rows = sliding(episodes, RESOURCE + ["reason"], window_min * MINUTE_US, 0,
                   {"_n": ("count", F.lit(1))})
    raised = F.col("severity").isin("WARNING", "ERROR") & (F.col("_n") - 1 >= threshold)
    return (rows.withColumn("severity_raw", F.col("severity"))
            .withColumn("escalated", raised)
            .withColumn("repeat_count", F.when(raised, F.col("_n") - 1).otherwise(F.lit(0)))
            .withColumn("severity", F.when(raised & (F.col("severity") == "WARNING"), "ERROR")
                        .when(raised, "FATAL").otherwise(F.col("severity"))).drop("_n"))


def cluster_incidents(episodes: DataFrame, window_min: int = 15, min_related: int = 2
                      ) -> DataFrame:
    """One candidate incident per failure: its resource and the window around it.

    An event is related when it lies in the window and it or the failure is ERROR/FATAL, so a
    failure relates to everything in its window; members are the rows of that interval.
    """
    w = window_min * MINUTE_US
    rows = sliding(episodes, RESOURCE, w, w, {"event_count": ("count", F.lit(1))})
    return (rows.where(is_failure(F.col("severity")) & (F.col("event_count") - 1 >= min_related))
            .select("client_id", F.col("rid").alias("resource_id"), F.col("eid"),
                    (F.col("t") - w).alias("window_start"), (F.col("t") + w).alias("window_end"),
                    "event_count", "severity"))


def cluster_members(clusters: DataFrame, episodes: DataFrame, window_min: int = 15) -> DataFrame:
    """Member events of clustered incidents (client_id, eid of the failure, member)."""
    w = window_min * MINUTE_US
    c = clusters.select("client_id", F.col("resource_id").alias("rid"), "eid",
                        (F.col("window_start") + w).alias("c_t"))
    e = episodes.select("client_id", "rid", F.col("eid").alias("member"), F.col("t").alias("e_t"))
    return near_join(c, e, RESOURCE, w).select("client_id", "eid", "member")


def _sessions(episodes: DataFrame, gap_min: int) -> DataFrame:
    fail = episodes.where(is_failure(F.col("severity")))
    return islands(fail, RESOURCE, gap_min * MINUTE_US, {
        "n": F.count("*"), "fatal": F.count(F.when(F.col("severity") == "FATAL", 1))})


def incident_id(client: Column, resource: Column, start: Column) -> Column:
    return F.concat(F.lit("inc-"), F.substring(F.md5(
        joined("|", client, resource, start)), 1, 12))


def sessionize_incidents(episodes: DataFrame, gap_min: int = 15, min_events: int = 3,
                         as_of=None, open_hours: int = 24) -> DataFrame:
    """Incidents as gap sessions of failures on one resource."""
    now = latest(episodes, as_of)
    out = (_sessions(episodes, gap_min).groupBy("client_id", "rid", "island")
           .agg(F.max("_last").alias("window_end"), F.sum("n").alias("event_count"),
                F.sum("fatal").alias("fatal"))
           .where(F.col("event_count") >= min_events))
    return out.select(
        incident_id(F.col("client_id"), F.col("rid"), F.col("island")).alias("incident_id"),
        "client_id", F.col("rid").alias("resource_id"), F.col("island").alias("window_start"),
        "window_end", "event_count",
        F.when(F.col("fatal") > 0, "FATAL").otherwise("ERROR").alias("severity"),
        F.when(now - F.col("window_end") <= open_hours * HOUR_US, "open")
        .otherwise("resolved").alias("status"))


def session_members(episodes: DataFrame, gap_min: int = 15, min_events: int = 3) -> DataFrame:
    """(incident_id, client_id, eid) of :func:`sessionize_incidents`."""
    gap = gap_min * MINUTE_US
    slices = _sessions(episodes, gap_min)
    size = slices.groupBy("client_id", "rid", "island").agg(F.sum("n").alias("size"))
    kept = (slices.select("client_id", "rid", "_slice", "island")
            .join(size.where(F.col("size") >= min_events), ["client_id", "rid", "island"]))
    fail = episodes.where(is_failure(F.col("severity"))).withColumn(
        "_slice", slice_of(F.col("t"), gap))
    return fail.join(kept, RESOURCE + ["_slice"]).select(
        incident_id(F.col("client_id"), F.col("rid"), F.col("island")).alias("incident_id"),
        "client_id", "eid", "rid", "t", "reason", "severity", "message")


def incident_timeline(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members in time order, with the number of true root causes of each."""
    caused = links.select("client_id", F.col("effect").alias("cause")).distinct()
    roots = (links.join(caused, ["client_id", "cause"], "left_anti")
             .groupBy("client_id", F.col("effect").alias("eid"))
             .agg(F.count("*").alias("root_causes"),
                  F.max_by("cause", F.struct("confidence", "cause")).alias("best_root")))
    out = members.join(roots, ["client_id", "eid"], "left").na.fill(0, ["root_causes"]).na.fill(
        "", ["best_root"])
    return numbered(out, ["client_id", "incident_id"], ["t", "eid"], DAY_US, "step")


def around_incident(episodes: DataFrame, incidents: DataFrame, minutes: int = 30) -> DataFrame:
    """Events of the tenant around the start of each incident, with the signed offset."""
    c = incidents.select("client_id", "incident_id", F.col("window_start").alias("c_t"))
    e = episodes.select("client_id", "eid", "reason", "severity", F.col("t").alias("e_t"))
    off = F.col("e_t") - F.col("c_t")
    return near_join(c, e, ["client_id"], minutes * MINUTE_US).select(
        "client_id", "incident_id", "eid", "reason", off.alias("offset_us"),
        F.when(off < 0, "before").when(off == 0, "start").otherwise("after").alias("marker"))


def impactful_incidents(incidents: DataFrame, limit: int = 10) -> DataFrame:
    minutes = F.floor((F.col("window_end") - F.col("window_start")) / MINUTE_US)
    weight = F.when(F.col("severity") == "FATAL", 10).when(F.col("severity") == "ERROR", 5).otherwise(1)
    scored = incidents.withColumn("duration_minutes", minutes).withColumn("impact_score", round_to(
        weight * F.col("event_count") * (F.col("duration_minutes") / 60.0), 3))
    return top_per(scored, ["client_id"], [F.desc("impact_score"), "incident_id"], limit)


def error_spike(episodes: DataFrame, as_of=None, recent_min: int = 15, baseline_hours: int = 24,
                ratio: float = 3.0) -> DataFrame:
    """Failures of the last minutes against the average of the baseline, in one pass."""
    now = latest(episodes, as_of)
    slots = baseline_hours * 60.0 / recent_min
    fail = episodes.where(is_failure(F.col("severity"))
                          & (F.col("t") >= now - baseline_hours * HOUR_US))
    counts = fail.groupBy("client_id").agg(
        F.count(F.when(F.col("t") >= now - recent_min * MINUTE_US, 1)).alias("current_errors"),
        (F.count("*") / slots).alias("average_errors"))
    spike = F.col("current_errors") / F.when(F.col("average_errors") > 0,
                                             F.col("average_errors")).otherwise(F.lit(1.0))
    return (counts.withColumn("spike_ratio", spike).where(F.col("spike_ratio") >= ratio)
            .withColumn("severity", F.when(F.col("spike_ratio") >= 5, "critical").otherwise("high")))


def error_spike_series(episodes: DataFrame, slot_min: int = 15, slots: int = 96,
                       ratio: float = 3.0) -> DataFrame:
    """Every slot against the average of the ``slots`` that end with it (empty slots count 0)."""
    width = slot_min * MINUTE_US
    counted = (episodes.where(is_failure(F.col("severity")))
               .groupBy("client_id", slice_of(F.col("t"), width).alias("slot"))
               .agg(F.count("*").alias("errors")))
    w = W.partitionBy("client_id").orderBy("slot").rangeBetween(-(slots - 1), 0)
    avg = F.sum("errors").over(w) / float(slots)
    return (counted.withColumn("average_errors", avg)
            .withColumn("spike_ratio", F.col("errors") / F.col("average_errors"))
            .where(F.col("spike_ratio") >= ratio))


def rate_anomalies(episodes: DataFrame, window_min: int = 5, per_minute: float = 10.0,
                   same_reason: int = 10, oom: int = 3) -> DataFrame:
    """Tumbling windows that break a rate rule; one row per rule and key.

    Two grouped passes with partial aggregation; nothing is kept per event.
    """
    slot = slice_of(F.col("t"), window_min * MINUTE_US)
    fail = episodes.where(is_failure(F.col("severity")))
    by_severity = (fail.groupBy("client_id", slot.alias("slot"), F.col("severity").alias("what"))
                   .agg(F.count("*").alias("n"))
                   .where(F.col("n") / float(window_min) > per_minute)
                   .withColumn("anomaly", F.lit("error_spike")))
    reasons = (fail.groupBy("client_id", slot.alias("slot"), F.col("reason").alias("what"))
               .agg(F.count("*").alias("n")))
    labels = F.array_compact(F.array(
        F.when(F.col("n") > same_reason, F.lit("cascading_failure")),
        F.when(F.col("what").isin("OOMKilled", "LOG_OOM_KILLED") & (F.col("n") > oom),
               F.lit("memory_leak"))))
    by_reason = reasons.withColumn("anomaly", F.explode(labels))
    return by_severity.unionByName(by_reason)


def operation_churn(changes: DataFrame, window_min: int = 5, limit: int = 50) -> DataFrame:
    """Kinds with more than ``limit`` change operations in a tumbling window."""
    return (changes.groupBy("client_id", "kind", slice_of(F.col("t"), window_min * MINUTE_US)
                            .alias("slot")).agg(F.count("*").alias("operations"))
            .where(F.col("operations") > limit))


def churn_ratio(episodes: DataFrame, resources: DataFrame, hours: int = 1, as_of=None,
                ratio: float = 3.0) -> DataFrame:
    """State changes per resource of a kind and namespace."""
    now = latest(episodes, as_of)
    keys = ["client_id", "kind", "ns"]
    n = resources.where(F.col("kind").isin("Pod", "Service")).groupBy(*keys).agg(
        F.count("*").alias("resource_count"))
    changes = episodes.where(F.col("reason").isin("Created", "Deleted", "FailedScheduling")
                             & (F.col("t") >= now - hours * HOUR_US)).groupBy(
        "client_id", F.col("s_kind").alias("kind"), F.col("s_ns").alias("ns")).agg(
        F.count("*").alias("state_changes"))
    return (n.join(changes, keys).where(F.col("state_changes") > F.col("resource_count") * ratio)
            .withColumn("churn_ratio", F.col("state_changes") / F.col("resource_count")))


def memory_leaks(episodes: DataFrame, hours: int = 6, as_of=None, min_ooms: int = 3) -> DataFrame:
    """Resources with repeated OOMs; accelerating when the last gap is shorter than the first.

    First two and last two times come from partial aggregates, so no list is collected: the
    second time is the least one above the first, found after a join on the small extremes.
    """
    now = latest(episodes, as_of)
    oom = episodes.where(F.col("reason").isin("OOMKilled", "LOG_OOM_KILLED")
                         & (F.col("t") >= now - hours * HOUR_US)).select(*RESOURCE, "t", "eid")
    ends = oom.groupBy(*RESOURCE).agg(
        F.count("*").alias("oom_count"), F.min(F.struct("t", "eid")).alias("lo"),
        F.max(F.struct("t", "eid")).alias("hi")).where(F.col("oom_count") >= min_ooms)
    at = F.struct("t", "eid")
    inner = oom.join(ends, RESOURCE).groupBy(*RESOURCE).agg(
        F.first("oom_count").alias("oom_count"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.min(F.when(at > F.col("lo"), at)).alias("lo2"),
        F.max(F.when(at < F.col("hi"), at)).alias("hi2"))
    first = F.floor((F.col("lo2.t") - F.col("lo.t")) / MINUTE_US)
    last = F.floor((F.col("hi.t") - F.col("hi2.t")) / MINUTE_US)
    return inner.select(*RESOURCE, "oom_count", first.alias("first_interval_min"),
                        last.alias("last_interval_min"), (last < first).alias("is_accelerating"))


def cascading_failures(episodes: DataFrame, edges: DataFrame, window_min: int = 15, as_of=None,
                       min_errors: int = 5, min_related: int = 3) -> DataFrame:
    """Resources with many failures whose neighbours within two hops fail as well.

    Distances are followed between sets of twins, resources with the same neighbours: pods alike under a node, a service
    and a controller are one vertex, so their pairs are not formed. Without twins the pairs within two hops are.
    """
    now = latest(episodes, as_of)
    counts = episodes.where(is_failure(F.col("severity"))
                            & (F.col("t") >= now - window_min * MINUTE_US)).groupBy(
        *RESOURCE).agg(F.count("*").alias("error_count"))
    und = reach.undirected(edges)
    twin = reach.twins(und)
    known = counts.join(twin, RESOURCE)
    errors = known.groupBy("client_id", F.col("twin").alias("other")).agg(F.sum("error_count").alias("n"))
    step = (und.join(twin.select("client_id", F.col("rid").alias("a"), "twin"), ["client_id", "a"])
            .join(twin.select("client_id", F.col("rid").alias("b"), F.col("twin").alias("other")), ["client_id", "b"])
            .select("client_id", "twin", "other").distinct())
    two = step.select("client_id", "twin", F.col("other").alias("mid")).join(
        step.select("client_id", F.col("twin").alias("mid"), "other"), ["client_id", "mid"]).select("client_id", "twin", "other")
    # A resource is two steps from itself, so the sum within two steps has its own errors too.
    around = step.unionByName(two).distinct().join(errors, ["client_id", "other"]).groupBy("client_id", "twin").agg(F.sum("n").alias("n"))
    return (known.where(F.col("error_count") >= min_errors).join(around, ["client_id", "twin"])
            .withColumn("related_errors", F.col("n") - F.col("error_count"))
            .where((F.col("related_errors") > 0) & (F.col("related_errors") >= min_related))
            .select(*RESOURCE, "error_count", "related_errors"))


def anomaly_report(episodes: DataFrame, window_min: int = 5) -> DataFrame:
    """Peak rates per minute and severity, peak counts per failing reason."""
    slot = slice_of(F.col("t"), window_min * MINUTE_US)
    counted = episodes.groupBy("client_id", slot.alias("slot"), "severity", "reason").agg(
        F.count("*").alias("n"))
    sev = counted.groupBy("client_id", "slot", "severity").agg(F.sum("n").alias("n"))
    rates = sev.groupBy("client_id", F.col("severity").alias("item")).agg(
        (F.max("n") / float(window_min)).alias("peak")).withColumn("metric", F.lit("events_per_minute"))
    why = counted.where(is_failure(F.col("severity"))).groupBy("client_id", "slot", "reason").agg(
        F.sum("n").alias("n"))
    patterns = why.groupBy("client_id", F.col("reason").alias("item")).agg(
        F.max("n").cast("double").alias("peak")).withColumn("metric", F.lit("error_pattern"))
    return rates.unionByName(patterns)


def alert_fingerprint() -> Column:
    """Lower case; a missing reason or severity is ``unknown``, other missing parts are empty."""
    known = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit("unknown"))
    return F.lower(joined("::", known("reason"), known("severity"), "s_kind", "s_ns", F.substring("message", 1, 50)))


def group_alerts(alerts: DataFrame, gap_min: int = 5, max_size: int = 100) -> DataFrame:
    """Group alerts by fingerprint: gap sessions, cut into groups of at most ``max_size``.

    Each input row gets an action: ``new`` opens a group, ``grouped`` joins it, ``duplicate``
    repeats an event id of the fingerprint.
    """
    gap = gap_min * MINUTE_US
    keys = ["client_id", "fingerprint"]
    rows = alerts.withColumn("fingerprint", alert_fingerprint())
    copies = W.partitionBy(*keys, "eid").orderBy("t")
    rows = rows.withColumn("_copy", F.row_number().over(copies))
    fresh = rows.where("_copy = 1")
    slices = islands(fresh, keys, gap, {"_n": F.count("*")})
    before = W.partitionBy(*keys, "island").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*keys, "_slice", "island",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_slice").orderBy("t", "eid")
    placed = (fresh.withColumn("_slice", slice_of(F.col("t"), gap))
              .withColumn("_row", F.row_number().over(inside)).join(slices, keys + ["_slice"])
              .withColumn("_pos", F.col("_row") + F.col("_offset") - 1))
    group = F.substring(F.md5(joined("|", "client_id", "fingerprint", "island", F.floor(F.col("_pos") / max_size))), 1, 16)
    placed = placed.withColumn("group_id", group).withColumn(
        "action", F.when(F.col("_pos") % max_size == 0, "new").otherwise("grouped"))
    known = placed.select(*keys, "eid", "group_id")
    again = (rows.where("_copy > 1").join(known, keys + ["eid"])
             .withColumn("action", F.lit("duplicate")))
    cols = [*keys, "eid", "t", "rid", "reason", "severity", "group_id", "action"]
    return placed.select(cols).unionByName(again.select(cols))


def alert_group_summary(grouped: DataFrame) -> DataFrame:
    fresh = grouped.where("action <> 'duplicate'")
    return fresh.groupBy("client_id", "group_id", "fingerprint", "reason", "severity").agg(
        F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count("*").alias("alerts"),
        F.countDistinct("rid").alias("affected_resources"))


def alert_group_stats(grouped: DataFrame) -> DataFrame:
    total, fresh = F.count("*"), F.count(F.when(F.col("action") != "duplicate", 1))
    groups = F.count(F.when(F.col("action") == "new", 1))
    return grouped.groupBy("client_id").agg(
        total.alias("received"), fresh.alias("accepted"), groups.alias("groups"),
        round_to((1.0 - groups / total) * 100.0, 2).alias("dedup_rate"))


ACTIVE_REASONS = ["Failed", "BackOff", "Unhealthy", "OOMKilled", "Error", "CrashLoopBackOff",
                  "FailedScheduling"]


def active_incidents(episodes: DataFrame, links: DataFrame, minutes: int = 15, as_of=None
                     ) -> DataFrame:
    """Recent failure events with effects, by severity band, with the most confident cause."""
    now = latest(episodes, as_of)
    recent = episodes.where(F.col("reason").isin(ACTIVE_REASONS)
                            & (F.col("t") >= now - minutes * MINUTE_US))
    down = links.groupBy("client_id", F.col("cause").alias("eid")).agg(
        F.count("*").alias("blast_radius"))
    top = links.groupBy("client_id", F.col("effect").alias("eid")).agg(
        F.max_by("cause", F.struct("confidence", "cause")).alias("top_cause"),
        F.max("confidence").alias("cause_confidence"))
    out = (recent.select("client_id", "eid", "reason", "rid", "t")
           .join(down, ["client_id", "eid"]).join(top, ["client_id", "eid"], "left")
           .na.fill(0, ["cause_confidence"]).na.fill("", ["top_cause"]))
    blast, reason = F.col("blast_radius"), F.col("reason")
    band = (F.when((blast > 20) | reason.isin("OOMKilled", "CrashLoopBackOff"), "critical")
            .when((blast > 10) | reason.isin("Failed", "BackOff"), "high")
            .when(blast > 5, "medium").otherwise("low"))
    return out.withColumn("severity", band)


def alert_batches(alerts: DataFrame, size: int = 3, keep: int = 2) -> DataFrame:
    """Analysis batches of an alert buffer: a batch starts when ``size`` alerts are held, and
    the last ``keep`` of them stay in the buffer."""
    step = size - keep
    n = numbered(alerts, ["client_id"], ["t", "eid"], DAY_US, "n")
    batch = n.withColumn("batch", F.explode(F.sequence(F.col("n"), F.col("n") + (size - 1)))
                         ).where((F.col("batch") - size) % step == 0)
    last = n.groupBy("client_id").agg(F.max("n").alias("last_n"))
    return (batch.join(last, "client_id").where((F.col("batch") >= size)
                                                & (F.col("batch") <= F.col("last_n")))
            .select("client_id", F.concat_ws("-", F.lit("fault"), "client_id",
                                             F.col("batch").cast("string")).alias("fault_id"),
                    "eid", "t"))


def assign_faults(events: DataFrame, keys: list[str], gap_min: int = 30) -> DataFrame:
    """``fault_id`` per gap session of the keys."""
    gap = gap_min * MINUTE_US
    slices = islands(events, keys, gap, {"n": F.count("*")}).select(*keys, "_slice", "island")
    return (events.withColumn("_slice", slice_of(F.col("t"), gap)).join(slices, keys + ["_slice"])
            .withColumn("fault_id", joined("|", *keys, "island"))
            .drop("_slice", "island"))


def liveness(heartbeats: DataFrame, keys: list[str], as_of=None, stale_min: int = 2,
             dead_min: int = 5) -> DataFrame:
    """active / stale / dead by the time since the last heartbeat."""
    now = latest(heartbeats, as_of)
    last = heartbeats.groupBy(*keys).agg(F.max("t").alias("last_seen"))
    age = now - F.col("last_seen")
    return last.withColumn("age_us", age).withColumn(
        "status", F.when(age > dead_min * MINUTE_US, "dead").when(age > stale_min * MINUTE_US, "stale")
        .otherwise("active"))
