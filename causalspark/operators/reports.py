"""Grouped reports. Every report is one or two partial aggregations; sides are summed before
they are joined, and distinct counts go through pre-grouped keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.functions.scalar import (
    DAY_US, HOUR_US, MICROS, MINUTE_US, confidence_band, gap_band, is_failure, round_to)
from causalspark.operators.timejoin import latest, numbered, top_per


def _count() -> Column:
    return F.count("*")


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def share(counted: DataFrame, column: str = "n", digits: int = 2, by: list[str] | None = None) -> DataFrame:
    """Add the percentage of the total to a small grouped frame."""
    total = F.sum(column).over(W.partitionBy(*(by or [])))
    return counted.withColumn("percentage", round_to(F.col(column) * 100.0 / total, digits))


def mean_score(column: str) -> Column:
    """Average of three-decimal scores, summed as integers so that the order does not matter."""
    thousandths = F.sum(F.round(F.col(column) * 1000).cast("long"))
    return F.floor(thousandths / F.count(column) + 0.5) / 1000.0


def counted(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(_count().alias("n"))


def distinct_sample(column: str, k: int) -> Column:
    """First ``k`` distinct values in order (value vocabularies are small)."""
    return F.slice(F.array_sort(F.collect_set(column)), 1, k)


# --- statistics of the graph and of events ---------------------------------------------------

def graph_stats(resources: DataFrame, edges: DataFrame, episodes: DataFrame, incidents: DataFrame
                ) -> DataFrame:
    """(client_id, metric, item, n); one pass per table gives totals and groups together."""
    def both(df, metric, column):
        g = df.groupingSets([[F.col("client_id"), F.col(column)], [F.col("client_id")]],
                            "client_id", column).agg(_count().alias("n"), F.grouping(column).alias("g"))
        return g.select("client_id", F.when(F.col("g") == 1, metric + "_total").otherwise(metric).alias("metric"),
                        F.when(F.col("g") == 1, "").otherwise(F.col(column)).alias("item"), "n")
    return _union([both(resources, "resources", "kind"), both(episodes, "events", "severity"),
                   both(edges, "edges", "type"), both(incidents, "incidents", "status")])


def hourly_rates(episodes: DataFrame) -> DataFrame:
    hour = F.floor(F.col("t") / HOUR_US)
    level = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s.lower())
    return episodes.groupBy("client_id", hour.alias("hour")).agg(
        _count().alias("total"), *[level(s) for s in ("FATAL", "ERROR", "WARNING", "INFO")])


def top_reasons(episodes: DataFrame, limit: int = 10) -> DataFrame:
    rows = share(counted(episodes.where(is_failure(F.col("severity"))), "client_id", "reason"), by=["client_id"])
    return top_per(rows, ["client_id"], [F.desc("n"), "reason"], limit)


def error_prone_resources(episodes: DataFrame, min_errors: int = 5) -> DataFrame:
    fail = episodes.where(is_failure(F.col("severity")))
    return (fail.groupBy("client_id", "rid").agg(
        _count().alias("errors"), F.count(F.when(F.col("severity") == "FATAL", 1)).alias("fatal"),
        F.array_sort(F.collect_set("reason")).alias("reasons")).where(F.col("errors") >= min_errors))


def recurring_failures(episodes: DataFrame, min_count: int = 3) -> DataFrame:
    fail = episodes.where(is_failure(F.col("severity")))
    out = fail.groupBy("client_id", "rid", "reason").agg(
        _count().alias("n"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
    return out.where(F.col("n") >= min_count).withColumn(
        "duration_min", F.floor((F.col("last_seen") - F.col("first_seen")) / MINUTE_US))


def error_sequences(episodes: DataFrame, min_length: int = 3) -> DataFrame:
    """Failures of each resource in order, one row per step (a list per resource would grow
    with the resource's history)."""
    fail = episodes.where(is_failure(F.col("severity"))).select("client_id", "rid", "t", "eid", "reason")
    size = fail.groupBy("client_id", "rid").agg(_count().alias("length")).where(F.col("length") >= min_length)
    return numbered(fail.join(size, ["client_id", "rid"]), ["client_id", "rid"], ["t", "eid"], DAY_US, "step")


def reason_spans(episodes: DataFrame, reasons: list[str]) -> DataFrame:
    return episodes.where(F.col("reason").isin(reasons)).groupBy("client_id", "rid", "reason").agg(
        _count().alias("n"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


# --- link reports ----------------------------------------------------------------------------

SCORES = ["confidence", "temporal_score", "distance_score", "domain_score"]


def link_stats(links: DataFrame) -> DataFrame:
    cols = [f(c).alias(f"{n}_{c}") for c in SCORES for n, f in (("min", F.min), ("max", F.max))]
    avgs = [mean_score(c).alias(f"avg_{c}") for c in SCORES]
    return links.groupBy("client_id").agg(_count().alias("links"), *cols, *avgs)


def null_scores(links: DataFrame) -> DataFrame:
    return links.groupBy("client_id").agg(_count().alias("links"), *[
        F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in SCORES])


def confidence_histogram(links: DataFrame) -> DataFrame:
    g = links.groupBy("client_id", confidence_band(F.col("confidence")).alias("band")).agg(
        _count().alias("n"), mean_score("confidence").alias("average"))
    return share(g, by=["client_id"])


def links_per_event(links: DataFrame) -> DataFrame:
    per = links.groupBy("client_id", "effect").agg(_count().alias("causes"))
    return share(per.groupBy("client_id", "causes").agg(_count().alias("n")), by=["client_id"])


def gap_distribution(links: DataFrame) -> DataFrame:
    minutes = F.floor(F.col("time_gap_seconds") / 60).cast("long")
    g = links.select("client_id", minutes.alias("m")).groupBy("client_id", gap_band(F.col("m")).alias("band")).agg(
        _count().alias("n"), F.min("m").alias("min_minutes"), F.max("m").alias("max_minutes"), F.sum("m").alias("sum_minutes"))
    return share(g, by=["client_id"]).withColumn("avg_minutes", round_to(F.col("sum_minutes") / F.col("n"), 2)).drop("sum_minutes")


def reason_pairs(named: DataFrame, limit: int | None = None) -> DataFrame:
    g = named.groupBy("client_id", "c_reason", "e_reason").agg(
        _count().alias("n"), mean_score("confidence").alias("average"))
    return top_per(g, ["client_id"], [F.desc("n"), "c_reason", "e_reason"], limit) if limit else g


def severity_transitions(named: DataFrame) -> DataFrame:
    return share(counted(named, "client_id", "c_severity", "e_severity"), by=["client_id"])


def common_root_causes(named: DataFrame, limit: int = 15, etype: str | None = None) -> DataFrame:
    rows = named.where(F.col("c_etype") == etype) if etype else named
    # effects are grouped first, so the distinct count needs no second copy of the rows
    per = rows.groupBy("client_id", "c_reason", "c_severity", "effect", "e_reason").agg(_count().alias("_"))
    g = per.groupBy("client_id", "c_reason", "c_severity").agg(
        _count().alias("symptoms"), F.array_join(distinct_sample("e_reason", 5), "|").alias("examples"))
    return top_per(g, ["client_id"], [F.desc("symptoms"), "c_reason", "c_severity"], limit)


def many_causes(links: DataFrame, at_least: int = 5) -> DataFrame:
    return links.groupBy("client_id", "effect").agg(
        _count().alias("causes"), F.max("confidence").alias("best"),
        F.min("confidence").alias("least")).where(F.col("causes") >= at_least)


def rca_coverage(episodes: DataFrame, links: DataFrame, *by: str) -> DataFrame:
    """Failures with and without a known cause, with a rating."""
    explained = links.select("client_id", F.col("effect").alias("eid")).distinct().withColumn("_hit", F.lit(1))
    fail = episodes.where(is_failure(F.col("severity"))).join(explained, ["client_id", "eid"], "left")
    g = fail.groupBy(*by).agg(_count().alias("errors"), F.count("_hit").alias("with_causes"))
    orphan = (F.col("errors") - F.col("with_causes")) * 100.0 / F.col("errors")
    return (g.withColumn("without_causes", F.col("errors") - F.col("with_causes"))
            .withColumn("coverage_percent", round_to(100.0 - orphan, 2))
            .withColumn("rating", F.when(orphan < 30, "Excellent").when(orphan < 50, "Good")
                        .when(orphan < 70, "Fair").otherwise("Poor")))


def confidence_percentiles(links: DataFrame) -> DataFrame:
    """Exact percentiles from the counts per value: confidences have three decimals, so at most
    a thousand values are kept per tenant."""
    freq = links.groupBy("client_id", "confidence").agg(_count().alias("n"))
    q = F.percentile("confidence", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("n")).alias("q")
    g = freq.groupBy("client_id").agg(q, F.min("confidence").alias("min"), F.max("confidence").alias("max"))
    return g.select("client_id", "min", "max", *[round_to(F.col("q")[i], 6).alias(p)
                                                 for i, p in enumerate(("p50", "p90", "p99"))])


# --- dashboards ------------------------------------------------------------------------------

def readiness(episodes: DataFrame, links: DataFrame, resources: DataFrame) -> DataFrame:
    """One row per tenant; each side is one aggregate row before the join."""
    e = episodes.groupBy("client_id").agg(
        _count().alias("events"), F.count(F.when(is_failure(F.col("severity")), 1)).alias("errors"),
        F.countDistinct("reason").alias("event_types"))
    l = links.groupBy("client_id").agg(_count().alias("links"))
    r = resources.groupBy("client_id").agg(_count().alias("resources"))
    out = e.join(l, "client_id", "left").join(r, "client_id", "left").na.fill(0)
    per = F.col("links") * 100.0 / F.col("errors")
    return out.withColumn("links_per_error", round_to(per, 2)).withColumn(
        "status", F.when((F.col("links") > 20000) & (F.col("event_types") > 30) & (per > 500), "ready")
        .when(F.col("links") > 1000, "adequate").otherwise("insufficient"))


def pattern_confidence(named: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Average confidence of known (cause, effect) reasons."""
    known = F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in patterns])
    hit = F.exists(known, lambda p: (p["col1"] == F.col("c_reason")) & (p["col2"] == F.col("e_reason")))
    return reason_pairs(named.where(hit))


def catalogue(resources: DataFrame) -> DataFrame:
    """Namespaces with counts and kinds."""
    return resources.groupBy("client_id", "ns").agg(
        _count().alias("resources"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))


def resource_catalogue(resources: DataFrame, episodes: DataFrame, depends: DataFrame, hours: int = 24,
                       offset: int = 0, limit: int = 50, as_of=None) -> DataFrame:
    """Page of each tenant's resources with recent events, number of outgoing edges, and the number of resources."""
    recent = episodes.where(F.col("t") >= latest(episodes, as_of) - hours * HOUR_US).groupBy(
        "client_id", "rid").agg(_count().alias("events"), F.count(F.when(is_failure(F.col("severity")), 1)).alias("errors"))
    out = depends.groupBy("client_id", F.col("src").alias("rid")).agg(_count().alias("dependencies"))
    rows = (resources.select("client_id", "rid", "kind").join(recent, ["client_id", "rid"], "left")
            .join(out, ["client_id", "rid"], "left").na.fill(0))
    total = resources.groupBy("client_id").agg(_count().alias("total"))
    return top_per(rows, ["client_id"], [F.desc("events"), "rid"], limit, offset).join(total, "client_id")


def catalogue_dependencies(page: DataFrame, edges: DataFrame) -> DataFrame:
    """(client_id, rid, position, dependency, type): what each resource of a page points to, as rows, once per relation.

    ``position`` counts from 1 by dependency and type; a resource without dependencies has no row. A page holds a
    bounded number of resources for each tenant, so only their edges are sorted.
    """
    ends = edges.select("client_id", F.col("src").alias("rid"), F.col("dst").alias("dependency"), "type").join(
        page.select("client_id", "rid"), ["client_id", "rid"], "left_semi").distinct()
    w = W.partitionBy("client_id", "rid").orderBy("dependency", "type")
    return ends.withColumn("position", F.row_number().over(w))


def node_distribution(pods: DataFrame) -> DataFrame:
    return pods.groupBy("client_id", "node").agg(
        _count().alias("pods"), F.array_join(F.array_sort(F.collect_set("ns")), "|").alias("namespaces"))


def tenant_comparison(resources: DataFrame, episodes: DataFrame) -> DataFrame:
    r = resources.where("kind = 'Pod'").groupBy("client_id").agg(
        _count().alias("pods"), F.count(F.when(F.col("phase") == "Running", 1)).alias("running"))
    e = episodes.groupBy("client_id").agg(_count().alias("events"), F.count(
        F.when(is_failure(F.col("severity")), 1)).alias("errors"))
    return r.join(e, "client_id", "left").na.fill(0).withColumn(
        "health_percent", round_to(F.col("running") * 100.0 / F.col("pods"), 2))


def alerts_by_day(episodes: DataFrame) -> DataFrame:
    return episodes.where("etype = 'prom.alert'").groupBy(
        "client_id", F.floor(F.col("t") / DAY_US).alias("day"), "severity").agg(_count().alias("alerts"))


def flapping_alerts(episodes: DataFrame, min_count: int = 5, hours: int = 24, as_of=None) -> DataFrame:
    rows = episodes.where((F.col("etype") == "prom.alert")
                          & (F.col("t") >= latest(episodes, as_of) - hours * HOUR_US))
    return rows.groupBy("client_id", "rid", "reason").agg(
        _count().alias("n"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen")).where(F.col("n") > min_count)


def deployment_scorecard(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    control = edges.where("type = 'CONTROLS'").select("client_id", "src", "dst")
    up = control.select("client_id", F.col("src").alias("deployment"), F.col("dst").alias("src"))
    pods = control.join(up, ["client_id", "src"]).select("client_id", "deployment", F.col("dst").alias("rid"))
    errors = episodes.where(is_failure(F.col("severity"))).groupBy("client_id", "rid").agg(_count().alias("errors"))
    g = pods.join(errors, ["client_id", "rid"], "left").na.fill(0).groupBy("client_id", "deployment").agg(
        _count().alias("pods"), F.sum("errors").alias("errors"),
        F.count(F.when(F.col("errors") > 0, 1)).alias("pods_with_errors"))
    return g.withColumn("status", F.when(F.col("errors") == 0, "Healthy").when(
        F.col("errors") < 10, "Warning").otherwise("Critical"))


def freshness(episodes: DataFrame, as_of=None) -> DataFrame:
    now = latest(episodes, as_of)
    g = episodes.groupBy("client_id", "etype").agg(F.max("t").alias("newest"), _count().alias("n"))
    lag = F.floor((now - F.col("newest")) / MINUTE_US)
    return g.withColumn("lag_minutes", lag).withColumn("status", F.when(F.col("lag_minutes") <= 5, "fresh").when(
        F.col("lag_minutes") <= 60, "delayed").otherwise("stale"))


def pipeline_counts(**frames: DataFrame) -> DataFrame:
    return _union([f.agg(_count().alias("n")).select(F.lit(name).alias("stage"), "n") for name, f in frames.items()])


def expectations(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """Required fields and value ranges as (check, bad) rows; zero bad rows is a pass."""
    bad = lambda cond: F.count(F.when(cond, 1))
    e = episodes.agg(*[bad(F.coalesce(F.col(c), F.lit("")) == "").alias(f"event without {c}")
                       for c in ("eid", "client_id", "reason", "severity", "rid")])
    l = links.agg(bad(~F.col("confidence").between(0, 1)).alias("confidence out of range"),
                  bad(F.col("time_gap_seconds") < 0).alias("effect before cause"),
                  bad(F.col("cause") == F.col("effect")).alias("self link"))
    def rows(df):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("bad"))
                                             for c in df.columns])).alias("r")).select("r.*")
    return rows(e).unionByName(rows(l)).withColumn("passed", F.col("bad") == 0)


def log_patterns(logs: DataFrame, limit: int = 20) -> DataFrame:
    """Most common line starts of each source."""
    g = logs.groupBy("source", "severity", F.substring("line", 1, 100).alias("pattern")).agg(_count().alias("n"))
    return top_per(g, ["source"], [F.desc("n"), "severity", "pattern"], limit)


def subject_summary(episodes: DataFrame) -> DataFrame:
    """Failures per subject with the count of its main reason, the latest failure, and a cause."""
    fail = episodes.where(is_failure(F.col("severity")))
    per = fail.groupBy("client_id", "rid", "reason").agg(
        _count().alias("n"), F.max(F.struct("t", "eid")).alias("last"))
    main = F.struct("n", "reason")
    g = per.groupBy("client_id", "rid").agg(
        F.sum("n").alias("failures"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"),
        F.max(main).alias("top"), F.max_by(F.struct("reason", "last.eid"), "last").alias("latest"))
    why = F.col("top.reason")
    cause = (F.when(why.isin("OOMKilled", "LOG_OOM_KILLED"), "memory limit").when(
        why.isin("BackOff", "CrashLoopBackOff", "Error", "Failed"), "application crash").when(
        F.contains(why, F.lit("Image")), "image").otherwise("other"))
    return g.select("client_id", "rid", "failures", "reasons", F.col("top.reason").alias("top_reason"),
                    F.col("latest.eid").alias("latest_event"), cause.alias("likely_cause"))
