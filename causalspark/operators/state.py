"""Current state from change logs: latest-wins merges, cascades, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.functions.scalar import DAY_US, parse_rid
from causalspark.operators.timejoin import latest


def latest_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Newest change per key by (at, offset).

    ``max_by`` keeps one row per key in each map task, so a key with a huge history sends one
    row per task through the shuffle.
    """
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("at", "offset")).alias("_row"))
    return newest.select(*keys, "_row.*")


def current_resources(changes: DataFrame) -> DataFrame:
    """Live resources; an operation DELETE or a null operation (tombstone) removes the key."""
    live = latest_rows(changes, ["client_id", "rid"])
    return live.where(F.coalesce(F.col("op"), F.lit("DELETE")) != "DELETE").drop("op")


def current_edges(changes: DataFrame, live_resources: DataFrame | None = None) -> DataFrame:
    """Live edges; with ``live_resources`` the edges of removed resources go as well."""
    live = latest_rows(changes, ["client_id", "id"])
    out = live.where(F.coalesce(F.col("op"), F.lit("DELETE")) != "DELETE").drop("op")
    return out if live_resources is None else detach(out, live_resources)


def detach(edges: DataFrame, live_resources: DataFrame) -> DataFrame:
    """Keep edges whose two ends are live."""
    ids = live_resources.select("client_id", "rid")
    return (edges.join(ids.withColumnRenamed("rid", "src"), ["client_id", "src"], "left_semi")
            .join(ids.withColumnRenamed("rid", "dst"), ["client_id", "dst"], "left_semi"))


def with_endpoint_stubs(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """Resources plus a stub row for each edge end that has no resource record."""
    ends = edges.select("client_id", F.explode(F.array("src", "dst")).alias("rid")).distinct()
    stubs = ends.join(resources.select("client_id", "rid"), ["client_id", "rid"], "left_anti")
    return (resources.withColumn("stub", F.lit(False))
            .unionByName(stubs.withColumn("stub", F.lit(True)), allowMissingColumns=True))


def with_endpoint_properties(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """As :func:`with_endpoint_stubs`, and kind, ns, name and uid of every edge end are read from its id where they are null.

    Of a resource that is no edge end nothing is filled. An id that is neither ``kind:uid`` nor ``kind:ns:name`` gives no properties.
    """
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()  # only ends of whole edges become stubs
    ends = (edges.select("client_id", F.explode(F.array("src", "dst")).alias("rid"), whole.alias("_whole")).where("rid IS NOT NULL")
            .groupBy("client_id", "rid").agg(F.max("_whole").alias("_whole"), F.lit(True).alias("_end")))
    rows = (resources.withColumn("stub", F.lit(False)).join(ends, ["client_id", "rid"], "full_outer").where("stub IS NOT NULL OR _whole")
            .withColumn("stub", F.coalesce("stub", F.lit(True))).select(*resources.columns, "stub", "_end"))
    for name in ("kind", "ns", "name", "uid"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumns({name: F.coalesce(name, F.when(F.col("_end"), part)) for name, part in parse_rid(F.col("rid")).items()}).drop("_end")


def merge_properties(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert that keeps an old property where the new value is null."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols if c in new.columns])
    joined = old.join(n, keys, "full_outer")
    return joined.select(*keys, *[
        F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c)
        for c in cols])


def upsert_episodes(episodes: DataFrame) -> DataFrame:
    """One row per (client_id, eid), the newest ``updated_at`` wins."""
    rest = [c for c in episodes.columns if c not in ("client_id", "eid")]
    return (episodes.groupBy("client_id", "eid")
            .agg(F.max_by(F.struct(*rest), "updated_at").alias("_row"))
            .select("client_id", "eid", "_row.*"))


def about(episodes: DataFrame) -> DataFrame:
    return episodes.select("client_id", "eid", "rid")


def target_scrapes(targets: DataFrame, resources: DataFrame) -> DataFrame:
    """Link each scrape target to its pod and its service by (ns, name)."""
    candidates = targets.select("client_id", "target_id", F.explode(F.array(
        F.concat(F.lit("service:"), "ns", F.lit(":"), "service"),
        F.concat(F.lit("pod:"), "ns", F.lit(":"), "pod"))).alias("rid"))
    return candidates.where("rid IS NOT NULL").join(
        resources.select("client_id", "rid"), ["client_id", "rid"], "left_semi")


def rule_scopes(rules: DataFrame, resources: DataFrame) -> DataFrame:
    """Link a rule to the service named by its labels."""
    services = resources.where("kind = 'Service'").select(
        "client_id", "ns", F.col("name").alias("service"), "rid")
    return rules.join(services, ["client_id", "ns", "service"]).select("client_id", "rule", "rid")


def rule_emits(rules: DataFrame, episodes: DataFrame) -> DataFrame:
    """A rule emits the events whose reason is the rule's name."""
    names = rules.select("client_id", F.col("rule").alias("reason")).distinct()
    return episodes.join(names, ["client_id", "reason"]).select(
        "client_id", F.col("reason").alias("rule"), "eid")


def apply_updates(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Apply a batch of CREATE / UPDATE / DELETE rows to a snapshot."""
    seen = latest_rows(updates, keys)
    gone = seen.where("op = 'DELETE'").select(*keys)
    fresh = seen.where("op <> 'DELETE'").drop("op", "at", "offset")
    kept = current.join(gone, keys, "left_anti")
    return merge_properties(kept, fresh, keys)


def update_counts(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """What a batch of updates does to each tenant's snapshot: rows created, changed and deleted."""
    seen = latest_rows(updates, keys).select(*keys, "op")
    both = seen.join(current.select(*keys, F.lit(1).alias("known")), keys, "left")
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    gone, known = F.col("op") == "DELETE", F.col("known").isNotNull()
    return both.groupBy("client_id").agg(count(~gone & ~known, "created"), count(~gone & known, "changed"), count(gone & known, "deleted"))


INCIDENT_STATES = ["open", "acknowledged", "resolved"]


def update_incidents(incidents: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field updates with a status check: (updated incidents, rejected updates)."""
    valid = F.col("new_status").isNull() | F.col("new_status").isin(INCIDENT_STATES)
    good = updates.where(valid).select("incident_id", "new_status")
    merged = incidents.join(good, "incident_id", "left").withColumn(
        "status", F.coalesce("new_status", "status")).drop("new_status")
    return merged, updates.where(~valid)


def retain(rows: DataFrame, days: float, as_of=None) -> DataFrame:
    """Rows not older than ``days``."""
    return rows.where(F.col("t") >= latest(rows, as_of) - int(days * DAY_US))


def retain_with_links(episodes: DataFrame, links: DataFrame, days: float, as_of=None
                      ) -> tuple[DataFrame, DataFrame]:
    kept = retain(episodes, days, as_of)
    ids = kept.select("client_id", "eid")
    out = (links.join(ids.withColumnRenamed("eid", "cause"), ["client_id", "cause"], "left_semi")
           .join(ids.withColumnRenamed("eid", "effect"), ["client_id", "effect"], "left_semi"))
    return kept, out


def drop_empty_incidents(incidents: DataFrame, members: DataFrame) -> DataFrame:
    return incidents.join(members.select("incident_id"), "incident_id", "left_semi")
