"""Selector expressions, network policies, storage claims, configuration users, quotas and privileged pods.

A selector is a conjunction of requirements on labels. Requirements and labels meet on posting keys: (key, value) for
``In`` and ``NotIn``, (key) for ``Exists`` and ``DoesNotExist``. A requirement that wants its posting is a hit, one that
forbids it is a violation, so one equality join and one count per (selector, pod) decide selectors with a wanted
posting. A selector that only forbids takes the pods of its namespace that violate nothing; their number is the size of the
namespace less the violators, and no pair is formed for it.

Defined cases: a null namespace is the empty one, null labels are none, a null label value is the empty string. ``In``
without values and unknown operators are never met, ``NotIn`` without values always is. A selector without requirements
takes every pod of its namespace. Repeated rows of one selector or pod count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDS = ("NotIn", "DoesNotExist")
PLACE = ["client_id", "ns"]


def requirement(key, operator: str, *values) -> Column:
    """A requirement as a column: key and values are columns, the operator is a name."""
    text = F.array(*values).cast("array<string>") if values else F.array().cast("array<string>")
    return F.struct(key.alias("key"), F.lit(operator).alias("operator"), text.alias("values"))


def from_labels(labels: Column) -> Column:
    """``matchLabels`` as requirements."""
    return F.transform(F.map_entries(labels), lambda e: F.struct(
        e["key"].alias("key"), F.lit("In").alias("operator"), F.array(e["value"]).alias("values")))


def _ns() -> Column:
    return F.coalesce("ns", F.lit("")).alias("ns")


def _requirements(selectors: DataFrame) -> DataFrame:
    """(client_id, ns, src, wanted, forbids): requirements without repeats, one row per selector."""
    every = F.array_distinct(F.coalesce("requirements", F.array()))
    return selectors.select("client_id", _ns(), F.col("rid").alias("src"), every.alias("all")).distinct().withColumn(
        "wanted", F.size(F.filter("all", lambda r: ~F.coalesce(r["operator"].isin(*FORBIDS), F.lit(False)))))


def _postings(pods: DataFrame) -> DataFrame:
    entries = F.explode(F.coalesce(F.map_entries("labels"), F.array()))
    one = pods.select("client_id", _ns(), F.col("rid").alias("dst"), entries.alias("e")).select(
        *PLACE, "dst", F.col("e.key").alias("key"), F.coalesce("e.value", F.lit("")).alias("value")).distinct()
    return one.withColumn("whole", F.lit(False)).unionByName(one.withColumn("value", F.lit("")).distinct().withColumn("whole", F.lit(True)))


def _meetings(wants: DataFrame, pods: DataFrame) -> DataFrame:
    """(client_id, ns, src, dst, hits, violations) for selectors and pods that share a posting."""
    r = wants.select(*PLACE, "src", "wanted", F.explode("all").alias("r")).select(
        *PLACE, "src", "wanted", F.col("r.key").alias("key"), F.col("r.operator").alias("operator"), F.col("r.values").alias("values"))
    whole = r.where("operator IN ('Exists', 'DoesNotExist')").select("*", F.lit("").alias("value"), F.lit(True).alias("whole"))
    each = r.where("operator IN ('In', 'NotIn')").select("*", F.explode(F.array_distinct(F.transform(
        "values", lambda v: F.coalesce(v, F.lit(""))))).alias("value"), F.lit(False).alias("whole"))
    asked = whole.unionByName(each).withColumn("bad", F.col("operator").isin(*FORBIDS)).drop("operator", "values")
    return asked.join(_postings(pods), [*PLACE, "key", "value", "whole"]).groupBy(*PLACE, "src", "dst").agg(
        F.count(F.when(~F.col("bad"), 1)).alias("hits"), F.count(F.when(F.col("bad"), 1)).alias("violations"), F.first("wanted").alias("wanted"))


def selected(selectors: DataFrame, pods: DataFrame) -> DataFrame:
    """(client_id, ns, src, dst): the pods of each selector.

    selectors: client_id, ns, rid, requirements array<struct<key, operator, values>>; pods: client_id, ns, rid, labels.
    """
    wants = _requirements(selectors)
    met = _meetings(wants, pods)
    wanted = met.where("wanted > 0 AND hits = wanted AND violations = 0").select(*PLACE, "src", "dst")
    open_ones = wants.where("wanted = 0").select(*PLACE, "src")
    everyone = pods.select("client_id", _ns(), F.col("rid").alias("dst")).distinct()
    rest = open_ones.join(everyone, PLACE).join(met.where("wanted = 0 AND violations > 0").select(*PLACE, "src", "dst"),
                                                [*PLACE, "src", "dst"], "left_anti")
    return wanted.unionByName(rest)


def selected_counts(selectors: DataFrame, pods: DataFrame) -> DataFrame:
    """(client_id, ns, src, pods): the size of each selector, zero included; what only forbids is counted by complement."""
    wants = _requirements(selectors)
    met = _meetings(wants, pods).groupBy(*PLACE, "src").agg(
        F.count(F.when((F.col("hits") == F.col("wanted")) & (F.col("violations") == 0), 1)).alias("takers"),
        F.count(F.when(F.col("violations") > 0, 1)).alias("violators"))
    sizes = pods.select("client_id", _ns(), "rid").distinct().groupBy(*PLACE).agg(F.count("*").alias("size"))
    rows = wants.join(met, [*PLACE, "src"], "left").join(sizes, PLACE, "left").na.fill(0, ["takers", "violators", "size"])
    count = F.when(F.col("wanted") > 0, F.col("takers")).otherwise(F.col("size") - F.col("violators"))
    return rows.select(*PLACE, "src", count.cast("long").alias("pods"))


def pod_isolation(policies: DataFrame, pods: DataFrame) -> DataFrame:
    """(client_id, ns, rid, ingress, egress): policies of each direction that take the pod; without one it is open.

    policies: as selectors, with directions array<string> of Ingress and Egress (null: Ingress).
    """
    ways = F.coalesce("directions", F.array(F.lit("Ingress")))
    named = policies.groupBy("client_id", _ns(), F.col("rid").alias("src")).agg(
        F.max(F.array_contains(ways, "Ingress").cast("int")).alias("i"), F.max(F.array_contains(ways, "Egress").cast("int")).alias("e"))
    taken = selected(policies, pods).join(named, [*PLACE, "src"]).groupBy(*PLACE, F.col("dst").alias("rid")).agg(
        F.sum("i").alias("ingress"), F.sum("e").alias("egress"))
    return pods.select("client_id", _ns(), "rid").distinct().join(taken, [*PLACE, "rid"], "left").na.fill(0, ["ingress", "egress"])


def claim_bindings(claims: DataFrame, volumes: DataFrame, mounts: DataFrame) -> DataFrame:
    """(client_id, ns, claim, volume, state, capacity, pods): every claim, and every volume without one.

    claims: client_id, ns, name, volume; volumes: client_id, name, claim_ns, claim_name, capacity; mounts: client_id,
    ns, pod, claim. A claim is Pending (names no volume), Lost (the volume is gone), Mismatched (the volume names another
    claim) or Bound; a volume that no claim names is Available (names none either), Released (its claim is gone) or Reserved.
    """
    c = claims.select("client_id", _ns(), F.col("name").alias("claim"), "volume").distinct()
    v = volumes.select("client_id", F.col("name").alias("volume"), F.coalesce("claim_ns", F.lit("")).alias("v_ns"), "claim_name", "capacity",
                       F.lit(True).alias("there")).distinct()
    users = mounts.groupBy("client_id", _ns(), "claim").agg(F.count_distinct("pod").alias("pods"))
    own = (F.col("v_ns") == F.col("ns")) & F.col("claim_name").eqNullSafe(F.col("claim"))
    bound = c.join(v, ["client_id", "volume"], "left").withColumn("state", F.when(F.col("volume").isNull(), "Pending").when(
        F.col("there").isNull(), "Lost").when(own, "Bound").otherwise("Mismatched"))
    free = v.join(c.where("volume IS NOT NULL").select("client_id", "volume"), ["client_id", "volume"], "left_anti")
    known = c.select("client_id", F.col("ns").alias("v_ns"), F.col("claim").alias("claim_name"), F.lit(True).alias("known")).distinct()
    free = free.join(known, ["client_id", "v_ns", "claim_name"], "left").select(
        "client_id", F.lit("").alias("ns"), F.lit(None).cast("string").alias("claim"), "volume", "capacity",
        F.when(F.col("claim_name").isNull(), "Available").when(F.col("known").isNull(), "Released").otherwise("Reserved").alias("state"))
    columns = ["client_id", "ns", "claim", "volume", "state", "capacity"]
    return bound.select(*columns).unionByName(free.select(*columns)).join(
        users, ["client_id", "ns", "claim"], "left").na.fill(0, ["pods"])


def config_usage(pods: DataFrame, configs: DataFrame) -> DataFrame:
    """(client_id, ns, kind, name, users, state): used and unused configurations, and missing ones that pods name.

    pods: client_id, ns, rid, refs array<struct<kind, name>>; configs: client_id, ns, kind, name (ConfigMap, Secret).
    """
    key = [*PLACE, "kind", "name"]
    used = config_users(pods).groupBy(*key).agg(F.count("*").alias("users"))
    have = configs.select("client_id", _ns(), "kind", "name").distinct().withColumn("there", F.lit(True))
    return have.join(used, key, "full_outer").select(*key, F.coalesce("users", F.lit(0)).alias("users"), F.when(
        F.col("there").isNull(), "missing").when(F.col("users").isNull(), "unused").otherwise("used").alias("state"))


def config_users(pods: DataFrame) -> DataFrame:
    """(client_id, ns, kind, name, rid): each pod with each configuration it names, once."""
    return pods.select("client_id", _ns(), "rid", F.explode(F.filter("refs", lambda r: r["name"].isNotNull())).alias("r")).select(
        *PLACE, F.col("r.kind").alias("kind"), F.col("r.name").alias("name"), "rid").distinct()


def quota_usage(quotas: DataFrame, resources: DataFrame, near: float = 0.8) -> DataFrame:
    """(client_id, ns, kind, hard, used, state): resources of a kind in the namespace against its smallest limit."""
    limits = quotas.groupBy("client_id", _ns(), "kind").agg(F.min("hard").alias("hard"))
    used = resources.select("client_id", _ns(), "kind", "rid").distinct().groupBy(*PLACE, "kind").agg(F.count("*").alias("used"))
    rows = limits.join(used, [*PLACE, "kind"], "left").na.fill(0, ["used"])
    state = (F.when(F.col("hard").isNull(), "unlimited").when(F.col("used") > F.col("hard"), "exceeded")
             .when(F.col("used") == F.col("hard"), "full").when(F.col("used") >= F.col("hard") * near, "near").otherwise("ok"))
    return rows.withColumn("state", state)


def privileged_pods(pods: DataFrame) -> DataFrame:
    """Pods with a privileged container or user 0, with ``findings``; pods: privileged boolean, run_as_user long (nulls: no)."""
    findings = F.array_compact(F.array(F.when(F.col("privileged"), "privileged"), F.when(F.col("run_as_user") == 0, "runs as root")))
    return pods.withColumn("findings", F.array_join(findings, ", ")).where("findings <> ''")


def ingress_routes(ingresses: DataFrame) -> DataFrame:
    """ROUTES_TO edges from each ingress (client_id, ns, rid, backends array<string>) to the services of its namespace."""
    each = ingresses.select("client_id", _ns(), F.col("rid").alias("src"), F.explode(F.array_distinct("backends")).alias("name"))
    routes = each.where("name IS NOT NULL").select("client_id", "src", F.concat(F.lit("service:"), "ns", F.lit(":"), "name").alias("dst"))
    return routes.distinct().withColumn("type", F.lit("ROUTES_TO")).withColumn("id", F.concat(F.lit("edge:"), "src", F.lit("->"), "dst"))


def node_failure_reach(edges: DataFrame) -> DataFrame:
    """(client_id, node, kind, rid, share): pods, services and ingresses that a failing node reaches.

    ``share`` is the part that goes with the node: of a service its pods, of an ingress the services left without pods.
    The counts are of distinct rows, formed per (service, node) before services and ingresses meet.
    """
    part = lambda kind: edges.where(F.col("type") == kind).select("client_id", "src", "dst").distinct()
    on = part("RUNS_ON").withColumnsRenamed({"src": "pod", "dst": "node"})
    backs = part("SELECTS").withColumnsRenamed({"src": "service", "dst": "pod"})
    routes = part("ROUTES_TO").withColumnsRenamed({"src": "ingress", "dst": "service"})
    here = backs.join(on, ["client_id", "pod"]).groupBy("client_id", "node", "service").agg(F.count_distinct("pod").alias("lost"))
    total = backs.groupBy("client_id", "service").agg(F.count("*").alias("all"))
    services = here.join(total, ["client_id", "service"]).withColumn("share", F.col("lost") / F.col("all"))
    fronts = routes.groupBy("client_id", "ingress").agg(F.count("*").alias("all"))
    ingresses = services.join(routes, ["client_id", "service"]).groupBy("client_id", "node", "ingress").agg(
        F.count(F.when(F.col("share") == 1, 1)).alias("down")).join(fronts, ["client_id", "ingress"])
    shape = lambda rows, kind, rid, share: rows.select("client_id", "node", F.lit(kind).alias("kind"), F.col(rid).alias("rid"), share.alias("share"))
    return (shape(on, "Pod", "pod", F.lit(1.0)).unionByName(shape(services, "Service", "service", F.col("share")))
            .unionByName(shape(ingresses, "Ingress", "ingress", F.col("down") / F.col("all"))))
