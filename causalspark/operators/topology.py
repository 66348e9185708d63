"""Edges between resources, and questions about the resource graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.functions.scalar import DAY_US, HOUR_US, is_failure
from causalspark.operators import reach
from causalspark.operators.timejoin import latest, with_previous
from causalspark.session import cut_lineage

# --- building edges -----------------------------------------------------------------------


def _edge(df: DataFrame, kind: str, src="src", dst="dst") -> DataFrame:
    return df.select("client_id", F.col(src).alias("src"), F.col(dst).alias("dst"),
                     F.lit(kind).alias("type"),
                     F.concat(F.lit("edge:"), src, F.lit("->"), dst).alias("id"))


def selects_by_labels(services: DataFrame, pods: DataFrame) -> DataFrame:
    """A service selects the pods of its namespace that carry every selector entry.

    services: client_id, ns, rid, selector (map); pods: client_id, ns, rid, labels (map).
    """
    want = services.where(F.size("selector") > 0).select(
        "client_id", "ns", F.col("rid").alias("src"), F.size("selector").alias("need"),
        F.explode("selector").alias("k", "v"))
    have = pods.select("client_id", "ns", F.col("rid").alias("dst"), F.explode("labels").alias("k", "v"))
    hits = want.join(have, ["client_id", "ns", "k", "v"]).groupBy("client_id", "src", "dst").agg(
        F.count("*").alias("hits"), F.first("need").alias("need"))
    return _edge(hits.where("hits = need"), "SELECTS")


def _containing(shorter: DataFrame, longer: DataFrame, prefix_only: bool) -> DataFrame:
    """(src, dst) where the name of ``longer`` contains the name of ``shorter``.

    The names are cut into the substrings of the lengths that occur, so the match is an
    equality join and no namespace is paired with itself.
    """
    s = shorter.where(F.length("name") > 0).select(
        "client_id", "ns", F.col("rid").alias("src"), F.col("name").alias("part"))
    sizes = s.select("client_id", "ns", F.length("part").alias("n")).distinct()
    cut = longer.select("client_id", "ns", F.col("rid").alias("dst"), "name").join(
        sizes, ["client_id", "ns"]).where(F.length("name") >= F.col("n"))
    start = F.lit(1) if prefix_only else F.explode(
        F.sequence(F.lit(1), F.length("name") - F.col("n") + 1))
    parts = cut.withColumn("i", start).select(
        "client_id", "ns", "dst", F.substr("name", F.col("i"), F.col("n")).alias("part")).distinct()
    return s.join(parts, ["client_id", "ns", "part"]).select("client_id", "src", "dst")


def selects_by_name(services: DataFrame, pods: DataFrame) -> DataFrame:
    """Fallback for services without selector: the pod name contains the service name."""
    return _edge(_containing(services, pods, False), "SELECTS")


def controls_by_prefix(owners: DataFrame, owned: DataFrame) -> DataFrame:
    """The owned name starts with the owner name, same namespace."""
    return _edge(_containing(owners, owned, True), "CONTROLS")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges to add and to delete between two snapshots."""
    keys = ["client_id", "src", "dst", "type"]
    add = new.select(keys).join(old.select(keys), keys, "left_anti").withColumn("op", F.lit("UPSERT"))
    drop = old.select(keys).join(new.select(keys), keys, "left_anti").withColumn("op", F.lit("DELETE"))
    return add.unionByName(drop)


def runs_on(pods: DataFrame) -> DataFrame:
    rows = pods.where(F.coalesce("node", F.lit("")) != "").withColumn(
        "dst", F.concat(F.lit("node::"), "node"))
    return _edge(rows, "RUNS_ON", "rid", "dst").distinct()


def controls_by_owner(resources: DataFrame) -> DataFrame:
    """``owner`` is ``Kind/name`` in the same namespace."""
    rows = resources.where(F.contains("owner", F.lit("/"))).withColumn(
        "src", F.concat(F.lower(F.substring_index("owner", "/", 1)), F.lit(":"), "ns", F.lit(":"),
                        F.substring_index("owner", "/", -1)))
    return _edge(rows, "CONTROLS", "src", "rid")


def controller_changes(log: DataFrame, controller: str = "controller") -> DataFrame:
    """Tombstones for the old edge when the controller of a pod changes.

    log: client_id, rid, t, offset, <controller>.
    """
    rows = with_previous(log, ["client_id", "rid"], ["t", "offset"], [controller], 30 * DAY_US)
    prev = F.col(f"prev_{controller}")
    return rows.where(prev.isNotNull() & (prev != F.col(controller))).select(
        "client_id", F.concat(F.lit("edge:"), prev, F.lit("->"), "rid").alias("id"),
        F.lit("DELETE").alias("op"), "t", "offset")


def endpoint_pods(endpoints: DataFrame) -> DataFrame:
    """endpoints: client_id, ns, name, subsets array<struct<targets array<struct<kind,name>>>>."""
    subset = endpoints.select("client_id", "ns", "name", F.explode("subsets").alias("s"))
    target = subset.select("client_id", "ns", "name", F.explode("s.targets").alias("t"))
    return target.where("t.kind = 'Pod'").select(
        "client_id", F.concat(F.lit("service:"), "ns", F.lit(":"), "name").alias("src"),
        F.concat(F.lit("pod:"), "ns", F.lit(":"), "t.name").alias("dst")).distinct()


def dependencies_from_env(env: DataFrame, services: DataFrame) -> DataFrame:
    """Service dependencies named in environment values.

    env: client_id, service, name, value; services: client_id, service.
    """
    value = F.col("value")
    host = F.regexp_extract(value, r"https?://([^:/]*)", 1)
    target = (F.when(F.rlike(value, F.lit("https?://")),
                     F.when((host != "") & ~F.startswith(host, F.lit("localhost")), host))
              .when(F.contains(value, F.lit(".")) & ~F.startswith(value, F.lit("$")),
                    F.substring_index(value, ".", 1)))
    named = env.where(F.rlike(F.upper("name"), F.lit("URL|HOST|ENDPOINT|SERVICE"))).select(
        "client_id", F.col("service").alias("src"), target.alias("dst")).where(
        "dst IS NOT NULL AND dst <> src").distinct()
    known = services.select("client_id", F.col("service").alias("dst"))
    return named.join(known, ["client_id", "dst"], "left_semi").select(
        "client_id", "src", "dst", F.lit("http").alias("type"), F.lit(0.7).alias("confidence"))


def snapshot_totals(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals per tenant and kind; node and edge rows themselves stay tables."""
    n = resources.groupBy("client_id", F.col("kind").alias("item")).agg(
        F.count("*").alias("n")).withColumn("part", F.lit("node"))
    e = edges.select("client_id", "src", "dst", "type").distinct().groupBy(
        "client_id", F.col("type").alias("item")).agg(F.count("*").alias("n")).withColumn(
        "part", F.lit("edge"))
    return n.unionByName(e)


def repair_tenant(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """Fill a missing tenant from the ends, and mark edges that cross tenants.

    edges: client_id (nullable), src_key, dst_key with ends unique over all tenants.
    """
    ids = resources.select(F.concat_ws("::", "client_id", "rid").alias("key"),
                           F.col("client_id").alias("owner"))
    s = ids.select(F.col("key").alias("src_key"), F.col("owner").alias("src_owner"))
    d = ids.select(F.col("key").alias("dst_key"), F.col("owner").alias("dst_owner"))
    return (edges.join(s, "src_key", "left").join(d, "dst_key", "left")
            .withColumn("client_id", F.coalesce("client_id", "src_owner"))
            .withColumn("verdict", F.when(F.col("src_owner").isNull() | F.col("dst_owner").isNull(),
                                          "missing end")
                        .when(F.col("src_owner") != F.col("dst_owner"), "cross tenant").otherwise("ok")))


def coverage_by_topology(named_links: DataFrame) -> DataFrame:
    """How many causal pairs have a topology path, by hops."""
    return named_links.groupBy("client_id", "hops").agg(F.count("*").alias("links"))


# --- graph questions ----------------------------------------------------------------------


#: Roots whose next vertices are found in one group, and steps that are followed at once.
BLOCK_ROOTS, STEPS = 256, 2_000_000


def _stepped(frontier: DataFrame, step: DataFrame, blocks: int) -> DataFrame:
    """(client_id, root, node): the distinct vertices one step from those of the frontier.

    Many vertices of a root lead to the same next ones. A block of roots meets the edges that it needs in one group, and
    follows a bounded number at once, so what leads to the same vertex is neither shuffled nor held.
    """
    f = frontier.select("client_id", F.pmod(F.xxhash64("root"), F.lit(blocks)).alias("block"), "root", "node")
    e = f.select("client_id", "block", "node").distinct().join(step, ["client_id", "node"])
    e = e.select(*[F.col(c).alias(f"e_{c}") for c in ("client_id", "block", "node", "next")])

    def follow(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"client_id": [], "root": [], "node": []}, dtype="object")
        nodes, known = pd.factorize(b["e_node"])
        nexts, names = pd.factorize(b["e_next"])
        order = np.argsort(nodes, kind="stable")
        nodes, nexts = nodes[order], nexts[order]
        roots, root_names = pd.factorize(a["root"])
        at = pd.Index(known).get_indexer(a["node"])
        order = np.argsort(roots, kind="stable")
        order = order[at[order] >= 0]
        roots, at = roots[order], at[order]
        first, n = np.searchsorted(nodes, at), np.bincount(nodes)[at]
        found, start, sums = [], 0, np.r_[0, np.cumsum(n)]
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(sums, sums[start] + STEPS, side="right")) - 1)
            m = n[start:stop]
            place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[start:stop], m)
            found.append(np.unique(np.repeat(roots[start:stop], m) * len(names) + nexts[place]))
            start = stop
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"client_id": a["client_id"].iat[0], "root": np.asarray(root_names)[key // len(names)], "node": np.asarray(names)[key % len(names)]})

    return f.groupBy("client_id", "block").cogroup(e.groupBy("e_client_id", "e_block")).applyInPandas(follow, "client_id string, root string, node string")


def neighbourhood(roots: DataFrame, edges: DataFrame, depth: int = 3, directed: bool = False,
                  types=None) -> DataFrame:
    """Everything within ``depth`` of the roots (client_id, root), with the least distance.

    Breadth-first: a round follows only the vertices found in the round before.
    """
    e = edges.where(F.col("type").isin(*types)) if types else edges
    step = e.select("client_id", F.col("src").alias("node"), F.col("dst").alias("next"))
    if not directed:
        step = step.union(e.select("client_id", "dst", "src"))
    step = step.distinct()
    seen = roots.select("client_id", "root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    blocks = -(-roots.count() // BLOCK_ROOTS) if depth > 1 else 0
    for d in range(1, depth + 1):
        # From the roots themselves no two edges lead to one vertex.
        found = frontier.join(step, ["client_id", "node"]).select("client_id", "root", F.col("next").alias("node")).distinct() if d == 1 else _stepped(
            frontier, step, max(1, blocks))
        found = (found.join(seen.select("client_id", "root", "node"), ["client_id", "root", "node"],
                       "left_anti").withColumn("depth", F.lit(d)))
        if d % 3 == 0 and d < depth:
            found = cut_lineage(found)
        frontier, seen = found, seen.unionByName(found)
    return seen


def resource_blast_radius(roots: DataFrame, edges: DataFrame, episodes: DataFrame,
                          max_hops: int = 3, hours: int = 24, as_of=None) -> DataFrame:
    """Resources around the roots with their recent failures and an impact band."""
    now = latest(episodes, as_of)
    errors = episodes.where(is_failure(F.col("severity")) & (F.col("t") >= now - hours * HOUR_US)
                            ).groupBy("client_id", F.col("rid").alias("node")).agg(
        F.count("*").alias("errors"))
    near = neighbourhood(roots, edges, max_hops).where("depth > 0")
    return (near.join(errors, ["client_id", "node"], "left").na.fill(0, ["errors"])
            .withColumn("impact", F.when(F.col("errors") > 10, "high")
                        .when(F.col("errors") > 0, "medium").otherwise("low")))


def dependency_blast_radius(depends_on: DataFrame, services: DataFrame, depth: int = 2) -> DataFrame:
    """Services reached along DEPENDS_ON in 0..depth steps."""
    roots = services.select("client_id", F.col("service").alias("root"))
    edges = depends_on.withColumn("type", F.lit("DEPENDS_ON"))
    return neighbourhood(roots, edges, depth, directed=True)


def service_map(edges: DataFrame) -> DataFrame:
    """Service, pod, node and controller in one row per (service, pod)."""
    pick = lambda t, s, d: edges.where(F.col("type") == t).select(
        "client_id", F.col("src").alias(s), F.col("dst").alias(d))
    return (pick("SELECTS", "service", "pod").join(pick("RUNS_ON", "pod", "node"),
                                                   ["client_id", "pod"], "left")
            .join(pick("CONTROLS", "controller", "pod"), ["client_id", "pod"], "left"))


def path_counts(edges: DataFrame, types=reach.TOPOLOGY_TYPES) -> DataFrame:
    """Number of undirected paths of length 1..3 that use no edge twice.

    Counted from vertex degrees: no path is ever built.
    """
    und = reach.undirected(edges, types)
    deg = und.groupBy("client_id", "a").agg(F.count("*").alias("deg"))
    both = (und.join(deg.withColumnRenamed("deg", "da"), ["client_id", "a"])
            .join(deg.select("client_id", F.col("a").alias("b"), F.col("deg").alias("db")),
                  ["client_id", "b"]))
    per_edge = both.groupBy("client_id").agg(
        F.count("*").alias("one"),
        F.sum((F.col("da") - 1) * (F.col("db") - 1)).alias("three"))
    per_vertex = deg.groupBy("client_id").agg(F.sum(F.col("deg") * (F.col("deg") - 1)).alias("two"))
    return per_edge.join(per_vertex, "client_id").select(
        "client_id", F.explode(F.array(*[F.struct(F.lit(i).alias("hops"), F.col(c).alias("paths"))
                                         for i, c in enumerate(["one", "two", "three"], 1)])).alias("p")
    ).select("client_id", "p.*")


def orphans(resources: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """Resources with something missing: edges, events, owner, replica sets or pods."""
    keys = ["client_id", "rid"]
    ids = resources.select(*keys, "kind", "owner")
    ends = edges.select("client_id", F.col("src").alias("rid")).union(
        edges.select("client_id", F.col("dst").alias("rid"))).distinct()
    sub = lambda t: edges.where(F.col("type") == t).select("client_id", F.col("src").alias("rid"))
    mark = lambda df, why: df.select(*keys, "kind", F.lit(why).alias("missing"))
    parts = [
        mark(ids.join(ends, keys, "left_anti"), "edges"),
        mark(ids.join(episodes.select(*keys), keys, "left_anti"), "events"),
        mark(ids.where("kind = 'Pod' AND owner = ''"), "owner"),
        mark(ids.where("kind = 'Deployment'").join(sub("CONTROLS"), keys, "left_anti"), "replica set"),
        mark(ids.where("kind = 'Service'").join(sub("SELECTS"), keys, "left_anti"), "pods"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dependency_cycles(depends_on: DataFrame, max_length: int = 5) -> DataFrame:
    """Simple cycles of 2..max_length services, each once, from its smallest member."""
    e = depends_on.select("client_id", "src", "dst").where("src <> dst").distinct()
    for _ in range(2):  # vertices without an edge in and an edge out lie on no cycle
        e = (e.join(e.select("client_id", F.col("src").alias("dst")), ["client_id", "dst"], "left_semi")
             .join(e.select("client_id", F.col("dst").alias("src")), ["client_id", "src"], "left_semi"))
    e = cut_lineage(e)
    walk = e.where("dst > src").select("client_id", F.col("src").alias("root"),
                                       F.col("dst").alias("tip"), F.array("src", "dst").alias("path"))
    out = None
    for length in range(2, max_length + 1):
        closing = walk.join(e.select("client_id", F.col("src").alias("tip"), F.col("dst").alias("root")),
                            ["client_id", "tip", "root"]).select(
            "client_id", F.lit(length).alias("length"), "path")
        out = closing if out is None else out.unionByName(closing)
        if length < max_length:
            step = e.select("client_id", F.col("src").alias("tip"), F.col("dst").alias("next"))
            walk = (walk.join(step, ["client_id", "tip"])
                    .where((F.col("next") > F.col("root")) & ~F.array_contains("path", F.col("next")))
                    .select("client_id", "root", F.col("next").alias("tip"),
                            F.concat("path", F.array("next")).alias("path")))
    return out


def dependency_cycle_counts(depends_on: DataFrame) -> DataFrame:
    """For each service and length 2..5 the number of simple cycles through it; without cycles no row.

    Counted from two-step walks: no cycle is ever built. Those of length five are counted by (first, third, fourth vertex),
    so the work is at most that of services times dependencies, in those that lie between others.
    """
    key = ["client_id"]
    e = depends_on.select("client_id", "src", "dst").where("src <> dst").distinct()
    for _ in range(2):  # as in dependency_cycles
        e = (e.join(e.select("client_id", F.col("src").alias("dst")), ["client_id", "dst"], "left_semi")
             .join(e.select("client_id", F.col("dst").alias("src")), ["client_id", "src"], "left_semi"))
    e = cut_lineage(e.select("client_id", "src", "dst"))
    ends = lambda df, a, b, **more: df.select("client_id", F.col("src").alias(a), F.col("dst").alias(b), *[F.col(c).alias(n) for n, c in more.items()])
    steps = lambda df: (ends(df, "src", "mid").join(ends(df, "mid", "dst"), ["client_id", "mid"])
                        .groupBy("client_id", "src", "dst").agg(F.count("*").alias("n")))
    both = e.join(ends(e, "dst", "src"), ["client_id", "src", "dst"], "left_semi")  # dependencies in both directions
    two = cut_lineage(steps(e))
    per = lambda df, value: df.groupBy("client_id", F.col("v").alias("service")).agg(F.sum(value).alias("cycles"))
    c2 = per(ends(both, "v", "x"), F.lit(1))
    c3 = per(ends(e, "x", "v").join(ends(two, "v", "x", n="n"), key + ["v", "x"]), F.col("n"))
    there, back = ends(two, "v", "x", n="n").where("v <> x"), ends(two, "x", "v", m="n")
    c4 = per(there.join(back, key + ["v", "x"]).select("client_id", "v", (F.col("n") * F.col("m")).alias("c"))
             .unionByName(ends(steps(both), "v", "x", n="n").where("v <> x").select("client_id", "v", (-F.col("n")).alias("c"))), F.col("c"))
    # v, a, b, c, d: a is not c, d is not b; then those with a = d are taken off
    mutual = ends(both, "b", "c").withColumn("cb", F.lit(1))
    inner = (ends(e, "b", "c").join(mutual, key + ["b", "c"], "left")
             .join(ends(two, "v", "b", n="n"), key + ["b"]).join(ends(two, "c", "v", m="n"), key + ["c", "v"]).where("v <> b AND v <> c")
             .join(ends(e, "v", "c").withColumn("vc", F.lit(1)), key + ["v", "c"], "left")
             .join(ends(e, "b", "v").withColumn("bv", F.lit(1)), key + ["b", "v"], "left").na.fill(0, ["cb", "vc", "bv"])
             .select("client_id", "v", ((F.col("n") - F.col("vc") * F.col("cb")) * (F.col("m") - F.col("cb") * F.col("bv"))).alias("c")))
    same = (ends(both, "v", "x").join(c3.select("client_id", F.col("service").alias("x"), F.col("cycles").alias("t")), key + ["x"])
            .join(ends(two, "v", "x", n="n"), key + ["v", "x"], "left").join(back, key + ["v", "x"], "left").na.fill(0, ["n", "m"])
            .select("client_id", "v", (F.col("n") + F.col("m") - F.col("t")).alias("c")))
    c5 = per(inner.unionByName(same), F.col("c"))
    out = None
    for length, part in enumerate((c2, c3, c4, c5), 2):
        part = part.where("cycles > 0").select("client_id", "service", F.lit(length).alias("length"), "cycles")
        out = part if out is None else out.unionByName(part)
    return out


def neighbour_relations(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of :func:`neighbourhood` (but the roots) with the relations of the last step: types
    with their direction, ``out`` away from the root. At most two for each type."""
    ends = lambda a, b, way: F.struct(F.col(a).alias("node"), F.col(b).alias("next"), F.concat("type", F.lit(f":{way}")).alias("relation"))
    step = edges.select("client_id", F.explode(F.array(ends("src", "dst", "out"), ends("dst", "src", "in"))).alias("s")).select("client_id", "s.*")
    before = found.select("client_id", "root", "node", (F.col("depth") + 1).alias("depth"))
    last = before.join(step, ["client_id", "node"]).select("client_id", "root", F.col("next").alias("node"), "depth", "relation")
    return last.join(found, ["client_id", "root", "node", "depth"], "left_semi").groupBy("client_id", "root", "node", "depth").agg(
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


def node_failure_impact(edges: DataFrame) -> DataFrame:
    """Pods and services that a failing node would take with it."""
    m = service_map(edges)
    return m.where("node IS NOT NULL").groupBy("client_id", "node").agg(
        F.countDistinct("pod").alias("pods"), F.countDistinct("service").alias("services"))


def used_by(resources: DataFrame, edges: DataFrame, kind: str, relation: str) -> DataFrame:
    """Users of each resource of a kind over one relation (counted, unused ones included)."""
    targets = resources.where(F.col("kind") == kind).select("client_id", "rid")
    uses = edges.where(F.col("type") == relation).groupBy(
        "client_id", F.col("dst").alias("rid")).agg(F.countDistinct("src").alias("users"))
    return targets.join(uses, ["client_id", "rid"], "left").na.fill(0, ["users"])


def related_services(edges: DataFrame) -> DataFrame:
    """Services that select a common pod, with the number of shared pods."""
    s = edges.where("type = 'SELECTS'").select("client_id", "src", "dst").distinct()
    other = s.select("client_id", F.col("src").alias("other"), "dst")
    return (s.join(other, ["client_id", "dst"]).where("src <> other")
            .groupBy("client_id", F.col("src").alias("service"), "other")
            .agg(F.count("*").alias("shared_pods")))
