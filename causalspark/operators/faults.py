"""Fault-propagation graphs, root-cause ranking, and matching against known patterns.

A fault is a bounded time window of events. Scores that do not depend on earlier choices are
columns over the last five events; only the choice itself, which feeds back into the score of
later events, runs as an ordered pass. That pass streams each fault and keeps the state of five
events, so its memory does not grow with the fault.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F, types as T

from causalspark.functions import classify as K, rules as R
from causalspark.functions.scalar import MICROS, MINUTE_US, joined, round_to
from causalspark.session import cut_lineage

LOOKBACK = 5


def tumbling_faults(events: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    slot = F.floor(F.col("t") / (minutes * MINUTE_US)).cast("string")
    return events.withColumn("fault_id", joined("|", *keys, slot))


def fault_events(episodes: DataFrame, keys: list[str], minutes: int) -> DataFrame:
    """(client_id, fault_id, eid, t, type, service, pod, severity) of the non-informational events.

    A fault belongs to one tenant, so ``keys`` should hold ``client_id``.
    """
    rows = tumbling_faults(episodes.where("severity <> 'INFO'"), keys, minutes)
    return rows.select("client_id", "fault_id", "eid", "t", K.fault_type(K.abstract_type(F.col("reason"))).alias("type"),
                       "service", F.when(F.col("s_kind") == "Pod", F.col("rid")).alias("pod"), "severity")


def causality_score(source: Column, target: Column) -> Column:
    table = {f"{a}>{b}": v for (a, b), v in R.FAULT_CAUSALITY.items()}
    return R.lookup(F.concat_ws(">", source, target), table, F.lit(R.FAULT_CAUSALITY_DEFAULT))


def with_predecessors(events: DataFrame, depends_on: DataFrame, m: int = LOOKBACK) -> DataFrame:
    """Each event with the base scores of its last ``m`` predecessors (nearest first).

    ``depends_on`` (client_id, service, needs) says that ``service`` depends on ``needs``.
    """
    needs = depends_on.groupBy("client_id", "service").agg(F.collect_set("needs").alias("needs"))
    w = W.partitionBy("fault_id").orderBy("t", "eid")
    rows = events.join(needs, ["client_id", "service"], "left").withColumn("pos", F.row_number().over(w))
    prev = F.struct("eid", "t", "type", "service", "pod")
    for j in range(1, m + 1):
        rows = rows.withColumn(f"p{j}", F.lag(prev, j).over(w))
    rows = rows.withColumn("is_last", F.lead("eid").over(w).isNull())

    def scored(p: Column) -> Column:
        dt = (F.col("t") - p["t"]) / float(MICROS)
        time = F.when(dt <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.pow(F.lit(2.0), -dt / 60.0)))
        same = p["service"] == F.col("service")
        dep = F.coalesce(F.array_contains("needs", p["service"]), F.lit(False))
        cause = causality_score(p["type"], F.col("type"))
        base = (time * 0.3 + F.when(same, 0.25).otherwise(0.0) + F.when(dep, 0.25).otherwise(0.0)
                + cause * 0.2 + F.when(p["pod"] == F.col("pod"), 0.15).otherwise(0.0))
        relation = (F.when(cause > 0.7, "CAUSES").when(dep, "PROPAGATES_TO").when(same, "SEQUENTIAL")
                    .otherwise("CORRELATES_WITH"))
        return F.when(p.isNotNull(), F.struct(p["eid"].alias("eid"), base.alias("base"),
                                              relation.alias("relation"), dt.alias("dt")))

    prevs = F.array_compact(F.array(*[scored(F.col(f"p{j}")) for j in range(1, m + 1)]))
    return rows.withColumn("prev", prevs).drop("needs", *[f"p{j}" for j in range(1, m + 1)])


def pair_scores(scored: DataFrame) -> DataFrame:
    return scored.select("fault_id", F.col("eid").alias("target"), F.explode("prev").alias("p")).select(
        "fault_id", F.col("p.eid").alias("source"), "target", F.col("p.base").alias("base"),
        F.col("p.relation").alias("relation"), F.col("p.dt").alias("time_delta"))


NODE_SCHEMA = ("client_id string, fault_id string, pos int, eid string, type string, service string, severity string, t long, is_last boolean, "
               "sources array<struct<offset:int,eid:string,relation:string,confidence:double,time_delta:double>>, "
               "depth int, root string, path array<string>")


def _chooser(m: int, theta: float):
    causality, default = dict(R.FAULT_CAUSALITY), R.FAULT_CAUSALITY_DEFAULT

    def context(node, new_type):
        score = 0.4 if node["indegree"] == 0 else 0.0
        if node["successors"]:
            score += 0.3
            if any(causality.get((s, new_type), default) > 0.5 for s in node["successors"]):
                score += 0.3
        return min(1.0, score)

    def run(batches):
        fault, recent = None, deque(maxlen=m)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.fault_id != fault:
                    fault, recent = row.fault_id, deque(maxlen=m)
                found = []
                for j, p in enumerate(row.prev):
                    node = recent[-1 - j]
                    conf = min(1.0, p["base"] + 0.15 * context(node, row.type))
                    if conf >= theta:
                        found.append((-conf, -j, j, p, conf, node))
                # the best set has one edge or the two best edges; earlier events win ties
                found.sort(key=lambda x: x[:2])
                best = found[:2]
                sources = [{"offset": j + 1, "eid": p["eid"], "relation": p["relation"], "confidence": conf,
                            "time_delta": p["dt"]} for _, _, j, p, conf, _ in best]
                if best:
                    near = min((n["depth"], n["path"]) for *_, n in best)
                    depth, path = near[0] + 1, near[1] + [row.eid]
                else:
                    depth, path = 0, [row.eid]
                for *_, node in best:
                    node["successors"].append(row.type)
                recent.append({"indegree": len(best), "successors": [], "depth": depth, "path": path})
                out.append((row.client_id, row.fault_id, row.pos, row.eid, row.type, row.service, row.severity, row.t, row.is_last,
                            sources, depth, path[0], path if row.is_last else None))
            yield pd.DataFrame(out, columns=["client_id", "fault_id", "pos", "eid", "type", "service", "severity", "t", "is_last",
                                             "sources", "depth", "root", "path"])
    return run


def build_fpg(scored: DataFrame, m: int = LOOKBACK, theta: float = 0.3) -> DataFrame:
    """Nodes of the fault graphs with their chosen sources, depth from a root, and alarm path."""
    ordered = scored.select("client_id", "fault_id", "pos", "eid", "type", "service", "severity", "t", "is_last", "prev").repartition(
        "fault_id").sortWithinPartitions("fault_id", "pos")
    return ordered.mapInPandas(_chooser(m, theta), NODE_SCHEMA)


def fpg_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select("fault_id", F.col("eid").alias("target"), F.explode("sources").alias("s")).select(
        "fault_id", F.col("s.eid").alias("source"), "target", "s.relation", "s.confidence", "s.time_delta")


def root_candidates(nodes: DataFrame) -> DataFrame:
    """Events without a chosen source."""
    return nodes.where(F.size("sources") == 0).select("client_id", "fault_id", "eid", "type", "service", "t")


def propagation_paths(nodes: DataFrame) -> DataFrame:
    """Shortest path from a root to the last event of each fault."""
    return nodes.where("is_last").select("fault_id", F.col("eid").alias("alarm"), "root", "depth", "path")


def graph_statistics(nodes: DataFrame) -> DataFrame:
    g = nodes.groupBy("fault_id").agg(
        F.count("*").alias("events"), F.sum(F.size("sources")).alias("relations"),
        F.count(F.when(F.size("sources") == 0, 1)).alias("roots"),
        F.countDistinct("service").alias("services"), F.countDistinct("type").alias("types"),
        ((F.max("t") - F.min("t")) / float(MICROS)).alias("span_seconds"))
    n, m = F.col("events"), F.col("relations")
    return g.withColumn("density", F.when(n > 1, m / (n * (n - 1))).otherwise(F.lit(0.0)))


# --- ranking ----------------------------------------------------------------------------------

def _to_alarm(batches):
    """Reverse pass: hops from each event to the alarm; sources lie at most a few places back."""
    fault, pending = None, {}
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.fault_id != fault:
                fault, pending = row.fault_id, {row.pos: 0}
            dist = pending.pop(row.pos, None)
            if dist is not None:
                for offset in row.offsets:
                    pos = row.pos - offset
                    pending[pos] = min(pending.get(pos, dist + 1), dist + 1)
            out.append((row.fault_id, row.eid, dist))
        yield pd.DataFrame(out, columns=["fault_id", "eid", "dist"]).astype({"dist": "Int32"})


def alarm_distance(nodes: DataFrame) -> DataFrame:
    rows = nodes.select("fault_id", "pos", "eid", F.transform("sources", lambda s: s["offset"]).alias("offsets"))
    ordered = rows.repartition("fault_id").sortWithinPartitions("fault_id", F.desc("pos"))
    return ordered.mapInPandas(_to_alarm, "fault_id string, eid string, dist int")


def service_distances(depends_on: DataFrame, sources: DataFrame, max_hops: int = 5) -> DataFrame:
    """(client_id, service, other, hops) along depends-on edges from the given services, up to
    ``max_hops`` (farther scores 0)."""
    step = depends_on.select("client_id", F.col("service").alias("other"), F.col("needs").alias("next")).distinct()
    state = depends_on.join(sources.select("client_id", "service").distinct(), ["client_id", "service"], "left_semi").select(
        "client_id", "service", F.col("needs").alias("other")).distinct()
    seen = state.withColumn("hops", F.lit(1))
    for h in range(2, max_hops + 1):
        state = (state.join(step, ["client_id", "other"]).select("client_id", "service", F.col("next").alias("other")).distinct()
                 .join(seen.select("client_id", "service", "other"), ["client_id", "service", "other"], "left_anti"))
        if h % 3 == 0:
            state = cut_lineage(state)
        seen = seen.unionByName(state.withColumn("hops", F.lit(h)))
    return seen.where("service <> other")


def root_scores(nodes: DataFrame, depends_on: DataFrame) -> DataFrame:
    """Time and distance score of every root candidate against the last event of its fault."""
    n = nodes.groupBy("fault_id").agg(F.count("*").alias("n"))
    alarm = nodes.where("is_last").select("fault_id", F.col("eid").alias("alarm"), F.col("t").alias("alarm_t"),
                                          F.col("service").alias("other"))
    roots = root_candidates(nodes)
    rows = (roots.join(alarm, "fault_id").join(n, "fault_id")
            .join(alarm_distance(nodes), ["fault_id", "eid"])
            .join(service_distances(depends_on, roots), ["client_id", "service", "other"], "left"))
    dt = (F.col("alarm_t") - F.col("t")) / float(MICROS)
    time = F.when(dt < 0, 0.0).otherwise(F.pow(F.lit(2.0), -dt / 120.0))
    graph = F.coalesce(1.0 - F.col("dist") / F.col("n"), F.lit(0.0))
    service = F.coalesce(1.0 - F.col("hops") / 5.0, F.lit(0.0))
    distance = (F.when(F.col("service") == F.col("other"), 1.0)
                .when(graph > 0, 0.7 * graph + 0.3 * service).otherwise(service))
    return rows.withColumn("time_score", time).withColumn("distance_score", distance)


def rank_root_causes(scores: DataFrame, wt: float = 0.6, wd: float = 0.4, top_n: int = 5) -> DataFrame:
    """Combined normalized ranks; equal scores share the first position.

    Scores are counted per value before they are ordered, so ties cost one row.
    """
    scores = cut_lineage(scores)

    def ranked(column):
        per = scores.groupBy("fault_id", column).agg(F.count("*").alias("_n"))
        before = W.partitionBy("fault_id").orderBy(F.desc(column)).rowsBetween(W.unboundedPreceding, -1)
        total = W.partitionBy("fault_id")
        pos = F.coalesce(F.sum("_n").over(before), F.lit(0))
        return per.select("fault_id", column, (1.0 - pos / F.sum("_n").over(total)).alias(f"{column}_rank"))
    rows = scores.join(ranked("time_score"), ["fault_id", "time_score"]).join(
        ranked("distance_score"), ["fault_id", "distance_score"])
    rows = rows.withColumn("rank_score", wt * F.col("time_score_rank") + wd * F.col("distance_score_rank"))
    w = W.partitionBy("fault_id").orderBy(F.desc("rank_score"), "t", "eid")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def explanation() -> Column:
    """One sentence per ranked cause."""
    near = F.when(F.col("time_score") > 0.8, "very close in time to").when(
        F.col("time_score") > 0.5, "shortly before").otherwise("well before")
    where = F.when(F.col("distance_score") > 0.8, "on the same or a direct service").when(
        F.col("distance_score") > 0.5, "on a near service").otherwise("on a distant service")
    return F.concat_ws(" ", F.col("type"), F.lit("on"), F.col("service"), F.lit("happened"), near,
                       F.lit("the alarm,"), where)


# --- patterns ---------------------------------------------------------------------------------

def abstract_faults(nodes: DataFrame) -> DataFrame:
    """Each fault as an abstract graph: signatures in order of first appearance, services,
    deduplicated abstract edges, type of the earliest root. All arrays are bounded by the
    vocabulary of signatures."""
    sig = K.signature(F.col("type"), F.col("service"), F.col("severity"))
    rows = nodes.withColumn("sig", sig)
    first = rows.groupBy("fault_id", "sig", "type", "service").agg(F.min(F.struct("t", "eid")).alias("at"))
    seq = first.groupBy("fault_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "sig", "type"))).alias("s"),
        F.array_sort(F.collect_set("type")).alias("types"),
        F.array_sort(F.collect_set(F.regexp_replace(K.service_pattern(F.col("service")), r"-\*$", ""))).alias("services"))
    root = rows.where(F.size("sources") == 0).groupBy("fault_id").agg(
        F.min_by("type", F.struct("t", "eid")).alias("root_type"))
    ends = rows.select("fault_id", F.col("eid").alias("source"), F.col("sig").alias("source_sig"))
    edges = (rows.select("fault_id", F.col("sig").alias("target_sig"), F.explode("sources").alias("e"))
             .select("fault_id", "target_sig", F.col("e.eid").alias("source"))
             .join(ends, ["fault_id", "source"]).select("fault_id", "source_sig", "target_sig").distinct())
    links = edges.where("source_sig <> target_sig").groupBy("fault_id").agg(
        F.array_sort(F.collect_list(F.struct("source_sig", "target_sig"))).alias("edges"))
    empty = F.array().cast("array<struct<source_sig:string,target_sig:string>>")
    return (seq.join(root, "fault_id").join(links, "fault_id", "left")
            .select("fault_id", "root_type", F.transform("s", lambda x: x["sig"]).alias("sequence"),
                    F.transform("s", lambda x: x["type"]).alias("type_sequence"), "types", "services",
                    F.coalesce("edges", empty).alias("edges")))


def pattern_store(abstract: DataFrame, min_frequency: int = 1) -> DataFrame:
    """Patterns with their frequency: faults with equal root type, sequence and edges."""
    same = ["root_type", "sequence", "type_sequence", "types", "services", "edges"]
    g = abstract.groupBy(*same).agg(F.count("*").alias("frequency"), F.min("fault_id").alias("first_fault"))
    key = F.md5(joined("|", "root_type", F.array_join("sequence", ">"), F.to_json("edges")))
    return g.where(F.col("frequency") >= min_frequency).withColumn("pattern_id", key)


def merge_patterns(store: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert into the store: frequencies of equal patterns add up."""
    cols = [c for c in store.columns if c not in ("pattern_id", "frequency")]
    both = store.unionByName(found)
    return both.groupBy("pattern_id").agg(F.sum("frequency").alias("frequency"), *[F.min(c).alias(c) for c in cols])


def read_patterns(store: DataFrame, root_types=None, limit: int | None = None) -> DataFrame:
    """Patterns with their ``rank`` in their root type: the most frequent first, equal ones by id.

    All of them, those of the root types, or the ``limit`` first of each root type.
    """
    rows = store.where(F.col("root_type").isin(list(root_types))) if root_types else store
    w = W.partitionBy("root_type").orderBy(F.desc("frequency"), "pattern_id")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def pattern_events(store: DataFrame) -> DataFrame:
    """(pattern_id, position, event, causes, effects): the events of each pattern with their numbers of edges in and out."""
    events = store.select("pattern_id", F.posexplode("sequence").alias("position", "event"))
    edges = store.select("pattern_id", F.explode("edges").alias("e"))
    side = lambda end, name: edges.groupBy("pattern_id", F.col(f"e.{end}").alias("event")).agg(F.count("*").alias(name))
    return (events.join(side("target_sig", "causes"), ["pattern_id", "event"], "left")
            .join(side("source_sig", "effects"), ["pattern_id", "event"], "left").na.fill(0, ["causes", "effects"]))


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("root_type").agg(
        F.count("*").alias("patterns"), F.sum("frequency").alias("faults"), F.max("frequency").alias("most"),
        F.max(F.size("sequence")).alias("longest"))


def expected_paths(patterns: DataFrame) -> DataFrame:
    """Longest shortest path from a root of each pattern graph; a pattern without roots gives
    its event sequence. The walk goes on until no pattern has a new node."""
    e = patterns.select("pattern_id", F.explode("edges").alias("e")).select("pattern_id", "e.*")
    nodes = patterns.select("pattern_id", F.explode("sequence").alias("node"))
    roots = nodes.join(e.select("pattern_id", F.col("target_sig").alias("node")), ["pattern_id", "node"], "left_anti")
    e = cut_lineage(e)
    seen = cut_lineage(roots.select("pattern_id", F.col("node").alias("root"), "node", F.array("node").alias("path")))
    frontier = seen
    while frontier.limit(1).count():
        grown = (frontier.join(e.withColumnRenamed("source_sig", "node"), ["pattern_id", "node"])
                 .select("pattern_id", "root", F.col("target_sig").alias("node"),
                         F.concat("path", F.array("target_sig")).alias("path"))
                 .join(seen.select("pattern_id", "root", "node"), ["pattern_id", "root", "node"], "left_anti")
                 .groupBy("pattern_id", "root", "node").agg(F.min("path").alias("path")))
        frontier = cut_lineage(grown)
        seen = seen.unionByName(frontier)
    best = seen.groupBy("pattern_id").agg(F.min(F.struct((-F.size("path")).alias("n"), "path")).alias("b"))
    return patterns.select("pattern_id", "sequence").join(best, "pattern_id", "left").select(
        "pattern_id", F.coalesce("b.path", "sequence").alias("path"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


LCS_PAIRS = 2048


def lcs_lengths(xs: list, ys: list) -> np.ndarray:
    """Length of the longest common subsequence of each pair, for all pairs side by side.

    Row ``j`` of the table is a bit vector over ``x`` (a zero bit where the length grows), 64 places to a word; one step
    adds and masks whole words of all pairs at once. Pairs are taken in order of their length, so few steps are padding.
    """
    out = np.zeros(len(xs), dtype="int64")
    order = sorted((i for i in range(len(xs)) if len(xs[i]) and len(ys[i])), key=lambda i: (len(ys[i]), len(xs[i])))
    at = 0
    while at < len(order):
        words = -(-max(len(xs[i]) for i in order[at:at + LCS_PAIRS]) // 64)
        part = order[at:at + max(1, LCS_PAIRS // words)]
        at += len(part)
        out[part] = _lcs_block([xs[i] for i in part], [ys[i] for i in part])
    return out


def _lcs_block(xs: list, ys: list) -> np.ndarray:
    n = len(xs)
    x_sizes, y_sizes = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    words = int(-(-x_sizes.max() // 64))
    codes, kinds = pd.factorize(np.concatenate([np.asarray(v, dtype=object) for v in (*xs, *ys)]), use_na_sentinel=False)
    ends = x_sizes.sum()
    owner = np.repeat(np.arange(n), x_sizes)
    place = np.arange(ends) - np.repeat(np.cumsum(x_sizes) - x_sizes, x_sizes)
    # where a kind of token stands in x, for the kinds of each pair alone
    keys, slot = np.unique(owner * len(kinds) + codes[:ends], return_inverse=True)
    masks = np.zeros((len(keys) + 1, words), dtype="uint64")
    np.bitwise_or.at(masks, (slot, place // 64), np.uint64(1) << (place % 64).astype("uint64"))
    steps = np.full((n, int(y_sizes.max())), len(keys))
    y_owner = np.repeat(np.arange(n), y_sizes)
    y_place = np.arange(y_sizes.sum()) - np.repeat(np.cumsum(y_sizes) - y_sizes, y_sizes)
    asked = y_owner * len(kinds) + codes[ends:]
    hit = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    steps[y_owner, y_place] = np.where(keys[hit] == asked, hit, len(keys))
    row = np.full((n, words), ~np.uint64(0))
    for j in range(steps.shape[1]):
        mask = masks[steps[:, j]]
        same = row & mask
        carry = np.zeros(n, dtype="uint64")
        for w in range(words):
            low = row[:, w] + same[:, w]
            total = low + carry
            carry = ((low < same[:, w]) | (total < low)).astype("uint64")
            row[:, w] = total | (row[:, w] & ~mask[:, w])
    inside = np.arange(words * 64)[None, :] < x_sizes[:, None]
    grown = np.unpackbits((~row).astype("<u8").view("uint8"), axis=1, bitorder="little").astype(bool)
    return (grown & inside).sum(axis=1)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * LCS / (length sum) over tokens; 0 when either side is empty."""
    xs, ys = a.tolist(), b.tolist()
    sizes = np.array([len(x) + len(y) for x, y in zip(xs, ys)], dtype="float64")
    return pd.Series(2.0 * lcs_lengths(xs, ys) / np.maximum(sizes, 1.0))


def shared_tokens(a: Column, b: Column) -> Column:
    """Sum over the tokens of the smaller count, from two maps token -> count: no common subsequence is longer."""
    return F.aggregate(F.map_keys(a), F.lit(0), lambda s, k: s + F.least(F.try_element_at(a, k), F.coalesce(F.try_element_at(b, k), F.lit(0))))


def token_counts(tokens: Column) -> Column:
    kinds = F.array_distinct(tokens)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(tokens, lambda t: t == k))))


def _density(nodes: Column, edges: Column) -> Column:
    return F.when(nodes > 1, edges / (nodes * (nodes - 1))).otherwise(F.lit(0.0))


def structure_score(n1: Column, m1: Column, n2: Column, m2: Column) -> Column:
    d1, d2 = _density(n1, m1), _density(n2, m2)
    ratio = F.least(m1, m2) / F.greatest(m1, m2, F.lit(1))
    dense = F.when((d1 == 0) & (d2 == 0), 1.0).otherwise(1.0 - F.abs(d1 - d2))
    return F.when((m1 == 0) & (m2 == 0), 1.0).otherwise((ratio + dense) / 2.0)


def match_patterns(abstract: DataFrame, patterns: DataFrame, k: int = 3,
                   weights=(0.35, 0.25, 0.30, 0.10)) -> DataFrame:
    """The ``k`` most similar patterns of each fault.

    Faults of equal abstract shape are matched once. Candidates share an event type or a
    service; only a shape whose ``k``-th candidate scores no more than the structure weight can
    have a better match outside. Outside, the score is that of the structure alone, so the ``k``
    best patterns are found once for each (nodes, links) that occurs among such shapes.

    Common subsequences are only searched for pairs that can still be among the ``k`` best: no
    sequence shares more than its common tokens, which bounds a score from above. The ``k``
    candidates with the highest bounds are scored first, and the ``k``-th of their scores is what
    another candidate's bound must reach.
    """
    shape_cols = ["type_sequence", "types", "services", "edges"]
    faults = abstract.withColumn("shape", F.md5(F.to_json(F.struct(*shape_cols))))
    shapes = faults.groupBy("shape").agg(*[F.first(c).alias(c) for c in shape_cols])
    tokens = lambda: F.array_union(F.transform("types", lambda x: F.concat(F.lit("t:"), x)),
                                   F.transform("services", lambda x: F.concat(F.lit("s:"), x)))
    s = shapes.select("shape", F.explode(tokens()).alias("token"))
    p = patterns.select("pattern_id", F.explode(tokens()).alias("token"))
    pairs = s.join(p, "token").select("shape", "pattern_id").distinct()
    near = _best_pairs(pairs, shapes, patterns, weights, k)
    w = W.partitionBy("shape").orderBy(F.desc("similarity"), F.desc("frequency"), "pattern_id")
    best = cut_lineage(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    full = best.where((F.col("rank") == k) & (F.col("similarity") > weights[3])).select("shape")
    sizes = lambda: [F.size("type_sequence").cast("double").alias("nodes"), F.size("edges").cast("double").alias("links")]
    open_shapes = shapes.join(full, "shape", "left_anti").select("shape", *sizes())
    by_structure = W.partitionBy("nodes", "links").orderBy(F.desc("frequency"), "pattern_id")
    # Outside patterns of one structure score alike, and inside ones of it score no less, so the
    # first k of every structure are enough.
    few = patterns.select("pattern_id", "frequency", *sizes())
    few = few.withColumn("n", F.row_number().over(by_structure)).where(F.col("n") <= k)
    # bounded by the structures: k patterns for each number of signatures and of edges between them
    listed = few.select(F.collect_list(F.struct("pattern_id", "frequency", F.col("nodes").alias("n2"), F.col("links").alias("m2")))).scalar()
    asked = open_shapes.select("nodes", "links").distinct().withColumn("all", listed)
    alike = asked.select("nodes", "links", F.explode("all").alias("p")).select("nodes", "links", "p.*")
    like = structure_score(F.col("nodes"), F.col("links"), F.col("n2"), F.col("m2"))
    first = W.partitionBy("nodes", "links").orderBy(F.desc("like"), F.desc("frequency"), "pattern_id")
    alike = alike.withColumn("like", like).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    rest = open_shapes.join(alike, ["nodes", "links"]).select("shape", "pattern_id").join(pairs, ["shape", "pattern_id"], "left_anti")
    both = best.drop("rank").unionByName(_scored_pairs(rest, shapes, patterns, weights))
    out = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return faults.select("fault_id", "shape").join(out, "shape").drop("shape")


def _bounded_pairs(pairs: DataFrame, shapes: DataFrame, patterns: DataFrame, weights) -> DataFrame:
    """Pairs with the scores that need no subsequence, and ``bound``, which the similarity never exceeds."""
    side = lambda prefix: [
        F.col("services").alias(f"{prefix}services"), F.col("types").alias(f"{prefix}types"),
        token_counts(F.col("type_sequence")).alias(f"{prefix}counts"),
        F.size("type_sequence").cast("double").alias(f"{prefix}nodes"), F.size("edges").cast("double").alias(f"{prefix}links")]
    rows = (pairs.join(shapes.select("shape", *side("")), "shape")
            .join(patterns.select("pattern_id", "frequency", *side("p_")), "pattern_id"))
    rows = (rows.withColumn("jaccard", jaccard(F.col("types"), F.col("p_types")))
            .withColumn("service", jaccard(F.col("services"), F.col("p_services")))
            .withColumn("structure", structure_score(F.col("nodes"), F.col("links"), F.col("p_nodes"), F.col("p_links"))))
    most = 2.0 * shared_tokens(F.col("counts"), F.col("p_counts")) / F.greatest(F.col("nodes") + F.col("p_nodes"), F.lit(1.0))
    return rows.select("shape", "pattern_id", "frequency", "jaccard", "service", "structure",
                       similarity(weights, most).alias("bound"))


def similarity(weights, sequence: Column) -> Column:
    wj, ws, wq, wg = weights
    return wj * F.col("jaccard") + ws * F.col("service") + wq * sequence + wg * F.col("structure")


def _best_pairs(pairs: DataFrame, shapes: DataFrame, patterns: DataFrame, weights, k: int) -> DataFrame:
    """Scored pairs with all of the ``k`` best of each shape among them."""
    bounded = cut_lineage(_bounded_pairs(pairs, shapes, patterns, weights))
    by_bound = W.partitionBy("shape").orderBy(F.desc("bound"), F.desc("frequency"), "pattern_id")
    first = bounded.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= k).drop("n")
    scored = cut_lineage(_scored(first, shapes, patterns, weights))
    floor = scored.groupBy("shape").agg(F.min("similarity").alias("floor"))
    others = bounded.join(floor, "shape").where("bound >= floor").drop("floor").join(
        scored.select("shape", "pattern_id"), ["shape", "pattern_id"], "left_anti")
    return scored.unionByName(_scored(others, shapes, patterns, weights))


def _scored_pairs(pairs: DataFrame, shapes: DataFrame, patterns: DataFrame, weights) -> DataFrame:
    return _scored(_bounded_pairs(pairs, shapes, patterns, weights), shapes, patterns, weights)


def _ratios(pairs: DataFrame, shapes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Sequence ratio of each pair (shape, pattern_id), reckoned once for each two distinct sequences."""
    key = lambda: F.md5(F.to_json("type_sequence"))
    named = (pairs.select("shape", "pattern_id").join(shapes.select("shape", key().alias("a")), "shape")
             .join(patterns.select("pattern_id", key().alias("b")), "pattern_id"))
    text = lambda rows, name: rows.groupBy(key().alias(name)).agg(F.first("type_sequence").alias(f"{name}_sequence"))
    ratio = named.select("a", "b").distinct().join(text(shapes, "a"), "a").join(text(patterns, "b"), "b").select(
        "a", "b", sequence_ratio("a_sequence", "b_sequence").alias("sequence"))
    return named.join(ratio, ["a", "b"]).select("shape", "pattern_id", "sequence")


def _scored(bounded: DataFrame, shapes: DataFrame, patterns: DataFrame, weights) -> DataFrame:
    rows = bounded.join(_ratios(bounded, shapes, patterns), ["shape", "pattern_id"])
    boost = F.least(F.lit(0.3), 0.1 * F.sqrt(F.col("frequency")))
    rows = rows.withColumn("similarity", similarity(weights, F.col("sequence"))).withColumn(
        "confidence", F.least(F.lit(1.0), 0.7 * F.col("similarity") + boost))
    rows = rows.join(shapes.select("shape", "types"), "shape").join(
        patterns.select("pattern_id", "root_type", F.col("types").alias("p_types")), "pattern_id")
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select(
        "shape", "pattern_id", "frequency", "root_type", "jaccard", "service", "sequence", "structure",
        "similarity", "confidence", join(F.array_intersect("types", "p_types")).alias("matched"),
        join(F.array_except("p_types", "types")).alias("missing"), join(F.array_except("types", "p_types")).alias("extra"))


def analyse(nodes: DataFrame, depends_on: DataFrame, abstract: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per fault: statistics, alarm, best root cause with explanation, best pattern."""
    top = rank_root_causes(root_scores(nodes, depends_on), top_n=1).select(
        "fault_id", F.col("eid").alias("root_cause"), "rank_score", explanation().alias("explanation"))
    pattern = match_patterns(abstract, patterns, 1).select(
        "fault_id", "pattern_id", F.col("confidence").alias("pattern_confidence"))
    return (graph_statistics(nodes).join(propagation_paths(nodes).select("fault_id", "alarm", "depth"), "fault_id")
            .join(top, "fault_id").join(pattern, "fault_id", "left"))
