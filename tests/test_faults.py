"""Fault graphs against a plain re-derivation of the specification; vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.operators import faults as X, search as E
from tests.conftest import T0, rows

TYPES = ["cpu_high", "memory_high", "oom_kill", "pod_restart", "service_down", "latency_high", "custom"]


def spec(events, needs, m=5, theta=0.3):
    """Edges chosen by the written rules, one fault at a time."""
    edges = []
    out_edges, in_deg = {}, {}
    kinds = {e["eid"]: e["type"] for e in events}
    events = sorted(events, key=lambda e: (e["t"], e["eid"]))
    for i, e in enumerate(events):
        found = []
        for p in events[max(0, i - m):i]:
            dt = (e["t"] - p["t"]) / 1e6
            cause = R.FAULT_CAUSALITY.get((p["type"], e["type"]), 0.1)
            time = 0.0 if dt <= 0 else min(1.0, 2.0 ** (-dt / 60.0))
            dep = (e["service"], p["service"]) in needs
            base = (time * 0.3 + (0.25 if p["service"] == e["service"] else 0.0) + (0.25 if dep else 0.0) + cause * 0.2
                    + (0.15 if p["pod"] and p["pod"] == e["pod"] else 0.0))
            ctx = 0.4 if in_deg.get(p["eid"], 0) == 0 else 0.0
            if out_edges.get(p["eid"]):
                ctx += 0.3
                if any(R.FAULT_CAUSALITY.get((kinds[s], e["type"]), 0.1) > 0.5 for s in out_edges[p["eid"]]):
                    ctx += 0.3
            conf = min(1.0, base + 0.15 * min(1.0, ctx))
            if conf >= theta:
                found.append((p["eid"], conf))
        best = sorted(found, key=lambda x: -x[1])[:2]
        for source, conf in best:
            edges.append((source, e["eid"], round(conf, 9)))
            out_edges.setdefault(source, []).append(e["eid"])
        in_deg[e["eid"]] = len(best)
    return edges


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_match_the_specification(make, seed):
    rnd = random.Random(seed)
    events = [{"fault_id": f"f{rnd.randint(0, 3)}", "eid": f"e{i:03d}", "t": T0 + rnd.randint(0, 400) * 1_000_000,
               "type": rnd.choice(TYPES), "service": rnd.choice("xyz"), "pod": rnd.choice(["p1", "p2", None]), "severity": "ERROR"}
              for i in range(60)]
    needs = {("x", "y"), ("y", "z")}
    df = make.frame([("a", *e.values()) for e in events], "client_id string, fault_id string, eid string, t long, type string, service string, pod string, severity string")
    dep = make.frame(sorted(("a", *n) for n in needs), "client_id string, service string, needs string")
    nodes = X.build_fpg(X.with_predecessors(df, dep))
    got = sorted((r.source, r.target, round(r.confidence, 9)) for r in X.fpg_edges(nodes).collect())
    want = sorted(e for f in {e["fault_id"] for e in events} for e in spec([x for x in events if x["fault_id"] == f], needs))
    assert got == want
    # distance to the alarm, by search on the same edges
    back = {}
    for s, t, _ in want:
        back.setdefault(t, []).append(s)
    dist = {}
    for alarm in [r.eid for r in nodes.where("is_last").collect()]:
        frontier, d, seen = [alarm], 0, {alarm: 0}
        while frontier:
            d += 1
            frontier = [s for x in frontier for s in back.get(x, []) if s not in seen]
            seen.update({s: d for s in frontier})
        dist.update(seen)
    assert {r.eid: r.dist for r in X.alarm_distance(nodes).collect() if r.dist is not None} == dist


def test_cpu_cascade(make):
    names = [("cpu_high", 0, "api"), ("latency_high", 30, "api"), ("memory_high", 60, "api"), ("oom_kill", 90, "api"),
             ("pod_restart", 95, "api"), ("error_rate_high", 100, "api"), ("latency_high", 110, "auth")]
    df = make.frame([("a", "f", f"evt_{i + 1:03d}", T0 + s * 1_000_000, k, svc, None, "ERROR") for i, (k, s, svc) in enumerate(names)],
                    "client_id string, fault_id string, eid string, t long, type string, service string, pod string, severity string")
    dep = make.frame([("a", "api", "auth"), ("a", "api", "user"), ("a", "auth", "db"), ("a", "user", "db")], "client_id string, service string, needs string")
    nodes = X.build_fpg(X.with_predecessors(df, dep))
    assert ("f", "evt_001") in rows(X.root_candidates(nodes), "fault_id", "eid")
    edges = {(r.source, r.target): r.relation for r in X.fpg_edges(nodes).collect()}
    assert edges[("evt_003", "evt_004")] == "CAUSES" and edges[("evt_004", "evt_005")] == "CAUSES"
    top = X.rank_root_causes(X.root_scores(nodes, dep)).orderBy("rank").first()
    assert top["rank"] == 1 and 0 <= top.rank_score <= 1


def test_dependencies_stay_in_their_tenant(make):
    """Two tenants with the same service names; only the first one's api needs auth."""
    df = make.frame([(c, f"{c}|f", f"{c}{i}", T0 + i * 10_000_000, k, svc, None, "ERROR") for c in "ab" for i, (k, svc) in enumerate([("latency_high", "auth"), ("custom", "api")])],
                    "client_id string, fault_id string, eid string, t long, type string, service string, pod string, severity string")
    dep = make.frame([("a", "api", "auth")], "client_id string, service string, needs string")
    scored = X.with_predecessors(df, dep)
    assert dict(rows(X.pair_scores(scored), "target", "relation")) == {"a1": "PROPAGATES_TO", "b1": "CORRELATES_WITH"}
    nodes = X.build_fpg(scored)
    assert rows(nodes, "client_id", "eid") == [("a", "a0"), ("a", "a1"), ("b", "b0"), ("b", "b1")]
    assert rows(X.service_distances(dep, df), "client_id", "service", "other", "hops") == [("a", "api", "auth", 1)]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_subsequences_are_the_table_s():
    rnd = random.Random(11)
    side = lambda letters: [[rnd.choice(letters) for _ in range(rnd.choice([0, 1, 4, 63, 64, 65, 129]))] for _ in range(400)]
    a, b = side("abcd"), side("abcde")
    assert X.lcs_lengths(a, b).tolist() == [slow_lcs(x, y) for x, y in zip(a, b)]
    assert X.lcs_lengths([], []).tolist() == [] and X.lcs_lengths([[]], [["x"]]).tolist() == [0]
    assert X.lcs_lengths([["x", None]], [[None, "x", None]]).tolist() == [2]


def test_bounds_leave_few_subsequences_and_lose_no_match(make):
    """The best of every shape among all scored pairs; bounds hold for every pair."""
    rnd = random.Random(8)
    arrays = lambda n, letters: [rnd.choice(letters) for _ in range(n)]
    def some(i, name):
        types = arrays(rnd.randint(1, 9), TYPES)
        return (f"{name}{i}", types, sorted(set(types)), sorted(set(arrays(2, "xyzw"))), [{"a": "1", "b": "2"}] * rnd.randint(0, 6))
    cols = "type_sequence array<string>, types array<string>, services array<string>, edges array<struct<a string, b string>>"
    shapes = make.frame([some(i, "s") for i in range(80)], f"shape string, {cols}")
    patterns = make.frame([(*some(i, "p"), rnd.randint(1, 4), "cpu_high") for i in range(120)], f"pattern_id string, {cols}, frequency long, root_type string")
    weights = (0.35, 0.25, 0.30, 0.10)
    pairs = shapes.select("shape").join(patterns.select("pattern_id"), F.lit(True))
    full = X._scored_pairs(pairs, shapes, patterns, weights)
    bounds = {(r.shape, r.pattern_id): r.bound for r in X._bounded_pairs(pairs, shapes, patterns, weights).collect()}
    everything = [(r.shape, -r.similarity, -r.frequency, r.pattern_id) for r in full.collect()]
    assert all(-s <= bounds[shape, p] for shape, s, _, p in everything)
    few = [(r.shape, -r.similarity, -r.frequency, r.pattern_id) for r in X._best_pairs(pairs, shapes, patterns, weights, 3).collect()]
    best = lambda rows: {s: sorted(r for r in rows if r[0] == s)[:3] for s in {r[0] for r in rows}}
    assert best(few) == best(everything)
    print(f"{len(few)} of {len(everything)} pairs scored by their subsequence")
    assert len(few) == len(set(few)) < 0.25 * len(everything)


def test_pattern_matching_against_all_pairs(make):
    rnd = random.Random(4)
    events = [("a", f"f{i // 6:02d}", f"e{i:03d}", T0 + i * 7_000_000, rnd.choice(TYPES), rnd.choice(["x", "y", "z", "w"]), None, "ERROR") for i in range(120)]
    df = make.frame(events, "client_id string, fault_id string, eid string, t long, type string, service string, pod string, severity string")
    dep = make.frame([("a", "x", "y")], "client_id string, service string, needs string")
    abstract = X.abstract_faults(X.build_fpg(X.with_predecessors(df, dep)))
    patterns = X.pattern_store(abstract)
    got = {(r.fault_id, r.rank): (r.pattern_id, round(r.similarity, 9)) for r in X.match_patterns(abstract, patterns, 3).collect()}

    def jac(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b))

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def struct(a, b):
        (n1, m1), (n2, m2) = [(len(z.type_sequence), len(z.edges)) for z in (a, b)]
        if m1 == m2 == 0:
            return 1.0
        d1, d2 = [m / (n * (n - 1)) if n > 1 else 0.0 for n, m in ((n1, m1), (n2, m2))]
        return (min(m1, m2) / max(m1, m2, 1) + (1.0 if d1 == d2 == 0 else 1 - abs(d1 - d2))) / 2

    for f in abstract.collect():
        scored = []
        for p in patterns.collect():
            s = (.35 * jac(f.types, p.types) + .25 * jac(f.services, p.services) + .30 * 2 * lcs(f.type_sequence, p.type_sequence)
                 / (len(f.type_sequence) + len(p.type_sequence)) + .10 * struct(f, p))
            scored.append((-round(s, 9), -p.frequency, p.pattern_id))
        for rank, (s, _, pid) in enumerate(sorted(scored)[:3], 1):
            assert got[(f.fault_id, rank)] == (pid, -s)


def _vectors(spark, n, seed, dim=8):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dim))
    x = centres[rnd.integers(0, 5, n)] + 0.25 * rnd.normal(size=(n, dim))
    data = [(int(i), [float(v) for v in row]) for i, row in enumerate(x.astype("float32"))]
    return spark.createDataFrame(data, "id long, vec array<float>"), np.array([d[1] for d in data])


def test_vectors_against_brute_force(spark):
    df, x = _vectors(spark, 300, 1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] >= 0.95}
    got = {(r.left_id, r.right_id) for r in E.vector_matches(df, None, 0.95, block_rows=20).collect()}
    assert want and got == want
    top = E.vector_matches(df, df, 0.9, k=4, block_rows=32)
    for i, ids in top.groupBy("left_id").agg(F.array_sort(F.collect_set("right_id"))).collect():
        order = [int(j) for j in np.argsort(-sims[i], kind="stable") if sims[i, j] >= 0.9][:4]
        assert ids == sorted(order)


def test_keyword_queries():
    assert E.keywords("What caused the OOM, in API?") == ["oom", "api"]
