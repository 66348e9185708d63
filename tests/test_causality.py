"""Links, windows, hops and walks on hand-made events."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.operators import causality as L, health as H, incidents as I, paths as P, reach, topology as T
from causalspark.operators.timejoin import numbered, range_join, sliding
from tests.conftest import T0, rows


def test_image_pull_rules_keep_first_match(make):
    ep = make.episodes([("e1", 0, "ErrImagePull", "p"), ("e2", 30, "ImagePullBackOff", "p"), ("e3", 60, "Failed", "p")])
    got = L.build_causality(ep, make.edges([("pod:ns:p", "node::n1", "RUNS_ON")]))
    assert rows(got, "cause", "effect", "domain_score", "distance_score") == [
        ("e1", "e2", 0.93, 0.95), ("e1", "e3", 0.9, 0.95), ("e2", "e3", 0.9, 0.95)]


def test_adaptive_window_and_oom(make):
    ep = make.episodes([("e1", 0, "OOMKilled", "p"), ("e2", 119, "BackOff", "p"), ("e3", 121, "BackOff", "p")])
    got = rows(L.build_causality(ep, make.edges([])), "cause", "effect")
    assert ("e1", "e2") in got and ("e1", "e3") not in got


def test_window_ends(make):
    edges = make.edges([("pod:ns:a", "node::n", "RUNS_ON"), ("pod:ns:b", "node::n", "RUNS_ON")])
    ep = make.episodes([("c0", 0, "X", "a"), ("c1", 900, "X", "a"), ("late", 900.000001, "X", "a"), ("e", 900, "Y", "b")])
    stream = rows(L.link_causes(ep, edges), "cause", "effect", "hops")
    assert ("c0", "e", 2) in stream and ("c1", "e", 2) in stream and ("late", "e", 2) not in stream
    ten = make.episodes([("c0", 0, "X", "a"), ("c1", 600, "X", "a"), ("e", 600, "Y", "a")])
    assert rows(L.window_pairs(ten), "c_eid", "e_eid") == []  # strict on both ends


def test_equal_times_give_no_endless_path(make):
    edges = make.edges([("pod:ns:a", "node::n", "RUNS_ON"), ("pod:ns:b", "node::n", "RUNS_ON")])
    ep = make.episodes([("x", 5, "X", "a"), ("y", 5, "Y", "b")])
    links = L.score_links_stream(L.link_causes(ep, edges), ep)
    assert rows(links, "cause", "effect") == [("x", "y"), ("y", "x")]
    chains = P.best_chains(links, 4)
    assert all(len(set(r.path)) == len(r.path) for r in chains.collect())


def test_hops(make):
    e = make.edges([("pod:ns:a", "node::n", "RUNS_ON"), ("pod:ns:b", "node::n", "RUNS_ON"), ("service:ns:s", "pod:ns:a", "SELECTS"),
                    ("service:ns:s", "pod:ns:c", "SELECTS"), ("replicaset:ns:r1", "pod:ns:a", "CONTROLS"),
                    ("replicaset:ns:r2", "pod:ns:d", "CONTROLS"), ("deployment:ns:d", "replicaset:ns:r1", "CONTROLS"),
                    ("deployment:ns:d", "replicaset:ns:r2", "CONTROLS")])
    want = {("pod:ns:a", "pod:ns:b"): 2, ("pod:ns:a", "pod:ns:c"): 2, ("service:ns:s", "pod:ns:b"): 3,
            ("pod:ns:a", "pod:ns:d"): None, ("pod:ns:a", "node::x"): None, ("pod:ns:a", "node::n"): 1}
    pairs = make.frame([("a", s, d) for s, d in want], "client_id string, src string, dst string")
    got = {(r.src, r.dst): r.hops for r in reach.hops(pairs, e).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_a_hub_event_does_not_go_to_every_pod(make):
    """Rows of the sorted pass do not grow with the pods of a node, and every pod still meets its node."""
    pods = 300
    edges = make.edges([(f"pod:ns:p{i}", "node::n", "RUNS_ON") for i in range(pods)] + [("service:ns:s", f"pod:ns:p{i}", "SELECTS") for i in range(pods)])
    ep = make.episodes([("n", 0, "NodeNotReady", "n", "ERROR", "k8s.event", "m", "a", "Node", ""), ("s", 1, "Unhealthy", "s", "ERROR", "k8s.event", "m", "a", "Service", "ns"),
                        ("p", 2, "Failed", "p7")])
    c, e = L._batch_sides(ep)
    assert L.probe_rows(c, e, edges, R.BATCH_DOMAIN_RULES, {}, {}).count() < 60
    assert rows(L.link_causes(ep, edges), "cause", "effect", "hops") == [("n", "p", 1), ("n", "s", 2), ("s", "p", 1)]
    assert reach.labels(edges).count() < 5 * pods


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hops_against_search_on_random_graphs(make, seed):
    rnd = random.Random(seed)
    names = [f"v{i}" for i in range(14)]
    edges = {(a, b) for a, b in itertools.combinations(names, 2) if rnd.random() < 0.13}
    edges |= {("v0", v) for v in names[1:9]}  # a hub
    near = {v: set() for v in names}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    want = {}
    for s in names:
        seen, frontier = {s}, {s}
        for d in (1, 2, 3):
            frontier = {y for x in frontier for y in near[x]} - seen
            seen |= frontier
            want.update({(s, y): d for y in frontier})
    pairs = make.frame([("a", s, d) for s in names for d in names if s != d], "client_id string, src string, dst string")
    got = {(r.src, r.dst): r.hops for r in reach.hops(pairs, make.edges([(a, b, "SELECTS") for a, b in edges])).collect()}
    assert got == want


def test_tenants_never_mix(make):
    ep = make.episodes([("e1", 0, "Error", "p"), ("e2", 10, "BackOff", "p", "ERROR", "k8s.event", "m", "b")])
    assert L.build_causality(ep, make.edges([])).count() == 0


def _exchanges(df, wanted):
    """How often the plan shuffles ``wanted`` columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and any(f"{c}#" in line for c in wanted)]


def test_links_are_not_shuffled(make):
    """Only events are: a pair comes out where it is found."""
    ep, edges = _burst(make, 1, 40)
    for links in (L.build_causality(ep, edges), L.link_causes(ep, edges), L.scored_causes_stream(ep, edges)):
        assert _exchanges(links, ["cause", "effect", "c_eid", "e_eid"]) == []


def test_sibling_pairs_are_counted_where_they_are_formed(spark, make):
    """No pair is shuffled between the join and the counts."""
    edges = make.edges([("deployment:ns:d", "replicaset:ns:r", "CONTROLS"), ("deployment:ns:d", "replicaset:ns:q", "CONTROLS")]
                       + [(f"replicaset:ns:{'rq'[i % 2]}", f"pod:ns:p{i}", "CONTROLS") for i in range(4)])
    rnd = random.Random(4)
    ep = make.episodes([(f"e{i:02d}", rnd.randrange(900), "Failed", f"p{rnd.randrange(4)}") for i in range(60)])
    at = {r.eid: (r.t, r.rid) for r in ep.collect()}
    want = {}
    for c, (t, rid) in at.items():
        near = [other for u, other in at.values() if t < u <= t + 300_000_000 and other != rid]
        want |= {c: (len(near), len(set(near)))} if near else {}
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.sibling_impact(ep, edges, 300)
        assert {r.eid: (r.sibling_events, r.sibling_pods) for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert not any("Exchange" in line and "e_rid#" in line and "c_eid#" in line for line in plan.splitlines())
    assert not any("Exchange" in line and "c_eid#" in line and "_slice#" not in line for line in plan.splitlines())


@pytest.mark.parametrize("seed,rows_at_once", [(21, 20_000), (22, 37), (23, 5)])
def test_streamed_links_are_all_pairs(make, monkeypatch, seed, rows_at_once):
    """Every pair in reach once with its least hops, and the same links from few and from many batches."""
    from causalspark.operators import latest
    ep, edges = _burst(make, seed, 150, 4000)
    width = 900 * 1_000_000
    pairs = range_join(L.side(ep, "c"), L.side(ep, "e"), ["client_id"], width).where("c_rid <> e_rid")
    want = rows(L.with_hops(pairs, edges).where("hops > 0"), "client_id", "c_eid", "e_eid", "hops")
    best = rows(L.build_causality(ep, edges))
    sorted_rows = L.sorted_rows(L._stream_rows(ep, edges, 3, F.lit(0), F.lit(0)), width).coalesce(1).sortWithinPartitions("client_id", "slice", "t", F.desc("eid")).toArrow()
    monkeypatch.setattr(latest, "ROWS", rows_at_once)
    monkeypatch.setattr(latest, "PAIRS", rows_at_once)
    found = [tuple(r.values())[:4] for b in latest.all_earlier(iter(sorted_rows.to_batches(3)), width, 3) for r in b.to_pylist()]
    assert want and sorted(found) == want
    c, e = L._batch_sides(ep)
    scoring, classes, signatures = L._pass_scoring(c, e, R.BATCH_DOMAIN_RULES, 5, 0.3, (0.4, 0.3, 0.3))
    table = L.sorted_rows(L.probe_rows(c, e, edges, R.BATCH_DOMAIN_RULES, classes, signatures), width).coalesce(1).sortWithinPartitions("client_id", "slice", "t", F.desc("eid")).toArrow()
    links = [(r["client_id"], r["cause"], r["effect"], r["hops"], r["rank"]) for b in latest.best_earlier(iter(table.to_batches(3)), scoring) for r in b.to_pylist()]
    assert sorted(links) == sorted((*r[:4], r[-1]) for r in best)


def test_streamed_scores_are_those_of_the_joined_texts(make):
    ep, edges = _burst(make, 24, 120)
    texts = F.element_at(F.array(*[F.lit(m) for m in ("connection refused", "Database gone", "api down", "quiet")]), (F.crc32("eid") % 4 + 1).cast("int"))
    ep = ep.withColumn("message", texts).withColumn("severity", F.when(F.crc32(F.concat("eid", F.lit("s"))) % 3 == 0, "INFO").otherwise("ERROR"))
    want = L.score_links_stream(L.link_causes(ep, edges), ep)
    assert rows(L.scored_causes_stream(ep, edges)) == rows(want) and want.select("domain_score").distinct().count() > 4


REASONS = ["OOMKilled", "Failed", "BackOff", "Error", "ImagePullBackOff", "ErrImagePull", "Killing", "Unhealthy", "FailedMount", "Pulled",
           "FailedScheduling", "ExitCode", "Evicted"]


def _burst(make, seed, n=400, span=700):
    """Most events belong to one tenant and one busy pod inside a few minutes."""
    rnd = random.Random(seed)
    pods = ["hot"] * 6 + [f"p{i}" for i in range(10)]
    out = []
    for i in range(n):
        client = "a" if rnd.random() < 0.9 else "b"
        sec = round(rnd.uniform(0, span), rnd.choice([0, 1, 3]))
        kind = "Service" if rnd.random() < 0.1 else "Pod"
        out.append((f"e{i:04d}", sec, rnd.choice(REASONS), "s0" if kind == "Service" else rnd.choice(pods), "ERROR",
                    "k8s.event", "m", client, kind, rnd.choice(["n1", "n2"])))
    edges = []
    for ns in ("n1", "n2"):
        for i, p in enumerate(["hot"] + [f"p{j}" for j in range(10)]):
            edges.append((f"pod:{ns}:{p}", f"node::n{i % 2}", "RUNS_ON"))
            if i % 3 == 0:
                edges.append((f"service:{ns}:s0", f"pod:{ns}:{p}", "SELECTS"))
            edges.append((f"replicaset:{ns}:r{i % 4}", f"pod:{ns}:{p}", "CONTROLS"))
    return make.episodes(out), make.edges(edges)


def _all_pairs(ep, edges, rules=None):
    """The same links from every pair inside the windows."""
    return L.top_causes(L.score_links_batch(L.with_hops(L.window_pairs(ep), edges), rules))


MIXED_RULES = [("OOMKilled", ["BackOff", "~Fail"], 0.9), ("~Image", ["Failed"], 0.05), ("~Err", ["BackOff", "Failed"], 0.6),
               ("Failed", ["~a"], 0.1), ("Pulled", ["Killing"], 0.0)]


@pytest.mark.parametrize("seed,rules", [(11, None), (12, None), (13, MIXED_RULES), (14, MIXED_RULES[::-1]), (15, [])])
def test_links_of_a_burst_are_the_best_of_all_pairs(make, seed, rules):
    """Rules above and below the default score, and none."""
    ep, edges = _burst(make, seed)
    cols = ["client_id", "effect", "rank", "cause", "confidence", "hops"]
    assert rows(L.build_causality(ep, edges, rules), *cols) == rows(_all_pairs(ep, edges, R.BATCH_DOMAIN_RULES if rules is None else rules), *cols)


def test_link_invariants(make):
    ep, edges = _burst(make, 5)
    links = L.build_causality(ep, edges).collect()
    assert links and all(0 <= x.confidence <= 1 and x.rank <= 5 and x.hops in (0, 1, 2, 3) for x in links)
    t = {r.eid: (r.t, r.client_id) for r in ep.collect()}
    assert all(t[x.cause][0] < t[x.effect][0] and t[x.cause][1] == t[x.effect][1] for x in links)


def test_range_join_finds_each_pair_once(make):
    rnd = random.Random(3)
    times = [rnd.choice([0, 10, 20, 29, 30, 31, 60]) for _ in range(40)]
    c = make.frame([(1, i, t) for i, t in enumerate(times)], "k int, c int, c_t long")
    e = make.frame([(1, i, t) for i, t in enumerate(times)], "k int, e int, e_t long")
    got = rows(range_join(c, e, ["k"], 30), "c", "e")
    assert got == sorted((i, j) for i, a in enumerate(times) for j, b in enumerate(times) if 0 <= b - a <= 30)


@pytest.mark.parametrize("before,after", [(10, 0), (0, 10), (7, 5), (1, 1)])
def test_sliding_windows_against_brute_force(make, before, after):
    rnd = random.Random(before)
    data = [(k, i, rnd.randrange(-40, 60), rnd.choice(["x", "y", None])) for i, k in enumerate("aab" * 30)]
    df = make.frame(data, "k string, i int, t long, v string")
    got = {r.i: (r.n, r.xs, r.last, sorted(r.seen)) for r in sliding(df, ["k"], before, after, {
        "n": ("count", F.lit(1)), "xs": ("count", F.when(F.col("v") == "x", 1)), "last": ("max", F.when(F.col("v") == "y", F.col("t"))),
        "seen": ("set", F.col("v"))}).collect()}
    for k, i, t, _ in data:
        near = [(t2, v) for k2, _, t2, v in data if k2 == k and t - before <= t2 <= t + after]
        assert got[i] == (len(near), sum(v == "x" for _, v in near), max((t2 for t2, v in near if v == "y"), default=None), sorted({v for _, v in near if v}))


def test_numbering_across_slices(make):
    times = [0, 5, 5, 99, 100, 250, 1000]
    df = make.frame([("k", i, t) for i, t in enumerate(times)], "k string, i int, t long")
    got = {r.i: r.position for r in numbered(df, ["k"], ["t", "i"], 100).collect()}
    assert got == {i: i + 1 for i in range(len(times))}


def test_escalation(make):
    ep = make.episodes([(f"w{i}", i * 60, "Unhealthy", "p", "WARNING") for i in range(4)]
                       + [("later", 2000, "Unhealthy", "p", "WARNING")]
                       + [(f"x{i}", i, "Error", "q", "ERROR") for i in range(4)])
    got = {r.eid: (r.severity, r.repeat_count) for r in I.escalate_severity(ep).collect()}
    assert got["w3"] == ("ERROR", 3) and got["later"] == ("WARNING", 0) and got["x3"] == ("FATAL", 3)
    assert got["w2"] == ("WARNING", 0)


def test_alert_groups(make):
    base = [("a1", 0), ("a2", 60), ("a3", 120), ("a2", 130), ("b1", 120 + 361)]
    ep = make.episodes([(e, s, "X", "p", "WARNING", "prom.alert", "m") for e, s in base]
                       + [("o1", 0, "Y", "p", "WARNING", "prom.alert", "m"), ("o2", 0, "X", "p", "ERROR", "prom.alert", "m")])
    g = I.group_alerts(ep)
    by = {}
    for r in g.collect():
        by.setdefault(r.group_id, []).append((r.eid, r.action))
    assert sorted(sorted(v) for v in by.values()) == [
        [("a1", "new"), ("a2", "duplicate"), ("a2", "grouped"), ("a3", "grouped")], [("b1", "new")], [("o1", "new")], [("o2", "new")]]
    many = make.episodes([(f"m{i:03d}", i, "Z", "p", "WARNING", "prom.alert", "m") for i in range(101)])
    assert sorted(r.alerts for r in I.alert_group_summary(I.group_alerts(many)).collect()) == [1, 100]


def test_chain_of_three(make):
    links = make.frame([("a", "db", "api", 0.9), ("a", "api", "web", 0.8)], "client_id string, cause string, effect string, confidence double")
    best = {r.target: r for r in P.best_chains(links, 5, from_roots=True).collect()}
    assert best["web"].path == ["db", "api", "web"] and abs(best["web"].overall - 0.72) < 1e-12
    assert rows(P.true_roots(links), "eid") == [("db",)]


def test_accuracy_at_k(make):
    ep = make.episodes([("oom", 0, "OOMKilled", "p"), ("pull", 1, "Pulled", "p"), ("s1", 10, "CrashLoopBackOff", "p"),
                        ("s2", 11, "Strange", "p"), ("s3", 12, "Evicted", "p")])
    links = make.frame([("a", "pull", "s1", 0.9), ("a", "oom", "s1", 0.8), ("a", "oom", "s2", 0.5), ("a", "pull", "s3", 0.5)],
                       "client_id string, cause string, effect string, confidence double")
    named = L.named_links(links, ep)
    strict = {r.k: r for r in H.accuracy_at_k(H.match_ranks(named, ep)).collect()}
    assert strict[1].correct == 0 and strict[3].correct == 1 and strict[1].total == 3
    top = {r.k: r for r in H.accuracy_at_k(H.match_ranks(named, ep, assume_top=True)).collect()}
    assert top[1].correct == 2 and abs(top[1].mean_rank - 4 / 3) < 1e-12


def test_selector_mismatch_selects_nothing(spark):
    svc = spark.sql("SELECT 'a' client_id, 'n' ns, 's' rid, map('app', 'api') selector")
    pod = spark.sql("SELECT 'a' client_id, 'n' ns, 'p' rid, map('app', 'backend') labels")
    assert T.selects_by_labels(svc, pod).count() == 0
    both = spark.sql("SELECT 'a' client_id, 'n' ns, 'p' rid, map('app', 'api', 'x', 'y') labels")
    assert rows(T.selects_by_labels(svc, both), "src", "dst") == [("s", "p")]


def test_cause_classes_are_those_that_occur(make):
    ep = make.episodes([(f"e{i}", i, r, "p") for i, r in enumerate(["OOMKilled", "OOMKilled", "Pulled", "Strange"])])
    classes = L.cause_classes(L.side(ep, "c"), R.BATCH_DOMAIN_RULES)
    assert len(classes) == len(set(classes)) <= 3 and any(not s for _, s in classes) and any(s for _, s in classes)


def test_alert_keys_keep_their_parts_apart(make):
    """A missing part leaves its place; case does not matter; a missing reason or severity is named."""
    ep = make.episodes([("a", 0, "X", "p", None, "prom.alert", "Disk FULL"), ("b", 1, "x", "p", None, "prom.alert", "disk full"),
                        ("c", 2, None, "p", "X", "prom.alert", "disk full"), ("d", 3, "", "p", "", "prom.alert", None), ("e", 4, "X", "p", "", "prom.alert", "y" * 60)])
    got = {r.eid: r.fingerprint for r in I.group_alerts(ep).collect()}
    assert got == {"a": "x::unknown::pod::ns::disk full", "b": "x::unknown::pod::ns::disk full", "c": "unknown::x::pod::ns::disk full",
                   "d": "unknown::unknown::pod::ns::", "e": "x::unknown::pod::ns::" + "y" * 50}


def test_reach_pairs_are_found_in_the_slices_of_links(make):
    """Chains over the ends of slices, many roots at a time or one; pairs are not shuffled, joined or grouped by Spark."""
    rng = random.Random(7)
    times = {f"e{i:03d}": i * 150 for i in range(150)}
    ep = make.episodes([(e, t, "X", f"p{i % 5}", "ERROR", "k8s.event", "m", "ab"[i % 2]) for i, (e, t) in enumerate(times.items())])
    ids = [list(times)[k::2] for k in (0, 1)]
    links = [("ab"[k], c, e, rng.choice([0.5, 0.7, 0.9])) for k in (0, 1) for c, e in itertools.combinations(ids[k], 2)
             if times[e] - times[c] <= 900 and rng.random() < 0.6]
    best = {}
    for client, root, eid, conf in links:
        walks = [(root, eid, conf, conf, 1)]
        while walks:
            r, at, product, first, h = walks.pop()
            old = best.get((client, r, at), (9, 0.0, 0.0))
            best[client, r, at] = (min(old[0], h), max(old[1], product), max(old[2], first))
            if h < 3:
                walks += [(r, e2, product * c2, first, h + 1) for cl, c1, e2, c2 in links if cl == client and c1 == at]
    frame = make.frame(links, "client_id string, cause string, effect string, confidence double")
    name = {e: f"p{i % 5}" for i, e in enumerate(times)}
    for at_once in (1, 2_000_000):
        pairs = P.reach_pairs(frame, ep, 3, carry=("s_name", "t"), at_once=at_once)
        got = {(r.client_id, r.root, r.eid): (r.hops, round(r.product, 9), r.first, r.s_name) for r in pairs.collect()}
        assert got == {k: (h, round(p, 9), f, name[k[2]]) for k, (h, p, f) in best.items()}
    some = ep.where("eid < 'e040'")
    assert {(r.client_id, r.root, r.eid) for r in P.reach_pairs(frame, ep, 3, some).collect()} == {k for k in best if k[1] < "e040"}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Exchange" not in above and "Aggregate" not in above and "Join" not in above
    late = make.frame([("a", "e000", "e148", 0.5)], "client_id string, cause string, effect string, confidence double")
    with pytest.raises(Exception, match="spans more than the window"):
        P.reach_pairs(late, ep).collect()


def test_chains_in_slices_equal_rounds_of_joins(spark, make):
    rng = np.random.default_rng(5)
    at = np.sort(rng.integers(0, 6 * 3600, 300))
    names = [f"e{i}" for i in rng.permutation(300)]
    episodes = make.episodes([(e, float(t), "Failed", "p") for e, t in zip(names, at, strict=True)])
    pairs = [(i, j) for j in range(300) for i in range(j) if 0 < at[j] - at[i] < 900]
    kept = [pairs[k] for k in rng.choice(len(pairs), 700, replace=False)]
    links = make.frame([("a", names[i], names[j], float(rng.integers(1, 5)) / 4, int(at[j] - at[i])) for i, j in kept],
                       "client_id string, cause string, effect string, confidence double, time_gap_seconds long")
    for hops, conf, roots in [(1, 0.0, False), (3, 0.0, False), (3, 0.5, False), (6, 0.0, True), (2, 0.5, True)]:
        want = rows(P.best_chains(links, hops, conf, roots).withColumn("path", F.array_join("path", ">")).withColumn("confidences", F.col("confidences").cast("string")))
        for given in (links, links.drop("time_gap_seconds")):
            got = P.best_chains(given, hops, conf, roots, episodes=episodes)
            assert rows(got.withColumn("path", F.array_join("path", ">")).withColumn("confidences", F.col("confidences").cast("string"))) == want
    shuffles = lambda hops: P.best_chains(links, hops, episodes=episodes)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles(3) == shuffles(9)
    long = make.frame([("a", names[0], names[-1], 0.5)], "client_id string, cause string, effect string, confidence double")
    with pytest.raises(Exception, match="spans the window"):
        P.best_chains(long, 3, episodes=episodes).collect()


def test_types_of_shortest_paths_without_pairs_under_a_hub(spark, make):
    rng = random.Random(8)
    kinds = ["SELECTS", "RUNS_ON", "CONTROLS"]
    edges = {(f"r{rng.randrange(26)}", f"r{rng.randrange(26)}", rng.choice(kinds)) for _ in range(34)} | {(f"p{i}", "hub", "RUNS_ON") for i in range(60)} | {("p0", "r0", "SELECTS")}
    near: dict[str, set] = {}
    for a, b, t in edges:
        if a != b:
            near.setdefault(a, set()).add((b, t))
            near.setdefault(b, set()).add((a, t))
    want = {}
    for a in near:
        level = {(a, ())}
        for h in (1, 2, 3):
            level = {(y, tuple(sorted((*ts, t)))) for x, ts in level for y, t in near[x]}
            for y, ts in level:
                if y != a and (known := want.get((a, y), (9, ""))) and (h, ",".join(ts)) < known:
                    want[a, y] = h, ",".join(ts)
    table = make.edges(sorted(edges))
    named = make.frame([("a", f"{x}>{y}", x, y, h) for (x, y), (h, _) in sorted(want.items())], "client_id string, cause string, c_rid string, e_rid string, hops int")
    got = rows(P.cross_service_failures(named, table), "c_rid", "e_rid", "types")
    assert got == sorted((a, b, ts) for (a, b), (_, ts) in want.items())
    assert P.typed_labels(table).select(F.sum(F.size("spots"))).first()[0] < 1000  # 60 pods under a hub make 3,600 pairs


def test_trigger_cascades_count_pairs_where_they_are_formed(spark, make, monkeypatch):
    rng = random.Random(3)
    names = [f"p{i}" for i in range(12)]
    edges = make.edges([(f"pod:ns:{p}", f"node::{i % 3}", "RUNS_ON") for i, p in enumerate(names)] + [("service:ns:s", "pod:ns:p0", "SELECTS")])
    episodes = make.episodes([(f"e{i:03}", float(rng.randrange(0, 4000)), "Failed", rng.choice(names), rng.choice(["ERROR", "INFO"])) for i in range(250)])
    failing = F.col("severity") == "ERROR"
    pairs = L.link_causes(episodes, edges, 5, causes=failing).where("gap_us > 0")
    want = rows(pairs.groupBy("client_id", F.col("cause").alias("eid")).agg(F.count("*"), F.min("hops")))
    monkeypatch.setattr("causalspark.operators.latest.PAIRS", 50)
    assert rows(L.later_near(episodes, edges, 5, causes=failing)) == want
    out = {r.eid: (r.near_events, r.nearest) for r in P.trigger_cascades(episodes, edges, 5).collect()}
    assert {k: v for k, v in out.items() if v[0]} == {eid: (n, h) for _, eid, n, h in want}


def test_cascading_failures_sum_over_twins(spark, make):
    rng = random.Random(12)
    pairs = {(f"pod:ns:p{i}", f"node::{i % 4}") for i in range(80)} | {(f"service:ns:s{i % 3}", f"pod:ns:p{i}") for i in range(80)}
    pairs |= {(f"pod:ns:q{rng.randrange(15)}", f"pod:ns:q{rng.randrange(15)}") for _ in range(14)}
    edges = make.edges([(a, b, "RUNS_ON") for a, b in sorted(pairs)])
    names = [f"p{i}" for i in range(80)] + [f"q{i}" for i in range(15)] + ["alone"]
    said = [rng.choice(names) for _ in range(400)]
    episodes = make.episodes([(f"e{i}", float(i % 60), "Failed", p) for i, p in enumerate(said)])
    near: dict[str, set] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    n = {f"pod:ns:{p}": said.count(p) for p in set(said)}
    want = []
    for a in near:
        others = (near[a] | {c for b in near[a] for c in near[b]}) - {a}
        related = sum(n.get(b, 0) for b in others)
        if n.get(a, 0) >= 5 and related >= 3:
            want.append(("a", a, n[a], related))
    assert rows(I.cascading_failures(episodes, edges), "client_id", "rid", "error_count", "related_errors") == sorted(want)
    twins = reach.twins(reach.undirected(edges))
    assert twins.where("rid LIKE 'pod:ns:p%'").select("twin").distinct().count() == 12  # 80 pods, 12 pairs of node and service


@pytest.mark.parametrize("at_once", [1, 7])
def test_events_of_one_time_are_linked_whatever_the_batches(make, monkeypatch, at_once):
    from causalspark.operators import latest
    _, edges = _burst(make, 32, 1)
    ep = make.episodes([(f"e{i:02d}", 60 * (i // 9), "X", f"p{i % 9}", "ERROR", "k8s.event", "m", "a", "Pod", "n1") for i in range(36)])
    width = 15 * 60 * 1_000_000
    table = L.sorted_rows(L._stream_rows(ep, edges, 3, F.lit(0), F.lit(0)), width).coalesce(1).sortWithinPartitions("client_id", "slice", "t", F.desc("eid")).toArrow()
    want = rows(L.link_causes(ep, edges), "client_id", "cause", "effect", "hops")
    assert any(r[1] > r[2] for r in want)
    monkeypatch.setattr(latest, "ROWS", at_once)
    assert sorted(tuple(r.values())[:4] for b in latest.all_earlier(iter(table.to_batches(2)), width, 3) for r in b.to_pylist()) == want


@pytest.mark.parametrize("at_once", [1, 30, 100_000])
def test_siblings_are_counted_without_pairs(make, at_once):
    """Events of equal time and busy pods, over many slices and batches; the plan has no pair of events."""
    import pyarrow as pa
    from causalspark.operators import windowcounts
    rnd = random.Random(at_once)
    width, events = 300, sorted((rnd.choice("ab"), rnd.randrange(-400, 3000), f"p{min(rnd.randrange(9), rnd.randrange(9))}", rnd.random() < 0.5, i) for i in range(500))
    cut = sorted((c, t // width - back, t, f"e{i}", v, fails and not back) for c, t, v, fails, i in events for back in (0, 1))
    table = pa.table(dict(zip(("client_id", "slice", "t", "eid", "value", "asked"), map(list, zip(*cut, strict=True)), strict=True)))
    old, windowcounts.ROWS = windowcounts.ROWS, at_once
    try:
        got = [tuple(r.values()) for b in windowcounts._passed(iter(table.to_batches(7)), ["client_id"], width) for r in b.to_pylist()]
    finally:
        windowcounts.ROWS = old
    near = {i: [v2 for c2, u, v2, *_ in events if c2 == c and t < u <= t + width and v2 != v] for c, t, v, fails, i in events if fails}
    assert sorted(got) == sorted((c, f"e{i}", len(near[i]), len(set(near[i]))) for c, *_, i in events if near.get(i))
    edges = make.edges([("deployment:ns:d", "replicaset:ns:r", "CONTROLS"), ("replicaset:ns:r", "pod:ns:p0", "CONTROLS"), ("replicaset:ns:r", "pod:ns:p1", "CONTROLS")])
    plan = P.sibling_impact(make.episodes([("e0", 0, "Failed", "p0"), ("e1", 9, "Failed", "p1")]), edges, 300)._jdf.queryExecution().executedPlan().toString()
    assert "c_eid" not in plan and "e_eid" not in plan


def test_related_resources_of_twins(spark, make, monkeypatch):
    """As from every path of the whole graph; what is followed are sets of twins, however many resources they have."""
    rnd = random.Random(5)
    pods = [f"pod:ns:p{i}" for i in range(60)]
    edges = [(p, f"node::n{i % 3}", "RUNS_ON") for i, p in enumerate(pods)] + [(f"service:ns:s{i % 2}", p, "SELECTS") for i, p in enumerate(pods) if i % 5]
    edges += [("service:ns:s0", "service:ns:s1", "CALLS"), ("node::n0", "node::n0", "RUNS_ON")] + [(p, "node::lone", "RUNS_ON") for p in pods[:1]]
    ep = make.episodes([(f"e{i}", i, "Failed", f"p{rnd.randrange(60)}", rnd.choice(["ERROR", "INFO"])) for i in range(80)] + [("x", 1, "Failed", "gone")]
                       + [("n", 2, "NodeNotReady", "n1", "FATAL", "k8s.event", "m", "a", "Node", "")])
    next_to = {}
    for a, b, _ in edges:
        if a != b:
            next_to.setdefault(a, set()).add(b)
            next_to.setdefault(b, set()).add(a)
    want = []
    for rid in {r.rid for r in ep.where("severity <> 'INFO'").collect()}:
        one = next_to.get(rid, set())
        two = {c for b in one for c in next_to[b]} - one - {rid}
        want += [("a", rid, o, 1) for o in one] + [("a", rid, o, 2) for o in two]
    followed, plain = [], P.topology.neighbourhood

    def counted(roots, *rest):
        followed.append(roots.count())
        return plain(roots, *rest)
    monkeypatch.setattr(P.topology, "neighbourhood", counted)
    assert rows(P.rca_related(ep, make.edges(edges), 2)) == sorted(want)
    assert followed[0] <= 13 < len({r[1] for r in want})
    assert rows(P.rca_related(ep, make.edges(edges), 1)) == sorted(r for r in want if r[3] == 1)
