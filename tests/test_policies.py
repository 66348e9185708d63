"""Selector expressions against pair by pair evaluation, and the states of claims, configurations and quotas."""

import random

import pytest

from causalspark.operators import policies as P
from tests.conftest import rows

NEED = "array<struct<key:string,operator:string,values:array<string>>>"
SELECTORS = f"client_id string, ns string, rid string, requirements {NEED}"
PODS = "client_id string, ns string, rid string, labels map<string,string>"


def _meets(labels, key, operator, values):
    labels = {k: v or "" for k, v in (labels or {}).items()}
    values = [v or "" for v in values or []]
    return {"In": labels.get(key) in values if key in labels else False, "NotIn": labels.get(key) not in values if key in labels else True,
            "Exists": key in labels, "DoesNotExist": key not in labels}.get(operator, False)


def _slow(selectors, pods):
    return sorted({(c, n or "", s, r) for c, n, s, needs in selectors for pc, pn, r, labels in pods
                   if c == pc and (n or "") == (pn or "") and all(_meets(labels, *need) for need in needs or [])})


@pytest.mark.parametrize("seed", range(4))
def test_random_selectors(spark, seed):
    rng = random.Random(seed)
    values, keys = ["x", "y", "z", None], ["k1", "k2", "k3"]
    pods = [(rng.choice("ab"), rng.choice(["n", "m", None]), f"p{i}",
             rng.choice([None, {k: rng.choice(values) for k in rng.sample(keys, rng.randint(0, 3))}])) for i in range(60)]
    need = lambda: (rng.choice(keys), rng.choice(["In", "NotIn", "Exists", "DoesNotExist", "In", "NotIn", "Near", None]),
                    rng.choice([None, []] + [rng.choices(values, k=n) for n in (1, 2, 3)]))
    selectors = [(rng.choice("ab"), rng.choice(["n", "m", None]), f"s{i}", rng.choice([None] + [[need() for _ in range(n)] for n in (0, 1, 1, 2, 3)]))
                 for i in range(60)]
    want = _slow(selectors, pods)
    s = spark.createDataFrame(selectors + selectors[:5], SELECTORS)
    p = spark.createDataFrame(pods + pods[:5], PODS)
    assert rows(P.selected(s, p), "client_id", "ns", "src", "dst") == want
    counts = {r[:3]: r[3] for r in rows(P.selected_counts(s, p), "client_id", "ns", "src", "pods")}
    assert counts == {(c, n or "", name): sum(w[:3] == (c, n or "", name) for w in want) for c, n, name, _ in selectors}


def test_empty_tables(spark):
    s, p = spark.createDataFrame([], SELECTORS), spark.createDataFrame([("a", "n", "p", {"k": "v"})], PODS)
    assert P.selected(s, p).count() == P.selected_counts(s, p).count() == 0
    s = spark.createDataFrame([("a", "n", "s", [])], SELECTORS)
    assert rows(P.selected_counts(s, p.limit(0)), "src", "pods") == [("s", 0)]


def test_isolation_counts_each_direction(spark):
    policies = spark.createDataFrame(
        [("a", "n", "in", [("k", "In", ["v"])], None), ("a", "n", "both", [], ["Ingress", "Egress"]), ("a", "m", "other", [], ["Egress"])],
        SELECTORS + ", directions array<string>")
    pods = spark.createDataFrame([("a", "n", "p1", {"k": "v"}), ("a", "n", "p2", None), ("a", "m", "p3", {}), ("b", "n", "p4", {"k": "v"})], PODS)
    assert rows(P.pod_isolation(policies, pods), "client_id", "rid", "ingress", "egress") == [
        ("a", "p1", 2, 1), ("a", "p2", 1, 1), ("a", "p3", 0, 1), ("b", "p4", 0, 0)]


def test_claim_states(spark):
    claims = spark.createDataFrame([("a", "n", "bound", "v1"), ("a", "n", "wrong", "v2"), ("a", "n", "lost", "gone"), ("a", "n", "waits", None),
                                    ("a", "n", "waits", None), ("b", "n", "bound", "v1")], "client_id string, ns string, name string, volume string")
    volumes = spark.createDataFrame([("a", "v1", "n", "bound", 5), ("a", "v2", "n", "bound", 6), ("a", "v3", None, None, 7), ("a", "v4", "n", "left", 8),
                                     ("a", "v5", "n", "waits", 9)], "client_id string, name string, claim_ns string, claim_name string, capacity long")
    mounts = spark.createDataFrame([("a", "n", "p1", "bound"), ("a", "n", "p2", "bound"), ("a", "n", "p2", "bound")], "client_id string, ns string, pod string, claim string")
    got = {(r.client_id, r.claim, r.volume): (r.state, r.capacity, r.pods) for r in P.claim_bindings(claims, volumes, mounts).collect()}
    assert got == {("a", "bound", "v1"): ("Bound", 5, 2), ("a", "wrong", "v2"): ("Mismatched", 6, 0), ("a", "lost", "gone"): ("Lost", None, 0),
                   ("a", "waits", None): ("Pending", None, 0), ("b", "bound", "v1"): ("Lost", None, 0), ("a", None, "v3"): ("Available", 7, 0),
                   ("a", None, "v4"): ("Released", 8, 0), ("a", None, "v5"): ("Reserved", 9, 0)}


def test_configurations_quotas_and_privileges(spark):
    pods = spark.createDataFrame([("a", "n", "p1", [("ConfigMap", "c"), ("ConfigMap", "c"), ("Secret", None)], True, 0), ("a", "n", "p2", [("ConfigMap", "c"), ("Secret", "s")], False, 5),
                                  ("a", "n", "p3", None, None, 0), ("a", "n", "p4", [], None, None)],
                                 "client_id string, ns string, rid string, refs array<struct<kind:string,name:string>>, privileged boolean, run_as_user long")
    configs = spark.createDataFrame([("a", "n", "ConfigMap", "c"), ("a", "n", "Secret", "idle")], "client_id string, ns string, kind string, name string")
    assert rows(P.config_usage(pods, configs), "kind", "name", "users", "state") == [
        ("ConfigMap", "c", 2, "used"), ("Secret", "idle", 0, "unused"), ("Secret", "s", 1, "missing")]
    assert rows(P.privileged_pods(pods), "rid", "findings") == [("p1", "privileged, runs as root"), ("p3", "runs as root")]
    quotas = spark.createDataFrame([("a", "n", "Pod", 10), ("a", "n", "Pod", 4), ("a", "n", "Job", 0), ("a", "m", "Pod", 5), ("a", "n", "Service", None)],
                                   "client_id string, ns string, kind string, hard long")
    found = pods.selectExpr("client_id", "ns", "'Pod' AS kind", "rid")
    assert rows(P.quota_usage(quotas, found), "ns", "kind", "used", "state") == [
        ("m", "Pod", 0, "ok"), ("n", "Job", 0, "full"), ("n", "Pod", 4, "full"), ("n", "Service", 0, "unlimited")]


def test_node_failure_reaches_ingresses(spark, make):
    edges = make.edges([("p1", "n1", "RUNS_ON"), ("p2", "n2", "RUNS_ON"), ("p3", "n1", "RUNS_ON"), ("s1", "p1", "SELECTS"), ("s1", "p2", "SELECTS"), ("s2", "p3", "SELECTS")])
    ingresses = spark.createDataFrame([("a", None, "i1", ["x", "x", None]), ("a", "n", "i2", None)], "client_id string, ns string, rid string, backends array<string>")
    assert rows(P.ingress_routes(ingresses), "src", "dst") == [("i1", "service::x")]
    edges = edges.unionByName(make.edges([("i1", "s1", "ROUTES_TO"), ("i1", "s2", "ROUTES_TO")]))
    assert rows(P.node_failure_reach(edges), "node", "kind", "rid", "share") == [
        ("n1", "Ingress", "i1", 0.5), ("n1", "Pod", "p1", 1.0), ("n1", "Pod", "p3", 1.0), ("n1", "Service", "s1", 0.5), ("n1", "Service", "s2", 1.0),
        ("n2", "Ingress", "i1", 0.0), ("n2", "Pod", "p2", 1.0), ("n2", "Service", "s1", 0.5)]
