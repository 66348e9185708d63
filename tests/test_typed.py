"""Typed state topics, endpoint properties, stored patterns and dependency rows on small fixtures."""

import json

from causalspark import schemas
from causalspark.operators import faults as X, reports as A, state as S
from causalspark.sources import typed
from tests.conftest import rows

TOPIC = "key string, value string, topic string, timestamp long, offset long"
AT = "2024-01-01T00:00:00.000001234Z"
AT_US = 1704067200000001


def _records(spark, *pairs):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v), "t", 5, i) for i, (k, v) in enumerate(pairs)], TOPIC)


def test_resources_take_tenant_id_and_time_from_where_they_are(spark):
    got = typed.resource_changes(_records(
        spark, ("a::Pod:n:x", {"op": "UPSERT", "at": AT, "kind": "Pod", "uid": "U1", "namespace": "n", "name": "x"}),
        ("k", {"client_id": "b", "kind": "Node", "name": "n1", "at": "soon"}), ("b|NODE:Big", None), ("c::odd", ""), (None, {"op": "dElEtE"}),
        ("a::y", {"client_id": "", "kind": "Pod", "namespace": "n", "name": "y", "labels": {"k": None}})), default="none")
    assert [tuple(r) for r in got.orderBy("offset").select("client_id", "op", "at", "rid", "kind", "ns").collect()] == [
        ("a", "UPSERT", AT_US, "pod:U1", "Pod", "n"), ("b", "UPSERT", 5, "node::n1", "Node", ""), ("b", "DELETE", 5, "node:Big", None, ""),
        ("c", "DELETE", 5, "odd", None, ""), ("none", "DELETE", 5, "", None, ""), ("a", "UPSERT", 5, "pod:n:y", "Pod", "n")]


def test_what_cannot_be_read_is_kept_apart(spark):
    records = _records(spark, ("a::1", "{no"), ("a::2", "[1]"), ("a::3", '{"labels": 5}'), ("a::4", None), ("a::5", '{"kind": "Pod", "name": "p", "x": [1]}'))
    assert rows(typed.malformed(records, schemas.RESOURCE_CHANGE), "key") == [("a::1",), ("a::2",), ("a::3",)]
    assert rows(typed.resource_changes(records), "rid", "op") == [("4", "DELETE"), ("pod::p", "UPSERT")]
    assert rows(typed.resource_changes(records, client_id="b")) == []


def test_edges_targets_and_rules(spark):
    edges = typed.edge_changes(_records(spark, ("a::e1", {"id": "", "from": "Pod:N:x", "to": "node::n", "type": "runs on"}), ("a::k", {"id": "e2", "op": "Delete"}), ("a::e3", None),
                                        ("a::e4", {"from": "a", "to": "b"})))
    assert [tuple(r) for r in edges.orderBy("offset").select("id", "op", "src", "dst", "type").collect()] == [
        ("e1", "UPSERT", "pod:n:x", "node::n", "RUNS_ON"), ("e2", "DELETE", None, None, None), ("e3", "DELETE", None, None, None), ("e4", "UPSERT", "a", "b", "R_REL")]
    targets = typed.target_changes(_records(spark, ("a::", {"cluster": "c", "labels": {"job": "j", "namespace": "n"}, "health": "up"}), ("a::t", {"labels": {"service": "s", "job": "j"}}), ("a::t", None)))
    assert [tuple(r) for r in targets.orderBy("offset").select("target_id", "op", "service", "health").collect()] == [
        ("c|j|n||", "UPSERT", "j", "UP"), ("t", "UPSERT", "s", None), ("t", "DELETE", None, None)]
    rules = typed.rule_changes(_records(spark, ("a::", {"group": "g", "rule": "r", "type": "Alerting"}), ("a::k", {"rule": "r2"}), ("a::k", None), ("a::k", {"op": "DELETE"})))
    assert [tuple(r) for r in rules.orderBy("offset").select("rule_key", "rule", "type").collect()] == [("g|r", "r", "alerting"), ("k", "r2", None)]
    assert typed.rule_changes(_records(spark, ("k", None)).limit(0)).count() == 0


def test_endpoint_properties_fill_only_what_is_null(spark, make):
    known = spark.createDataFrame([("a", "pod:n:x", None, "kept"), ("a", "pod:n:alone", None, None)], "client_id string, rid string, kind string, name string")
    edges = make.edges([("pod:n:x", "node:u1", "RUNS_ON"), ("pod:n:x", "odd", "RUNS_ON"), (None, "pod:n:x", "RUNS_ON")])
    assert sorted(map(str, rows(S.with_endpoint_properties(known, edges), "rid", "stub", "kind", "ns", "name", "uid"))) == sorted(map(str, [
        ("pod:n:x", False, "Pod", "n", "kept", None), ("pod:n:alone", False, None, None, None, None), ("node:u1", True, "Node", None, None, "u1"), ("odd", True, None, None, None, None)]))


def test_stored_patterns_are_read_by_root_type_and_frequency(spark):
    edge = "array<struct<source_sig:string,target_sig:string>>"
    store = spark.createDataFrame([("p1", "oom", 2, ["a", "b", "c"], [("a", "b"), ("a", "c"), ("b", "c")]), ("p2", "oom", 5, ["a"], []), ("p3", "oom", 2, [], None), ("p4", "disk", 1, ["z"], [])],
                                  f"pattern_id string, root_type string, frequency long, sequence array<string>, edges {edge}")
    assert rows(X.read_patterns(store), "root_type", "rank", "pattern_id") == [("disk", 1, "p4"), ("oom", 1, "p2"), ("oom", 2, "p1"), ("oom", 3, "p3")]
    assert rows(X.read_patterns(store, ["oom"], 2), "pattern_id") == [("p1",), ("p2",)]
    assert rows(X.pattern_events(store), "pattern_id", "position", "event", "causes", "effects") == [
        ("p1", 0, "a", 0, 2), ("p1", 1, "b", 1, 1), ("p1", 2, "c", 2, 0), ("p2", 0, "a", 0, 0), ("p4", 0, "z", 0, 0)]


def test_dependencies_of_a_page(spark, make):
    page = spark.createDataFrame([("a", "x"), ("a", "lonely")], "client_id string, rid string")
    edges = make.edges([("x", "n2", "RUNS_ON"), ("x", "n1", "RUNS_ON"), ("x", "n1", "RUNS_ON"), ("x", "n1", "USES"), ("y", "n1", "RUNS_ON")])
    assert rows(A.catalogue_dependencies(page, edges), "rid", "position", "dependency", "type") == [
        ("x", 1, "n1", "RUNS_ON"), ("x", 2, "n1", "USES"), ("x", 3, "n2", "RUNS_ON")]


def test_endpoint_properties_read_the_edges_once(spark, make):
    known = make.frame([("a", "pod:ns:p", None), ("a", "pod:ns:only", None)], "client_id string, rid string, kind string")
    edges = make.frame([("a", "service:ns:s", "pod:ns:p"), ("a", "pod:ns:half", None), ("a", "pod:ns:p", "node:n1")], "client_id string, src string, dst string")
    out = S.with_endpoint_properties(known, edges.hint("rebalance"))
    assert rows(out, "rid", "stub", "name") == [("node:n1", True, None), ("pod:ns:only", False, None), ("pod:ns:p", False, "p"), ("service:ns:s", True, "s")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RebalancePartitions") == 1
