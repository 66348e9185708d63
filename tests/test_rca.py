"""Causes and surroundings of failures."""

import os

import pytest

import __spark_entry__ as entry
from causalspark.operators import paths as P
from tests.conftest import rows
from tests.oracle import compare, connect

SF = os.environ.get("CAUSALSPARK_SF", "/root/testdata/sf0.001")


def test_related_resources_reach_two_hops(make):
    ep = make.episodes([("e1", 0, "OOMKilled", "p1"), ("e2", 5, "OOMKilled", "p1"), ("e3", 9, "Started", "p2", "INFO")])
    edges = make.edges([("pod:ns:p1", "node::n", "RUNS_ON"), ("pod:ns:p2", "node::n", "RUNS_ON"), ("service:ns:s", "pod:ns:p2", "SELECTS"),
                        ("service:ns:t", "pod:ns:p1", "SELECTS"), ("service:ns:t", "node::n", "SELECTS")])
    assert rows(P.rca_related(ep, edges), "rid", "related", "hops") == [
        ("pod:ns:p1", "node::n", 1), ("pod:ns:p1", "pod:ns:p2", 2), ("pod:ns:p1", "service:ns:t", 1)]


def test_causes_are_filtered_by_hops(make):
    ep = make.episodes([("e", 60, "Failed", "p1"), ("own", 10, "Failed", "p1"), ("one", 20, "Failed", "p2"), ("three", 30, "Failed", "p3"),
                        ("off", 40, "Failed", "p4"), ("weak", 50, "Failed", "p2")])
    links = make.frame([("a", c, "e", h, f) for c, h, f in [("own", 0, 0.9), ("one", 1, 0.8), ("three", 3, 0.7), ("off", 0, 0.6), ("weak", 1, 0.4)]],
                       "client_id string, cause string, effect string, hops int, confidence double")
    names = lambda **kw: {r.cause for r in P.rca_causes(ep, links, **kw).collect()}
    assert names() == {"own", "one", "three", "off"}
    assert names(max_hops=2) == {"own", "one"} and names(max_hops=3) == {"own", "one", "three"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample data")
def test_card_queries(spark):
    duck = connect(SF)
    for name in ("g12_rca_cards", "g12_rca_related", "g12_rca_causes"):
        result = compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF)
        assert result["ok"] and result["rows"], (name, result["problem"])
