"""Registered queries against DuckDB on the smallest sample. Set CAUSALSPARK_FULL=1 for all."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("CAUSALSPARK_SF", "/root/testdata/sf0.001")
SOME = ["l1_link_causes", "l3_build_causality", "l4_top_causes_dense", "l13_errors_before_fatal", "g3_best_chains",
        "g7_cross_service_failures", "w1_escalate_severity", "w3_sessionize_incidents", "w9_memory_leaks",
        "w12_group_alerts", "c3_detach_edges", "t18_path_counts", "t20_flow_cycle_counts", "p6_normalize_events",
        "p16_high_signal_logs", "s4_explode_alerts", "a1_graph_stats", "a34_confidence_percentiles",
        "h1_resource_health", "v1_accuracy_at_k", "n1_recommendations", "e3_keyword_vectors", "e5_near_duplicates",
        "f2_pair_scores", "st4_causal_links", "st5_alert_groups", "st7_incident_sessions"]
FULL = os.environ.get("CAUSALSPARK_FULL") == "1"
NAMES = sorted(entry.queries()) if FULL else SOME


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no sample data")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    result = compare(spark, duck, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert result["ok"] is not False, result["problem"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
