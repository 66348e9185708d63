"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores.
``prepare`` is the time to write the shared event, resource, edge and link tables, which most queries
read, and is part of the total; every query is then run to the end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from causalspark.plans import registry
from causalspark.plans.engine import Engine
from causalspark.session import get_session

HEADLINE = [
    "l1_link_causes", "l2_score_links_stream", "l3_build_causality", "l13_errors_before_fatal", "l17_adjust_confidence",
    "g2_root_causes_lenient", "g3_best_chains", "g5_event_blast_radius", "g7_cross_service_failures", "g12_rca_cards",
    "w1_escalate_severity", "w3_sessionize_incidents", "w6_error_spike_series", "w9_memory_leaks", "w12_group_alerts",
    "t13_hops", "t14_neighbourhood", "c1_current_resources", "c2_current_edges", "p6_normalize_events",
    "p8_abstract_type", "s4_explode_alerts", "a6_error_prone_resources", "a12_confidence_histogram", "h1_resource_health",
    "v1_accuracy_at_k", "n1_recommendations", "e1_text_search", "e3_keyword_vectors", "e5_near_duplicates",
    "f1_fault_graphs", "k1_pattern_matches", "st7_incident_sessions", "st8_rate_windows",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("causalspark-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    start = time.time()
    tables = Engine(spark, sf_dir)
    rows = {"episodes": tables.episodes.count(), "edges": tables.edges.count(), "links": tables.links.count()}
    prepare = time.time() - start
    queries, times = registry.queries(), {}
    for name in HEADLINE:
        start = time.time()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(prepare + sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"), "prepare": round(prepare, 3),
        "cores": int(cpus), "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
