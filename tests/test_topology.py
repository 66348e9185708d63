"""Dependencies between services."""

import os
import random
from collections import Counter
from itertools import permutations

import pytest

import __spark_entry__ as entry
from causalspark.operators import topology as T
from tests.conftest import rows
from tests.oracle import compare, connect

SF = os.environ.get("CAUSALSPARK_SF", "/root/testdata/sf0.001")


def slow_counts(edges):
    vertices, out = sorted({v for e in edges for v in e}), Counter()
    for k in range(2, 6):
        for path in permutations(vertices, k):
            if path[0] == min(path) and all((a, b) in edges for a, b in zip(path, (*path[1:], path[0]), strict=True)):
                out.update((v, k) for v in path)
    return out


def test_cycle_counts_are_those_of_the_listing(make):
    rng, given, want = random.Random(7), [], []
    for client, share in (("a", 0.2), ("b", 0.45), ("c", 0.8), ("d", 1.0)):
        names = [f"s{i}" for i in range(8)]
        edges = {(x, y) for x in names for y in names if x != y and rng.random() < share}
        given += [(client, x, y) for x, y in edges] + [(client, "s0", "s0"), (client, "leaf", "s1")]
        want += [(client, v, k, n) for (v, k), n in slow_counts(edges).items()]
    found = T.dependency_cycle_counts(make.frame(given, "client_id string, src string, dst string"))
    assert rows(found, "client_id", "service", "length", "cycles") == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample data")
def test_flow_queries_read_every_flow(spark):
    duck = connect(SF)
    for name in ("t16_flow_blast_radius", "t20_flow_cycle_counts"):
        result = compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], SF)
        assert result["ok"], (name, result["problem"])
    n = duck.execute("""SELECT count(DISTINCT (o_custkey % 3, l_suppkey, l_partkey % 100)) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_suppkey <> l_partkey % 100""").fetchone()[0]
    assert entry.queries()["t16_flow_blast_radius"](spark, SF).where("depth = 1").count() == n


@pytest.mark.parametrize("seed", [1, 2])
def test_cycle_counts_are_those_of_the_list(make, seed):
    rnd = random.Random(seed)
    flows = make.frame([(c, f"s{i}", f"s{j}") for c in "ab" for i in range(7) for j in range(7) if rnd.random() < 0.35], "client_id string, src string, dst string")
    listed = Counter((r.client_id, s, len(r.path)) for r in T.dependency_cycles(flows).collect() for s in r.path)
    counted = {(r.client_id, r.service, r.length): r.cycles for r in T.dependency_cycle_counts(flows).collect() if r.cycles}
    assert counted and counted == dict(listed)


def test_next_vertices_of_roots_are_found_once_in_their_block(spark, monkeypatch):
    """Twenty ways from each root to each last vertex give one row, and the ways themselves are not aggregated by Spark."""
    edges = spark.sql("""SELECT 'a' client_id, concat('r', r.id) src, concat('m', m.id) dst, 'X' type FROM range(9) r, range(20) m
        UNION ALL SELECT 'a', concat('m', m.id), concat('e', e.id), 'X' FROM range(20) m, range(5) e""")
    roots = spark.sql("SELECT 'a' client_id, concat('r', id) root FROM range(9)")
    for size, steps in ((256, 2_000_000), (2, 3)):
        monkeypatch.setattr(T, "BLOCK_ROOTS", size)
        monkeypatch.setattr(T, "STEPS", steps)
        got = T.neighbourhood(roots, edges, 2, directed=True)
        assert sorted((r.root, r.node, r.depth) for r in got.collect()) == sorted(
            (f"r{r}", *x) for r in range(9) for x in [(f"r{r}", 0)] + [(f"m{m}", 1) for m in range(20)] + [(f"e{e}", 2) for e in range(5)])
    assert "CoGroup" in got._jdf.queryExecution().executedPlan().toString()
