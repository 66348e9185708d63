"""Change logs."""

from causalspark.operators import state as S
from tests.conftest import rows


def test_latest_wins_and_deletes_cascade(make):
    log = make.frame([("a", "x", 1, 1, "UPSERT", "v1"), ("a", "x", 5, 2, "UPSERT", "v2"), ("a", "x", 3, 3, "UPSERT", "old"),
                      ("a", "y", 1, 4, "UPSERT", "v"), ("a", "y", 9, 5, None, None), ("a", "y", 4, 6, "UPSERT", "late"),
                      ("b", "x", 1, 7, "UPSERT", "other")],
                     "client_id string, rid string, at long, offset long, op string, v string")
    live = S.current_resources(log)
    assert rows(live, "client_id", "rid", "v") == [("a", "x", "v2"), ("b", "x", "other")]
    edges = make.frame([("a", "e1", "x", "x", 1, 1, "UPSERT"), ("a", "e2", "x", "y", 1, 1, "UPSERT")],
                       "client_id string, id string, src string, dst string, at long, offset long, op string")
    assert rows(S.current_edges(edges, live), "id") == [("e1",)]


def test_merge_keeps_old_values_for_nulls(make):
    old = make.frame([("k", "a", "b")], "k string, x string, y string")
    new = make.frame([("k", None, "c"), ("n", "d", None)], "k string, x string, y string")
    assert [tuple(r) for r in S.merge_properties(old, new, ["k"]).orderBy("k").collect()] == [("k", "a", "c"), ("n", "d", None)]
