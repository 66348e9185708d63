"""Stored sketches against exact ranks and distinct counts."""

import numpy as np
from pyspark.sql import functions as F

from causalspark.operators import sketches as S

HOUR = 3_600_000_000
SCHEMA = "operation string, t long, value double, item string"


def _values(spark, n, seed, start=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([("op-hot" if i % 3 else "op-b", start + int(rng.integers(0, 20)) * HOUR, float(rng.lognormal(3, 1)), f"i{rng.integers(0, n // 4)}")
                                  for i in range(n)], SCHEMA)


def test_merged_sketches_keep_their_bounds(spark):
    old, new = _values(spark, 20_000, 1), _values(spark, 10_000, 2, 10 * HOUR)
    store = S.add(S.build(old, ["operation"]), S.build(new, ["operation"]), ["operation"])
    assert store.count() == store.select("operation", "slice").distinct().count() == 60
    both = old.unionByName(new)
    merged = S.merge(store, ["operation"])
    ps = [0.01, 0.5, 0.9, 0.99]
    estimates = merged.select("operation", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), S.quantile(p).alias("estimate")) for p in ps])).alias("e")).select("operation", "e.*")
    errors = S.rank_errors(both, estimates, ["operation"]).collect()
    assert len(errors) == 8 and max(r.error for r in errors) <= S.RANK_ERROR
    exact = {r.operation: (r.n, r.items) for r in both.groupBy("operation").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items")).collect()}
    for r in S.percentiles(store, ["operation"]).collect():
        n, items = exact[r.operation]
        assert r.n == n and abs(r["items"] - items) <= S.DISTINCT_ERROR * items
        assert r.p50 <= r.p90 <= r.p95 <= r.p99


def test_rank_errors_by_hand(spark):
    values = spark.createDataFrame([("a", 0, float(v), "x") for v in (1, 2, 2, 2, 9)], SCHEMA)
    guess = spark.createDataFrame([("a", 0.5, 2.0), ("a", 0.9, 2.0), ("a", 0.1, 9.0)], "operation string, p double, estimate double")
    got = {r.p: round(r.error, 9) for r in S.rank_errors(values, guess, ["operation"]).collect()}
    assert got == {0.5: 0.0, 0.9: 0.1, 0.1: 0.7}


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 0, None, None), ("a", None, None, "x"), ("b", 0, 5.0, None)], SCHEMA)
    got = {r.operation: (r.n, r.p50, r["items"]) for r in S.percentiles(S.build(df, ["operation"]), ["operation"]).collect()}
    assert got == {"a": (2, None, 1), "b": (1, 5.0, 0)}
    assert S.percentiles(S.build(df.limit(0), ["operation"]), ["operation"]).count() == 0
