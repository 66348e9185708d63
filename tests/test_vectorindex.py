"""The stored index against all pairs, with batches, retries, filters and hot lists."""

import numpy as np
import pytest

from causalspark.operators import vectorindex as V

SCHEMA = "id long, vec array<double>, label long"


def _clustered(n, seed, dim=16, noise=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 40), dim))
    return centres[rng.integers(0, len(centres), n)] + noise * rng.standard_normal((n, dim))


def _frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), i % 3) for i, v in enumerate(x)], SCHEMA)


def _exact(q, q_ids, x, ids, k, min_sim):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n)
    sims = np.round(unit(q) @ unit(x).T, 12)
    out = set()
    for i, name in enumerate(q_ids):
        rows = sorted((-sims[i, j], ids[j]) for j in range(len(ids)) if sims[i, j] >= min_sim and ids[j] != name)
        out |= {(name, item, rank + 1) for rank, (_, item) in enumerate(rows[:k])}
    return out


def _got(matches):
    return {(r.query_id, r.item_id, r["rank"]) for r in matches.collect()}


def test_clustered_vectors_read_few_cells(spark, tmp_path):
    x = _clustered(2000, 1)
    path = str(tmp_path / "index")
    df = _frame(spark, x)
    V.train(path, df)
    V.append(path, df, 0)
    q = df.where("id % 20 = 0")
    ids = list(range(0, 2000, 20))
    matches, reads = V.search(path, q, k=5, min_sim=0.5)
    assert _got(matches) == _exact(x[::20], ids, x, range(2000), 5, 0.5)
    read = reads.toPandas()
    share = read["rows_read"].sum() / read["rows"].sum()
    print(f"clustered: {share:.3f} of the rows read, {(read['near_cells'] + read['far_cells']).mean():.1f} of {read['cells'][0]} cells a query")
    assert len(read) == 100 and share < 0.25


def test_unclustered_vectors_fall_back_to_all(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((400, 24))
    path = str(tmp_path / "index")
    df = _frame(spark, x)
    V.train(path, df)
    V.append(path, df, 0)
    matches, reads = V.search(path, df.where("id < 50"), k=7, min_sim=-1.0, probes=1, block_rows=16)
    assert _got(matches) == _exact(x[:50], range(50), x, range(400), 7, -1.0)


def test_append_takes_only_new_rows_and_a_retry_changes_nothing(spark, tmp_path):
    x = _clustered(300, 3)
    path = str(tmp_path / "index")
    df = _frame(spark, x)
    V.train(path, df.where("id < 200"))
    V.append(path, df.where("id < 200"), 0)
    before = sorted(map(tuple, V.read(spark, path).select("id", "batch").collect()))
    assert before == [(i, 0) for i in range(200)]
    for _ in range(2):
        V.append(path, df, 1)
        rows = sorted(map(tuple, V.read(spark, path).select("id", "batch").collect()))
        assert rows == [(i, int(i >= 200)) for i in range(300)]
    matches, _ = V.search(path, df, k=3, min_sim=0.3)
    assert _got(matches) == _exact(x, range(300), x, range(300), 3, 0.3)


def test_filter_on_stored_columns(spark, tmp_path):
    x = _clustered(300, 4)
    path = str(tmp_path / "index")
    df = _frame(spark, x)
    V.train(path, df)
    V.append(path, df, 0)
    from pyspark.sql import functions as F
    matches, _ = V.search(path, df.where("label = 1"), k=4, min_sim=0.1, keep=F.col("label") == 2)
    assert _got(matches) == _exact(x[1::3], range(1, 300, 3), x[2::3], range(2, 300, 3), 4, 0.1)


def test_hot_list_of_equal_vectors_is_cut_into_blocks(spark, tmp_path):
    x = np.vstack([np.tile([1.0, 2.0, 0.0], (200, 1)), _clustered(100, 5, dim=3)])
    path = str(tmp_path / "index")
    df = _frame(spark, x)
    V.train(path, df, lists=8)
    V.append(path, df, 0)
    matches, _ = V.search(path, df, k=4, min_sim=0.2, block_rows=32)
    assert _got(matches) == _exact(x, range(300), x, range(300), 4, 0.2)


def test_nulls_zeros_repeats_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, None, 0), (None, [1.0, 1.0], 0), (3, [0.0, 0.0], None), (4, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    V.train(path, df)
    V.append(path, df, 0)
    assert sorted(r.id for r in V.read(spark, path).collect()) == [1, 3, 4]
    q = spark.createDataFrame([(9, [1.0, 1.0]), (3, [0.0, 0.0]), (8, None), (None, [1.0, 0.0])], "id long, vec array<double>")
    matches, reads = V.search(path, q, k=5, min_sim=0.0)
    got = {(r.query_id, r.item_id): round(r.similarity, 6) for r in matches.collect()}
    assert got == {(9, 4): 1.0, (9, 1): 0.707107, (9, 3): 0.0, (3, 1): 0.0, (3, 4): 0.0}
    assert sorted(r.query_id for r in reads.collect()) == [3, 9]
    matches, reads = V.search(path, q.limit(0), k=5)
    assert matches.count() == 0 and reads.count() == 0


def test_index_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame([], SCHEMA)
    V.train(path, df)
    V.append(path, df, 0)
    matches, reads = V.search(path, spark.createDataFrame([(9, [1.0, 1.0])], "id long, vec array<double>"), k=5)
    assert matches.count() == 0 and reads.collect()[0]["rows"] == 0
    x = _clustered(20, 6)
    full = _frame(spark, x)
    V.append(path, full, 1)
    matches, _ = V.search(path, full, k=3, min_sim=0.1)
    assert _got(matches) == _exact(x, range(20), x, range(20), 3, 0.1)
    with pytest.raises(AssertionError):
        V.append(path, full.withColumnRenamed("label", "ring"), 2)
