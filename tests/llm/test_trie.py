"""The conversation trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causalspark.llm import prefix_trie as pt
from causalspark.llm.running import running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, position string, alone int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path) == d))
    save = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in members.items()}
    out = []
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(x[:len(q)] == q and len(x) > len(q) for x in under)]
        ends = ",".join(map(str, sorted(c for c, end in m if end)))
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(kids), len(leaves), sum(save[q] for q in under), hashlib.sha256(ends.encode()).hexdigest(),
                    *((x.decode() for x in p[-1]) if p else (None, None))))
    return sorted(out, key=str)


def trie(spark, rows):
    convs = spark.createDataFrame([(*r, "d", "k", "p", 1) for r in rows], SCHEMA)
    nodes = pt.conversation_trie(convs)
    got = pt.node_texts(convs, nodes).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "role", "text")
    return sorted(map(tuple, got.collect()), key=str)


def sample(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), -1, -4, -7, 1000, 1003, 1006]:
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü", "", None, f"own {c}"])))
    rows += [(3, None, "user", "first"), (3, None, None, None), (3, 2, "user", "tie"), (3, 2, "assistant", "tie")] + [(6, 5, "user", "again")] * 4
    rows += [(None, 1, "user", "of none"), (None, None, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in (500, 505, 511) for t in range(60)] + [(77, 0, "user", "x" * 200_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = sample(seed)
    assert trie(spark, rows) == brute(rows)


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_trie_when_the_sketch_proves_less(spark, monkeypatch, share):
    """A full sketch proves nothing and a half-full one proves little; the result stays."""
    rows = sample(3, 15)
    plain = pt.shared_cells
    noise = np.random.default_rng(1).random((pt.LANES, 1 << 13)) < share
    monkeypatch.setattr(pt, "shared_cells", lambda r: plain(r) | np.where(noise, 255, 0).astype(np.uint8))
    assert trie(spark, rows) == brute(rows)


def test_trie_of_empty_tables(spark):
    assert trie(spark, []) == trie(spark, [(None, 1, "user", "x")]) == []


def test_tails_are_not_grouped(spark):
    """Prefixes of conversations that share nothing leave the exact grouping after one node each."""
    rows = [(5 * c, t, "user", f"{c} {t}") for c in range(30) for t in range(20)]
    turns = pt.turn_prefixes(spark.createDataFrame([(*r, "d", "k", "p", 1) for r in rows], SCHEMA))
    got = pt.screened(pt.rebuilt(turns, F.lit(0), F.col("conv_id"))).groupBy("tail").count().collect()
    assert {r["tail"]: r["count"] for r in got} == {False: 60, True: 30 * 19}


def test_sketch_counts_over_tasks(monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 64)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 60, 150)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 20] % 3), pa.array(keys[i:i + 20]), pa.array(keys[i:i + 20] * 7)], names=["depth", "k1", "k2"]) for i in range(0, 150, 20)]
    pieces = [r for b in (batches[:3], batches[3:4], batches[4:]) for x in pt._sketch(iter(b), 128) for r in x.to_pylist()]
    pieces.sort(key=lambda r: r["piece"])
    merged = list(pt._merge_pieces([pa.RecordBatch.from_pylist(pieces)]))
    out = np.zeros((pt.LANES * 2, 8), np.uint8)
    for x in merged:
        out[x.column(0)[0].as_py()] = np.frombuffer(x.column(1)[0].as_py(), np.uint8)
    values, counts = np.unique(keys, return_counts=True)
    alone = pt._alone(out.reshape(pt.LANES, -1), values, values * 7, values % 3)
    assert not (alone & (counts > 1)).any() and alone[counts == 1].mean() > 0.8


def test_running_sums_over_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), i, rng.randrange(-2**63, 2**63)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, running(df, "k", ["o"], ["v"]).select("k", "o", "position", "v_run").collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = [], {}
    for k, o, v in sorted(rows):
        n, s = seen.get(k, (0, 0))
        seen[k] = n + 1, (s + v + 2**63) % 2**64 - 2**63
        want.append((k, o, *seen[k]))
    assert got == want
