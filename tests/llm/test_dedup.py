"""Exact and SimHash deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from causalspark.llm import exact_dedup, simhash_dedup
from causalspark.llm.components import components

SCHEMA = "doc_id long, text string, fp string, key string, row string, h long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(d, t, "f", "k", f"r{d}", 1) for d, t in rows], SCHEMA)


ROWS = [(1, "a b c d"), (2, "a b c d"), (3, None), (4, ""), (5, "A b c d"), (6, "a b c d "), (None, "lonely text"), (7, "x" * 200_000),
        (8, "x" * 200_000), (8, "x" * 200_000), (9, "é ü"), (9, "other text"), (None, "a b c d")]


def test_exact_dedup(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(docs(spark, ROWS)).collect()), key=str)
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[t or ""].append(d)
    want, stays = [], set()
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d in ids:
            kept = d == keep and text not in stays
            stays |= {text} if kept else set()
            want.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


def test_drop_copies_keeps_rows_whole(spark):
    out = exact_dedup.drop_copies(docs(spark, ROWS))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, "a b c d"), (4, ""), (5, "A b c d"), (6, "a b c d "), (None, "lonely text"), (8, "x" * 200_000), (9, "é ü"), (9, "other text")], key=str)


@pytest.mark.parametrize("budget", [200, 2000, 10**8])
def test_grace_spills_recursively(budget):
    rng = random.Random(1)
    texts = [bytes([rng.randrange(97, 100)]) * rng.randrange(1, 40) for _ in range(800)]
    rows = [(xxhash.xxh64_intdigest(t) - (1 << 63), t, rng.choice([None, *range(50)]), rng.randrange(1, 4)) for t in texts]
    rows += [(7, b"same hash 1", 1, 1), (7, b"same hash 2", 2, 1), (7, b"same hash 1", 3, 1)] * 30
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i:i + 50], strict=True), exact_dedup._PARTIAL, strict=True)],
                                          schema=exact_dedup._PARTIAL) for i in range(0, len(rows), 50)]
    got = {}
    for table in exact_dedup.grace_groups(iter(batches), budget):
        for c, k, n in zip(table.contents, table.keep, table.copies, strict=True):
            assert c not in got
            got[c] = (k, n)
    want = {}
    for _, t, d, n in rows:
        k, m = want.get(t, (None, 0))
        want[t] = (max((x for x in (k, d) if x is not None), default=None), m + n)
    assert got == want


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: list of (doc_id, unsigned fp). Smallest doc_id reachable per row."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                label[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(fps):
        best[root(i)] = min((x for x in (best.get(root(i)), d) if x is not None), default=None)
    return [best[root(i)] for i in range(len(fps))]


def test_fingerprint():
    for text in ["", "  \n", "One", "one two", "A b C", "é É ü\x1c b\x85 c d", "the cat\tsat on\r\nthe mat " * 50]:
        assert simhash_dedup.fingerprint(text.encode()) % 2**64 == slow_fingerprint(text)


@pytest.mark.parametrize("limit", [1024, 8])
def test_near_groups(spark, limit):
    """A hot ball of fingerprints, chains, and random ones, with and without the route for large groups."""
    rng = random.Random(limit)
    fps, centre = [], rng.getrandbits(64)
    for _ in range(120):
        fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))))
    for _ in range(40):  # pairs at exactly three bits in one segment, or across both
        x = rng.getrandbits(64)
        fps += [x, x ^ (7 << rng.randrange(0, 62)), x ^ 0b11 ^ (1 << 60)]
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.append(chain)
    own = rng.getrandbits(32)  # one segment equal in all, so all wildcards of it collide
    fps += [own << 32 | rng.getrandbits(10) for _ in range(60)]
    rows = [(i * 7 % 1009, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    got = {r.fp % 2**64: r.component_id for r in simhash_dedup.near_groups(df, limit).collect()}
    assert {f: c for (_, f), c in zip(rows, brute_components(rows), strict=True)} == got


def test_simhash_dedup(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and"]
    base = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(400))
    rows = [*ROWS, *((100 + i, base + f" tail{i}") for i in range(6)), (200, base.upper()), (201, "\n\t "), (202, "two words")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.simhash_dedup(docs(spark, rows)).collect()), key=str)
    fps = [(d, slow_fingerprint(t or "")) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps), strict=True)), key=str)
    assert got == want
    kept = simhash_dedup.drop_near_copies(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c in {(c) for _, c in zip(rows, brute_components(fps), strict=True)})
    assert simhash_dedup.simhash_dedup(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(1001, 1100)] + [tuple(rng.sample(range(2000, 2200), 2)) for _ in range(150)]
    perm = list(range(3000))
    rng.shuffle(perm)
    links = [(perm[a], perm[b]) for a, b in links]
    label = np.arange(3000)
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: int(label[n]) for pair in links for n in pair}
