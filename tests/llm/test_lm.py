"""The neural language model against brute force, finite differences and held-out text."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from causalspark.llm import neural_lm as nl

SCHEMA = "doc_id long, text string, token string, row long, tail string, c int"
DATA = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "x", 2) for r in rows], SCHEMA).repartition(3)


def sample(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{'abcde'[i % 5]}w{int(rng.paretovariate(0.7))}" for i in range(300)] + ["ü", "É", "The", "z" * 100]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choice(vocabulary) for _ in range(int(rng.paretovariate(0.6)) % 120))) for i in range(n)]
    return rows + [(7, rows[7][1])] * 3 + [(None, "aw1 only here"), (None, None), (900, None), (901, ""), (902, " x \x1c y"), (903, "q" * 200_000), (904, "aw1 " * 50_000)]


def trains(d):
    return d is not None and zlib.crc32(str(d).encode()) % 10 != 0


def words(text):
    return [*(text or "").encode().lower().split(), b" "]


def base(rows):
    seen = Counter(w for d, t in rows if trains(d) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    return [(d, d is not None and not trains(d), len(words(t)), sum(seen[w] > 0 for w in words(t)), n,
             sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for d, t in rows]


def key(r):
    return tuple(str(x) for x in r[:5]), r[5]


def near(got, want):
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("head", [1 << 17, 20])
def test_scores(spark, monkeypatch, head):
    """Base and model scores equal a plain loop over tokens with a softmax each, with or without the join."""
    monkeypatch.setattr(nl, "HEAD", head)
    made = {}

    def untrained(encoded, vocabulary):
        flat = nl.start(vocabulary.totals)
        flat[:nl._N] += np.random.default_rng(3).normal(0, 0.5, nl._N).astype(np.float32)
        made.update(vocabulary=vocabulary, p={k: x.astype(np.float64) for k, x in nl.views(flat[:nl._N]).items()})
        return flat
    monkeypatch.setattr(nl, "train", untrained)
    rows = sample(1)
    got = [tuple(r) for r in nl.lm_scores(frame(spark, rows)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    near([r[:6] for r in got], base(rows))
    voc, p = made["vocabulary"], made["p"]
    assert len(voc.words) <= head and (head > 20 or len(voc.words) > 5)
    seen = Counter(w for d, t in rows if trains(d) for w in words(t))
    number = {w: i for i, w in enumerate(voc.words[:nl.WORDS])}
    for d, t in rows:
        if t and len(t) > 1000:
            continue
        ids, total = [nl.BEFORE] * nl.CONTEXT, 0.0
        for w in words(t):
            q = sum(p["scale"][i] * p["context"][ids[-1 - i]] for i in range(nl.CONTEXT))
            logits = p["out"] @ q + p["bias"]
            k = voc.class_of(w)
            total += (logits[k] - np.log(np.exp(logits).sum())) / math.log(10)
            total += math.log10((seen[w] + 0.1) / (voc.totals[k] + 0.1 * (voc.sizes[k] + 1)))
            ids.append(number.get(w, nl.WORDS + k))
        assert any(r[0] == d and r[2] == len(words(t)) and r[6] == pytest.approx(total, rel=1e-4, abs=1e-3) for r in got), d
    assert voc.totals.sum() == sum(seen.values()) and voc.sizes.sum() == len(seen)
    # all known tokens and one unknown token of each class: the probabilities add up to one
    share = sum((c + 0.1) / (voc.totals[k := voc.class_of(w)] + 0.1 * (voc.sizes[k] + 1)) * (k == 70) for w, c in seen.items())
    assert share + 0.1 / (voc.totals[70] + 0.1 * (voc.sizes[70] + 1)) == pytest.approx(1)


def test_empty_tables_and_no_training_rows(spark):
    assert nl.lm_scores(frame(spark, [])).count() == 0
    rows = [(None, "a b"), (None, None)]
    got = [tuple(r) for r in nl.lm_scores(frame(spark, rows)).collect()]
    near([r[:6] for r in got], base(rows))
    assert all(r[6] <= 0 for r in got)


def test_training_beats_counts(spark):
    """Over documents that did not train, the model is better than the counts alone."""
    got = nl.lm_scores(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").selectExpr("sum(base_score) b", "sum(score) s", "sum(n_tokens) n").first()
    assert got.s / got.n > got.b / got.n + 0.1


def test_slopes_are_those_of_the_loss():
    """A step goes against the finite differences of the contrastive loss."""
    rng = np.random.default_rng(5)
    flat = nl.start(np.arange(nl.CLASSES) + 1.0)
    flat[:nl._N] += rng.normal(0, 0.3, nl._N).astype(np.float32)
    classes = np.r_[np.arange(nl.WORDS) % nl.CLASSES, np.arange(nl.CLASSES), -1]
    ids = np.r_[np.full(nl.CONTEXT, nl.BEFORE), rng.integers(0, nl.BEFORE, 30), np.full(nl.CONTEXT, nl.BEFORE), rng.integers(0, nl.BEFORE, 10)]
    share = np.full(nl.CLASSES, 1 / nl.CLASSES)
    noise = np.random.default_rng(9).choice(nl.CLASSES, nl.NOISE, p=share)
    target = classes[ids[nl.CONTEXT:]]

    def loss(x):
        p = nl.views(x)
        total = 0.0
        for t in np.flatnonzero(target >= 0):
            q = sum(p["scale"][i] * p["context"][ids[t + nl.CONTEXT - 1 - i]] for i in range(nl.CONTEXT))
            s = p["out"] @ q + p["bias"] - np.log(nl.NOISE / nl.CLASSES)
            total += np.log1p(np.exp(-s[target[t]])) + np.log1p(np.exp(s[noise])).sum()
        return total / (target >= 0).sum()
    before = flat.copy()
    nl.step(flat, ids, classes, share, np.random.default_rng(9))
    moved = before[:nl._N] - flat[:nl._N]
    slope = moved / nl.RATE * np.sqrt(flat[nl._N:])
    x = before[:nl._N].astype(np.float64)
    places = [*rng.choice(np.flatnonzero(slope), 25), *range(nl._N - nl.CLASSES, nl._N - nl.CLASSES + 5), *range((nl.BEFORE + 1) * nl.DIM, (nl.BEFORE + 1) * nl.DIM + 5)]
    for i in places:
        up, down = x.copy(), x.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert slope[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-3, abs=2e-6)
