"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from causalspark.llm import lexical_search as ls
from causalspark.llm.words import distinct, word_table

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, id string, key string, item int, bound long", "item_id long, text string, term string, h long"


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    of = [(d, words(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in of), sum(len(w) for _, w in of)
    df = Counter(x for _, w in of for x in set(w))
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in terms.items():
        found = []
        for d, w in of:
            tf = Counter(w)
            m = 10 + 90 * len(w) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in ts if tf[t])
            if s > 0:
                found.append((-s, -math.inf if d is None else d, d))
        out += [(i, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:10])]
    return sorted(out, key=str)


def searched(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, "i", "k", 1, 2) for r in docs], DOCS).repartition(3)
    return sorted(map(tuple, ls.search(d, spark.createDataFrame([(*r, "t", 1) for r in items], ITEMS), **how).collect()), key=str)


def sample(seed, n=300, copies=40):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["é", "Ünd", "STRASSE"]
    text = lambda k: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(int(rng.paretovariate(0.7)) % 300)) for i in range(n)]
    docs += [(1000 + i, docs[5][1]) for i in range(copies)] + [(7, docs[7][1])] * 3
    docs += [(None, text(20)), (None, None), (2000, None), (2001, ""), (2002, "... !"), (2003, "w1 " * 60_000), (2004, "x" * 200_000 + " w2 w3")]
    items = [(i, text(rng.randrange(1, 40))) for i in range(15)] + [(3, text(5)), (None, text(9)), (99, None), (98, "nowhere"), (97, docs[5][1]), (97, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search(spark, seed):
    docs, items = sample(seed)
    assert searched(spark, docs, items) == brute(docs, items)


def test_search_in_lots_over_a_stored_index(spark, monkeypatch):
    monkeypatch.setattr(ls, "LOT_PAIRS", 30)
    docs, items = sample(3, 120)
    d = spark.createDataFrame([(*r, "i", "k", 1, 2) for r in docs], DOCS)
    assert searched(spark, docs, items, index=ls.build_index(d)) == brute(docs, items)
    assert searched(spark, docs, items, top=2) == [r for r in brute(docs, items) if r[1] <= 2]


def test_search_of_empty_tables(spark):
    docs, items = sample(4, 20)
    assert searched(spark, [], items) == searched(spark, docs, []) == searched(spark, [(1, None)], items) == searched(spark, docs, [(1, "")]) == []


def test_bounds_never_miss():
    """Upper bounds are at least the scores, whatever block a document is in, and few documents are kept."""
    docs, items = sample(5, 200)
    waiting = ls._Waiting()
    table = {}
    for d, (_, t) in enumerate(docs):
        _, doc, _, _, h = word_table([(t or "").encode()])
        place, tf = distinct(doc, h)
        if len(place):
            waiting.add(d, 0, len(h), h[place], tf)
            table[d] = Counter(words(t))
    lot = ls.Lot(len(table), sum(sum(c.values()) for c in table.values()))

    class Row:
        def __init__(self, term):
            self.term, self.w = term.encode(), 1 + len(term) * 100
            self.h = int(word_table([self.term])[4].view(np.int64)[0])
    for i, t in items:
        lot.add(i, [Row(x) for x in sorted(set(words(t)))])
    loose = total = 0
    for n_docs, ids, _, sizes, n_rows, bits in waiting.blocks():
        n = np.frombuffer(sizes, np.int64)
        bound = ls.upper_bounds(lot.arrays(), lot, n_rows, np.frombuffer(bits, np.uint8).reshape(n_rows, -1), n)
        for column, d in enumerate(np.frombuffer(ids, np.int64).tolist()):
            exact = np.array(lot.scores((docs[d][1] or "").encode(), list(range(len(lot.items)))))
            assert n[column] == sum(table[d].values()) and n_docs == len(n)
            assert (bound[:, column] >= exact).all()
            loose, total = loose + (bound[:, column] > 1.1 * exact + 1).sum(), total + len(exact)
    assert loose < 0.2 * total


def test_word_hashes_agree_in_any_slice():
    texts = [t.encode() for t in ("A b-c", "", "x" * 5000 + " b", "É a", "b c A")]
    buffer, doc, start, end, h = word_table(texts)
    seen = {}
    for a, b, x in zip(start.tolist(), end.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(buffer[a:b], x) == x == int(word_table([buffer[a:b]])[4][0])
    assert len(set(seen.values())) == len(seen) and doc.tolist() == [0, 0, 0, 2, 2, 3, 3, 4, 4, 4]
