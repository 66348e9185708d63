"""Quality scores, decontamination and SentencePiece against brute force, held-out labels and the model's library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from causalspark.llm import decontaminate, quality
from causalspark.llm.segments import PIECE_BPE, Segments
from causalspark.llm.sentencepiece_fst import Transducer, decode_ids, encode_decode, transducer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, row string, h long, n_words string, features string, score string, first string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(d, t, "r", 1, "w", "f", "s", "x") for d, t in rows], SCHEMA)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(rows, items, window=10):
    wins = {(tuple(w[s:s + min(window, len(w))]), i) for i, t in items if (w := words(t)) for s in range(max(1, len(w) - window + 1))}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for win, i in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "c", "É", "ü9"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(30)), (2, text(12)), (3, "short item"), (4, ""), (5, None), (6, text(9)), (7, text(10)), (10, text(30)), (11, "one"), (1, "again short"), (12, "A, B. c! a b c a b c a b c a b c a b c")]
    inside = [words(t) for _, t in items if len(words(t)) > 11]
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (3, "two"), (None, "short ITEM here"), (4, " ".join(inside[0][3:13])), (5, " ".join(inside[0][3:12])),
            (6, "x " + "; ".join(inside[1]) + " y " + " ".join(inside[0])), (7, "a b c " * 300)]
    rows += [(20 + i, text(rng.randrange(1, 80)) + " " + " ".join(inside[i % len(inside)][i % 5:]) + " " + text(20)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.decontaminate(docs(spark, rows), bench).collect()), key=str)
    assert got == brute_hits(rows, items)
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(d) for d, *_, bad in brute_hits(rows, items) if not bad)
    none = bench.where("false")
    assert decontaminate.decontaminate(docs(spark, rows), none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


def test_winnow_guarantee():
    """Every window of k + w - 1 words holds a chosen gram, and the choice depends on the window alone."""
    rng = np.random.default_rng(1)
    h = decontaminate.gram_hashes(rng.integers(0, 6, 400).astype(np.uint64), 5)
    chosen = decontaminate.winnow(h, 6)
    for s in range(len(h) - 5):
        least = np.flatnonzero(h[s:s + 6] == h[s:s + 6].min()) + s
        assert set(least) <= set(chosen.tolist())


def slow_pieces(text):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE).encode(text)


def test_transducer_is_the_models_encoding():
    rng, fst = random.Random(4), transducer()
    for k in range(1500):
        text = "".join(rng.choice("aabcdehinorst  \n\tééß1290.,!▁日本Ａ\x00") for _ in range(rng.randrange(0, 50)))
        text = rng.choice("a1e= -_") * rng.randrange(0, 70) + text if k % 3 == 0 else text
        ids = fst.encode(text)
        assert ids.tolist() == slow_pieces(text)
        assert fst.decode(ids) == text.replace("▁", " ")


def unigram_model(path, kind=1, **normal):
    """A small score model with byte fallback, written by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    rng, model = random.Random(8), pb.ModelProto()
    add = lambda piece, score, kind: model.pieces.add(piece=piece, score=score, type=kind)
    for piece, of_kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(piece, 0.0, of_kind)
    for b in range(256):
        add(f"<0x{b:02X}>", 0.0, 6)
    known = {"▁", *"abcde", "é", "▁a", "\n"} | {"".join(rng.choice("abcde▁"[:5 + (i % 7 == 0)]) for _ in range(rng.randrange(2, 6))) for i in range(120)}
    for piece in sorted(known):
        add(piece, -round(rng.uniform(1, 12), 3), 1)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = kind, True
    rules = {"name": "identity", "add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True} | normal
    for name, value in rules.items():
        setattr(model.normalizer_spec, name, value)
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("prefix", [True, False])
def test_transducer_of_a_score_model(tmp_path, prefix):
    """The least sum of weights is the library's best path, with bytes for characters that no piece spells."""
    import sentencepiece
    path = unigram_model(tmp_path / "u.model", add_dummy_prefix=prefix)
    library, fst, rng = sentencepiece.SentencePieceProcessor(model_file=path), Transducer(path), random.Random(9)
    for _ in range(800):
        text = "".join(rng.choice("aabbccddee  é\nzß日") for _ in range(rng.randrange(0, 60)))
        assert fst.encode(text).tolist() == library.encode(text), text
        assert fst.decode(fst.encode(text)) == text


def test_models_that_are_not_handled_are_refused(tmp_path):
    for k, how in enumerate(({"kind": 3}, {"remove_extra_whitespaces": True}, {"precompiled_charsmap": b"x"})):
        with pytest.raises(ValueError, match="handled"):
            Transducer(unigram_model(tmp_path / f"{k}.model", **how))


def test_encode_decode(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "x" * 100_000 + " y"), (None, "The thing, é 日本\n\n"), (5, "a▁b"), (5, "a▁b")]
    got = encode_decode(docs(spark, rows)).collect()
    for (d, t), r in zip(rows, sorted(got, key=lambda r: [str(d) for d, _ in rows].index(str(r.doc_id))), strict=True):
        assert r.doc_id == d and list(r.ids) == slow_pieces(t or "") and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
        assert r.exact == ("▁" not in (t or "")) and r.decoded_sha256 == hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()
    back = sorted(((r.doc_id, r.text) for r in decode_ids(encode_decode(docs(spark, rows))).collect()), key=str)
    assert back == sorted(((d, (t or "").replace("▁", " ")) for d, t in rows), key=str)
    assert encode_decode(docs(spark, [])).count() == 0


def test_segments_are_bounded():
    memory = Segments(lambda s: s.upper(), size=10)
    assert [memory[str(i % 37) + "a"] for i in range(500)] == [str(i % 37) + "A" for i in range(500)]
    assert len(memory) <= 10 and len(memory.old) <= 10 and memory["x" * 1000] and "x" * 1000 not in memory


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(d, labels)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == d.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in test]) > 0.98
    assert np.mean([r.predicted == 0 for r in test if r.quality == 0]) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 0, 0), (1, None, 0), (3, 1, 0), (3, 0, 0)]])
def test_quality_without_both_classes(spark, labels):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 100_000)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs(spark, rows), table).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {1}
    kept = quality.drop_rejected(docs(spark, rows), table)
    assert kept.columns == docs(spark, []).columns and kept.count() == 5
    assert quality.quality_scores(docs(spark, []), table).count() == 0


def test_quality_learns_from_every_label(spark):
    """The block size bounds no training rows: all labelled documents outside the held-out part are in the blocks."""
    n = 24_000
    d = docs(spark, [(i, "x y z" if i % 3 else "| | #") for i in range(n)])
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 3 > 0 AS INT) AS quality")
    seen = quality.training_labels(labels).count()
    blocks = []
    made = quality._blocks
    quality._blocks = lambda once, m: blocks.append(made(once, m)) or blocks[0]
    try:
        quality.quality_scores(d, labels)
    finally:
        quality._blocks = made
    width = len(quality.features(b"")) + 1
    sizes = [len(r.rows) // 8 // width for r in blocks[0].collect()]
    assert sum(sizes) == seen > 2 * quality.BLOCK and len(sizes) > 2


def test_quality_edge_rows(spark):
    good = [(i, "The plain words of a clean text number %d go on and on, as they do here." % i) for i in range(40)]
    bad = [(100 + i, "W%d!! " % i * 30) for i in range(40)]
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in good + bad] * 2, "doc_id long, quality int, toxic int")
    rows = good + bad + [(None, "plain"), (500, None), (501, ""), (1, good[1][1])]
    got = quality.quality_scores(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.doc_id < 100) for r in got if r.doc_id is not None and r.doc_id < 500)
    assert {str(r.doc_id) for r in got if not r.held_out} >= {"None"}


def test_quality_trains_once_on_a_repeated_id(spark):
    once = [(i, "word%d clean text goes on, as it does here. " % i * (1 + i % 5)) for i in range(40)] + [(100 + i, "W%d!! the text " % i * (1 + i % 7)) for i in range(40)]
    labels = spark.createDataFrame([(d, int(d < 100), 0) for d, _ in once], "doc_id long, quality int, toxic int")
    trains = {r.doc_id for r in quality.training_labels(labels).collect()}
    copied = next(r for r in once if r[0] in trains)
    scores = lambda rows: {r.doc_id: r.score for r in quality.quality_scores(docs(spark, rows), labels).collect()}
    assert scores(once + [copied] * 60) == scores(once)
