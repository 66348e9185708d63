"""Quality scores by Bradley-Terry ranking of document pairs.

A labelled good and a labelled bad document make a preference pair. Weights are learnt by logistic loss on the difference
of the two feature vectors, so a document's score is linear in its features; it is then put on 0 to 1 so that a chosen
quantile of the training scores falls on ``CUT``, and documents below it are rejected.

Features describe the text alone (character classes, word shapes, repetition); labels, lang, source and doc_id are no
input. Labels are used of documents whose ``crc32(doc_id as text) mod 4`` is not 2, all of them: their features are stored
in blocks, and every step of the fit sums over all blocks in one job.

Defined cases: null and empty texts have zero features; a document labelled both ways, or with a null label, does not
train; repeated labels count once; without both classes no weight is learnt and every score is ``CUT`` (nothing is
rejected); a null doc_id is scored and never trains; repeated rows give repeated results; an empty table gives an empty
result; other columns do not take part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from causalspark.llm.frames import slices, stored, text_bytes

CUT, HELD_OUT = 0.7, 2
#: Pairs formed for each document of a block's smaller class; ridge weight; steepness of the 0 to 1 scale.
PAIRS_EACH, RIDGE, SLOPE = 12, 1e-3, 1.0
#: Labelled rows of a block, inside which pairs are formed; bins of training scores.
BLOCK, BINS = 8192, 16384

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\v\f", "stop": b".,;:?", "mark": b"!", "bar": b"|",
            "symbol": b"#$%&*<>=@^_`{}~+/\\"}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_chars), _i] = 1


def features(text: bytes) -> np.ndarray:
    """The feature vector of a text in UTF-8."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts @ _CLASS_OF / max(1, n)
    words = text.split()
    m = len(words)
    seen = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:])) / max(1, m - 1)
    lines = [x for x in text.split(b"\n") if x]
    sentences = [x for x in text.split(b". ") if x]
    most = max(seen.values(), default=0) / max(1, m)
    top = sum(c for _, c in seen.most_common(5)) / max(1, m)
    chars = counts[counts > 0] / max(1, n)
    base = np.array([*shares, same, most, top, len(seen) / max(1, m) if m else 0.0, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(sentences)) / max(1, len(sentences)),
                     counts[128:].sum() / max(1, n)])
    return np.concatenate([base, np.sqrt(base), [float(x > 0.02) for x in base[:len(shares) + 1]], [
        np.log1p(n) / 10, np.log1p(m) / 10, n / max(1, m) / 20, float(-(chars * np.log(chars)).sum()) / 4, float(n == 0),
        np.log1p(len(seen)) / 10, len(seen) / np.sqrt(max(1, m)) / 20]])


def featurise(docs: DataFrame, extra: list, text_col: str = "text") -> DataFrame:
    """The columns ``extra`` and ``features``."""
    head = docs.select(*extra).schema
    names = [*head.names, "features"]

    def run(batches):
        for batch in slices(batches):
            flat = pa.array([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=names)
    return docs.select(*extra, text_bytes(text_col)).mapInArrow(run, head.add("features", ArrayType(DoubleType())))


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality of the documents that may train."""
    return (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(remainder() != HELD_OUT)
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other"))


def _blocks(once: DataFrame, n: int) -> DataFrame:
    """(block, rows): the labelled rows (id, y, features), about BLOCK in a block, each block one matrix with y in front."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "y"], kind="stable")
        return pd.DataFrame({"block": rows.block.iloc[:1], "rows": [np.column_stack([rows.y, np.stack(rows.features.to_numpy())]).tobytes()]})
    block = F.pmod(F.xxhash64("id"), F.lit(-(-n // BLOCK))).alias("block")
    return stored(once.select(block, "id", "y", "features").groupBy("block").applyInPandas(pack, "block long, rows binary"), "quality")


def _summed(blocks: DataFrame, width: int, part) -> list[np.ndarray]:
    """The arrays that ``part(block, x, y)`` gives, added up in each task and then here."""
    def run(batches):
        total = None
        for batch in batches:
            for block, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.frombuffer(rows).reshape(-1, width + 1)
                got = part(block, m[:, 1:], m[:, 0])
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[np.ravel(a).tolist() for a in total]], pa.list_(pa.list_(pa.float64())))], names=["sums"])
    rows = blocks.mapInArrow(run, "sums array<array<double>>").collect()
    return [np.sum([r.sums[i] for r in rows], axis=0) for i in range(len(rows[0].sums))] if rows else []


def _preferences(block: int, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Feature differences of the block's good and bad pairs, the same in every step."""
    good, bad = z[y == 1], z[y == 0]
    n, rng = min(len(good), len(bad)) * PAIRS_EACH, np.random.default_rng(block)
    return good[rng.integers(0, len(good), n)] - bad[rng.integers(0, len(bad), n)] if n else z[:0]


def fit(blocks: DataFrame, width: int, bad_share: float):
    """Centre, scale and weights of the features, and the cut: the quantile of the scores that parts the classes best."""
    sums = _summed(blocks, width, lambda _, x, y: [np.array([len(y), (y == 1).sum()]), x.sum(axis=0)])
    if not sums or sums[0][1] in (0, sums[0][0]):
        return None
    (total, n_good), centre = sums[0], sums[1] / sums[0][0]
    scale = np.sqrt(_summed(blocks, width, lambda _, x, y: [((x - centre) ** 2).sum(axis=0)])[0] / total) + 1e-6
    standard = lambda x: np.clip((x - centre) / scale, -8, 8)
    w = np.zeros(width)

    def bent(block, x, y):
        d = _preferences(block, standard(x), y)
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        return [np.array([len(d)]), (d * p[:, None]).sum(axis=0), (d * (p * (1 - p))[:, None]).T @ d]
    for _ in range(30):  # Newton steps on the mean of log(1 + exp(-d w)) with a ridge
        (n,), pull, bend = _summed(blocks, width, bent)
        n = max(1.0, n)
        step = np.linalg.solve(bend.reshape(width, width) / n + RIDGE * np.eye(width), RIDGE * w - pull / n)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    # scores lie within the sum of the clipped features
    low, high = -8 * np.abs(w).sum() - 1e-6, 8 * np.abs(w).sum() + 1e-6

    def binned(_, x, y):
        at = ((standard(x) @ w - low) / (high - low) * BINS).astype(int)
        return [np.bincount(at[y == 1], minlength=BINS).astype(float), np.bincount(at[y == 0], minlength=BINS).astype(float)]
    good, bad = _summed(blocks, width, binned)
    right = (1 - bad_share) + np.r_[0, np.cumsum(bad * bad_share / (total - n_good) - good * (1 - bad_share) / n_good)]
    best = np.flatnonzero(right >= right.max() - 1e-12)  # rejecting the scores below is right most often
    end = best[0]
    while end + 1 < len(right) and good[end] == bad[end] == 0:
        end += 1
    return centre, scale, w, float(low + (high - low) * (best[0] + end) / 2 / BINS)


def train(docs: DataFrame, labels: DataFrame):
    """The fitted scale (see ``fit``), or None without both classes."""
    clean = training_labels(labels)
    totals = {r.quality: r.n for r in clean.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    ids = docs.withColumn("__id", F.col("doc_id").cast("bigint")).where(F.col("__id").isNotNull() & (remainder("__id") != HELD_OUT))
    rows = featurise(ids, [F.col("__id").alias("id"), F.xxhash64("text").alias("key")]).join(
        clean.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").alias("y")), "id")
    # a repeated doc_id trains once; the map tasks fold its rows
    once = rows.groupBy("id", "y").agg(F.min_by("features", "key").alias("features"))
    n = totals[0] + totals[1]
    return fit(_blocks(once, n), len(features(b"")), totals[0] / n)


def scores(docs: DataFrame, labels: DataFrame, extra: list) -> DataFrame:
    """The columns ``extra`` and ``score``."""
    model = train(docs, labels)
    head = docs.select(*extra).schema
    names = [*head.names, "__score"]
    base = float(np.log(CUT / (1 - CUT)))

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if model is None:
                out = np.full(len(texts), CUT)
            else:
                centre, scale, w, cut = model
                z = np.clip((np.stack([features(t) for t in texts]) - centre) / scale, -8, 8)
                raw = (z * w).sum(axis=1)  # not a matrix product, whose last bits vary with the rows beside a row
                out = 1 / (1 + np.exp(-np.clip((raw - cut) * SLOPE + base, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names=names)
    return docs.select(*extra, text_bytes("text")).mapInArrow(run, head.add("__score", DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return scores(docs, labels, ["doc_id"]).select(
        "doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= CUT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least CUT, with all their columns."""
    return scores(docs, labels, [F.struct("*").alias("__row")]).where(F.col("__score") >= CUT).select("__row.*")
