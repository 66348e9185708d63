"""Log-probabilities of documents under a log-bilinear neural model trained by noise-contrastive estimation.

The model predicts a token's class from the CONTEXT tokens before it: their vectors, scaled for each place, add up to a
query, and the query's products with the class vectors, put through a softmax over all classes, are the class
probabilities. A token's probability is that of its class times its smoothed share of the class, from the counts of all
training tokens; each class keeps a share for tokens never seen, so the probabilities of all tokens add up to one. A
class is one of the most frequent words, or the words with a frequent last pair of bytes, or the rest by the last byte;
the end of a text is a class.

Counts, classes and training cover every training document. Training is in ROUNDS: in each, every task goes once over
its own share of the documents in numpy, and the tasks' parameters, weighted by their tokens, are averaged over a shuffle.
Scoring multiplies whole batches of queries with all class vectors, and sums exact normalised log-probabilities.

Counts of at most HEAD frequent words go to the tasks; every other token is looked up by a shuffle join, which has no hot
keys since what is frequent is in the head.

Defined cases: a null text is empty and has its end as only token; a null doc_id is scored, not held out, and does not
train; repeated rows count and train as often as they stand there; without training documents all counts are zero; an
empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import slices, stored, text_bytes
from causalspark.llm.segments import once

HELD_OUT_OF, SMOOTH = 10, 0.1
#: The token that ends a text; no word has white space.
END = b" "
#: Frequent words whose counts every task holds, and the longest of them; words with a context vector of their own.
HEAD, HEAD_BYTES, WORDS = 1 << 17, 64, 4096
#: Classes of single words (the end among them), of last byte pairs, of last bytes.
SINGLE, PAIRS, REST = 64, 180, 12
CLASSES = SINGLE + PAIRS + REST
CONTEXT, DIM, BATCH, NOISE, RATE, ROUNDS = 5, 16, 1024, 64, 0.15, 4
#: Tokens a task counts before it sends them on; parameters of one record.
COUNTED, PIECE = 1 << 20, 1 << 14

#: Context ids: the frequent words, then the classes of all others, then the place before a text.
BEFORE = WORDS + CLASSES
_SHAPES = {"context": (BEFORE + 1, DIM), "scale": (CONTEXT, DIM), "out": (CLASSES, DIM), "bias": (CLASSES,)}
_N = sum(int(np.prod(s)) for s in _SHAPES.values())


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased, without the end."""
    return text.lower().split()


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF


# counts and classes

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Counter()

    def out():
        words = list(seen)
        for i in range(0, len(words), 50_000):
            part = words[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["token", "c"])
        seen.clear()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            seen.update(tokens(text))
            seen[END] += 1
        if len(seen) > COUNTED:
            yield from out()
    yield from out()


def token_counts(texts: DataFrame) -> DataFrame:
    """token, c of a frame with one binary text column."""
    return texts.mapInArrow(_count, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head words by falling count, the classes, and the totals; its size is bounded by HEAD and HEAD_BYTES."""

    def __init__(self, words: list[bytes], counts: list[int], pairs: list[bytes]):
        self.name = uuid.uuid4().hex
        self.words, self.counts = words, np.array(counts, np.float64)
        single = [w for w in words if w != END][:SINGLE - 1]
        self.single = {END: 0} | {w: i + 1 for i, w in enumerate(single)}
        self.pairs = {p: SINGLE + i for i, p in enumerate(pairs)}
        self.totals = self.sizes = None

    def class_of(self, word: bytes) -> int:
        own = self.single.get(word)
        if own is None:
            own = self.pairs.get(word[-2:])
        return SINGLE + PAIRS + word[-1] % REST if own is None else own

    def weigh(self, totals: np.ndarray, sizes: np.ndarray) -> None:
        """Totals and distinct tokens of each class."""
        self.totals, self.sizes = totals, sizes
        self.n, self.v = totals.sum(), sizes.sum()

    def tables(self):
        """Of the head words: their number by word, context id, class, log10 of the plain share and of the share of the class."""
        def make():
            classes = np.array([self.class_of(w) for w in self.words], np.int64)
            ids = np.where(np.arange(len(classes)) < WORDS, np.arange(len(classes)), WORDS + classes)
            plain = np.log10((self.counts + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))
            share = np.log10((self.counts + SMOOTH) / (self.totals + SMOOTH * (self.sizes + 1))[classes])
            return {w: i for i, w in enumerate(self.words)}, ids, plain, share
        return once(("vocabulary", self.name), make)

    def classes(self) -> np.ndarray:
        """The class of each context id (none for the place before a text)."""
        head = [self.class_of(w) for w in self.words[:WORDS]]
        return np.r_[np.array(head + [0] * (WORDS - len(head)), np.int64), np.arange(CLASSES), -1]


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary without totals, and the least count of its head words (of at most HEAD_BYTES)."""
    short = counts.where(F.length("token") <= HEAD_BYTES)
    level = F.floor(F.log2("c") * 16).cast("int")  # a few hundred levels, however many tokens
    levels = short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    least, n = 1 << 62, 0
    for r in sorted(levels, key=lambda r: -r.level):
        n += r.n
        if n > HEAD:
            break
        least = r.c
    head = sorted(((-r.c, bytes(r.token)) for r in short.where(F.col("c") >= least).toLocalIterator()))
    words = [w for _, w in head]
    single = [w for w in words if w != END][:SINGLE - 1]
    pair = F.substring("token", -2, 2)
    others = counts.where(~F.col("token").isin([bytearray(w) for w in [END, *single]]))
    pairs = others.groupBy(pair.alias("pair")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "pair").limit(PAIRS).collect()
    return Vocabulary(words, [-c for c, _ in head], [bytes(r.pair) for r in pairs]), least


def _class_totals(counts: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for batch in batches:
            classes = [shared.value.class_of(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), batch.column(1)], names=["k", "c"])
    totals, sizes = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.mapInArrow(run, "k int, c bigint").groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # a row for each class
        totals[r.k], sizes[r.k] = r.c, r.n
    return totals, sizes


# encoded documents

_ENCODED = ("row bigint, doc_id bigint, held_out boolean, trains boolean, fold int, n_tokens bigint, n_known bigint, plain double, share double, "
            "ids binary, tail array<struct<token:binary,k:int,tf:int>>")


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """doc_id, remainder, text to rows of _ENCODED. A row's number is that of its partition and of its place in it."""
    vocabulary = shared.value
    number, ids_of, plain, share = vocabulary.tables()
    ids_of, plain, share = np.append(ids_of, 0), np.append(plain, 0.0), np.append(share, 0.0)  # last: not in the head
    row = TaskContext.get().partitionId() << 40
    tail_type = pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int32()), ("tf", pa.int32())]))
    for batch in slices(batches):
        out = {k: [] for k in ("row", "fold", "n_tokens", "n_known", "plain", "share", "ids", "tail")}
        left = batch.column(1).to_pylist()
        for text in batch.column(2).to_pylist():
            words = tokens(text)
            words.append(END)
            at = np.array([number.get(w, -1) for w in words])
            ids, missing = ids_of[at], np.flatnonzero(at < 0)
            tail = Counter()
            for i in missing.tolist():
                w = words[i]
                k = vocabulary.class_of(w)
                ids[i] = WORDS + k
                tail[w, k] += 1
            for k, v in zip(out, (row, row % ROUNDS, len(words), len(words) - len(missing), plain[at].sum(), share[at].sum(), ids.astype(np.uint16).tobytes(),
                                  [{"token": w, "k": c, "tf": n} for (w, c), n in tail.items()]), strict=True):
                out[k].append(v)
            row += 1
        yield pa.RecordBatch.from_arrays([
            pa.array(out["row"], pa.int64()), batch.column(0), pa.array([x == 0 for x in left]), pa.array([x is not None and x != 0 for x in left]),
            pa.array(out["fold"], pa.int32()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["plain"], pa.float64()),
            pa.array(out["share"], pa.float64()), pa.array(out["ids"], pa.binary()), pa.array(out["tail"], tail_type)], names=[c.split()[0] for c in _ENCODED.split(", ")])


# the model

def start(totals: np.ndarray) -> np.ndarray:
    """Parameters (and, behind them, their sums of squared slopes) before training: small vectors, biases by class frequency."""
    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.1, s) for k, s in _SHAPES.items()}
    p["scale"] = np.full(_SHAPES["scale"], 1.0 / CONTEXT)
    p["bias"] = np.log((totals + 1) / (totals.sum() + CLASSES))
    return np.r_[np.concatenate([p[k].ravel() for k in _SHAPES]), np.full(_N, 1e-3)].astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def queries(p: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context vectors of ids, and the query of every id but the first CONTEXT."""
    e, n = p["context"][ids], len(ids) - CONTEXT
    q = np.zeros((n, DIM), np.float32)
    for i in range(CONTEXT):
        q += p["scale"][i] * e[CONTEXT - 1 - i:CONTEXT - 1 - i + n]
    return e, q


def _add_rows(shape: tuple, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(shape, np.float32)
    for d in range(shape[1]):
        out[:, d] = np.bincount(at, values[:, d], shape[0])
    return out


def step(flat: np.ndarray, ids: np.ndarray, classes: np.ndarray, noise_share: np.ndarray, rng: np.random.Generator) -> None:
    """One step of noise-contrastive estimation over the ids after the first CONTEXT, in place."""
    p, squares = views(flat[:_N]), flat[_N:]
    target = classes[ids[CONTEXT:]]
    real = (target >= 0).astype(np.float32)
    target = np.maximum(target, 0)
    noise = rng.choice(CLASSES, NOISE, p=noise_share)
    log_noise = np.log(NOISE * noise_share).astype(np.float32)
    e, q = queries(p, ids)
    out, bias = p["out"], p["bias"]
    own = np.einsum("td,td->t", q, out[target]) + bias[target] - log_noise[target]
    other = q @ out[noise].T + (bias[noise] - log_noise[noise])
    down = -real / (1 + np.exp(np.clip(own, -30, 30)))
    up = real[:, None] / (1 + np.exp(np.clip(-other, -30, 30)))
    dq = down[:, None] * out[target] + up @ out[noise]
    g = np.zeros(_N, np.float32)
    grad = views(g)
    grad["out"][:] = _add_rows(out.shape, target, down[:, None] * q)
    np.add.at(grad["out"], noise, up.T @ q)
    grad["bias"][:] = np.bincount(target, down, CLASSES) + np.bincount(noise, up.sum(axis=0), CLASSES)
    de, n = np.zeros_like(e), len(dq)
    for i in range(CONTEXT):
        part = slice(CONTEXT - 1 - i, CONTEXT - 1 - i + n)
        de[part] += p["scale"][i] * dq
        grad["scale"][i] = np.einsum("td,td->d", dq, e[part])
    grad["context"][:] = _add_rows(p["context"].shape, ids, de)
    g /= max(1.0, float(real.sum()))
    squares += g * g
    flat[:_N] -= RATE * g / np.sqrt(squares)


def sequences(texts: list[bytes]) -> np.ndarray:
    """Ids of encoded texts one after another, each with CONTEXT places before it."""
    gap = np.full(CONTEXT, BEFORE, np.uint16)
    return np.concatenate([x for t in texts for x in (gap, np.frombuffer(t, np.uint16))]).astype(np.int64) if texts else np.zeros(0, np.int64)


def train_over(flat: np.ndarray, batches: Iterator[list[bytes]], classes: np.ndarray, noise_share: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """The parameters after one pass, and the number of tokens."""
    flat, rng, left, n = flat.copy(), np.random.default_rng(seed), np.full(CONTEXT, BEFORE, np.int64), 0

    def steps(ids, all_of_it):
        at = CONTEXT
        while len(ids) - at >= (1 if all_of_it else BATCH):
            step(flat, ids[at - CONTEXT:at + BATCH], classes, noise_share, rng)
            at += BATCH
        return ids[min(at, len(ids)) - CONTEXT:]
    for texts in batches:
        ids = sequences(texts)
        n += int((classes[ids] >= 0).sum())
        left = steps(np.concatenate([left, ids]), False)
    steps(left, True)
    return flat, n


def class_log_probabilities(p: dict[str, np.ndarray], ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the classes of all ids but the first CONTEXT (zero for the place before a text)."""
    out = np.zeros(len(ids) - CONTEXT)
    for i in range(0, len(out), 4096):
        part = ids[i:i + 4096 + CONTEXT]
        target = classes[part[CONTEXT:]]
        logits = queries(p, part)[1] @ p["out"].T + p["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        own = logits[np.arange(len(target)), np.maximum(target, 0)]
        np.exp(logits, out=logits)
        out[i:i + 4096] = np.where(target >= 0, own - np.log(logits.sum(axis=1)), 0.0)
    return out


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (piece, part, n, values) to the weighted mean of each piece."""
    piece, total, weight = None, None, 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["piece", "values"])
    for batch in batches:
        for p, _, n, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(values, np.float32).astype(np.float64) * n
            if p != piece:
                if piece is not None:
                    yield out()
                piece, total, weight = p, np.zeros(len(x)), 0
            total, weight = total + x, weight + n
    if piece is not None:
        yield out()


def train(encoded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The parameters after ROUNDS rounds over the documents that train."""
    sc, classes = encoded.sparkSession.sparkContext, vocabulary.classes()
    noise_share = (vocabulary.totals + 1) / (vocabulary.totals.sum() + CLASSES)
    flat = start(vocabulary.totals)
    for number in range(ROUNDS):
        shared = sc.broadcast((flat, classes, noise_share))

        def run(batches, shared=shared, number=number):
            part = TaskContext.get().partitionId()
            new, n = train_over(shared.value[0], (b.column(0).to_pylist() for b in slices(batches)), *shared.value[1:], seed=part * ROUNDS + number)
            for i in range(-(-len(new) // PIECE) if n else 0):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()),
                                                  pa.array([new[i * PIECE:(i + 1) * PIECE].tobytes()], pa.binary())], names=["piece", "part", "n", "values"])
        of_tasks = encoded.where(F.col("trains") & (F.col("fold") == number)).select("ids").mapInArrow(run, "piece int, part int, n bigint, values binary")
        merged = of_tasks.repartition("piece").sortWithinPartitions("piece", "part").mapInArrow(_average, "piece int, values binary")
        flat = flat.copy()
        for r in merged.collect():  # the parameters, of fixed size
            flat[r.piece * PIECE:(r.piece + 1) * PIECE] = np.frombuffer(r["values"], np.float32)
    return flat


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), remainder(id_col).alias("left"), text_bytes(text_col).alias("text"))
    counts = stored(token_counts(rows.where("left <> 0").select("text")), "lm_counts")
    words, least = vocabulary(counts)
    words.weigh(*_class_totals(counts, sc.broadcast(words)))
    shared = sc.broadcast(words)
    encoded = stored(rows.mapInArrow(lambda b: _encode(b, shared), _ENCODED), "lm_encoded")
    model = sc.broadcast((views(train(encoded, words)[:_N]), words.classes()))

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = np.concatenate([np.full(CONTEXT, BEFORE, np.int64), sequences(texts)])
            p = class_log_probabilities(model.value[0], ids, model.value[1])
            ends = np.cumsum([len(t) // 2 + CONTEXT for t in texts])
            total = np.add.reduceat(p, np.r_[0, ends[:-1]]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.float64())], names=[*batch.schema.names[:-1], "by_class"])
    head = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "plain", "share", "ids")
    scored = head.mapInArrow(run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, plain double, share double, by_class double")

    in_class = docs.sparkSession.createDataFrame(
        [(k, float(np.log10(words.totals[k] + SMOOTH * (words.sizes[k] + 1)))) for k in range(CLASSES)], "k int, of_class double")
    rare = counts.where((F.col("c") < least) | (F.length("token") > HEAD_BYTES))
    tail = encoded.select("row", F.inline("tail")).join(rare, "token", "left").join(F.broadcast(in_class), "k")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    whole = float(np.log10(words.n + SMOOTH * (words.v + 1)))
    sums = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum(F.col("tf") * (log_c - whole)).alias("tail_plain"),
        F.sum(F.col("tf") * (log_c - F.col("of_class"))).alias("tail_share"))
    zero = F.lit(0.0)
    return scored.join(sums, "row", "left").select(
        "doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(words.n)).cast("bigint").alias("train_tokens"), (F.col("plain") + F.coalesce("tail_plain", zero)).alias("base_score"),
        (F.col("by_class") + F.col("share") + F.coalesce("tail_share", zero)).alias("score"))
