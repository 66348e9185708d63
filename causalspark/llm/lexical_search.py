"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` reads the documents once. Documents with about equally many terms form a block, a bit matrix with a
column for each document: a term that occurs at least LEVELS[j] times sets PROBES hashed rows of level j in its
document's column. A row is a slice; the AND of a term's rows overestimates where the term occurs, and never misses.

A search reads the index alone. The weights of the item's terms, summed over their slices of one level, times what the
level adds to a score at the document's length, bound the document's score from above, since a term between two levels
counts as if it stood just below the higher one. The ten highest bounds of each item are scored exactly from the texts;
the tenth score is the threshold. A second reading of the index keeps every document whose bound reaches the threshold
(at an equal bound, only ids that would still win the tie); all of them are scored exactly. So the result is exact.

Items are worked on in lots of at most LOT_PAIRS (item, term) pairs, which is what a task and the driver hold of them.
An item is all rows of one item_id; more terms than a lot hold make a lot of their own.

Defined cases: null and empty texts have no terms and are never found; a null doc_id stays null and wins ties;
repeated rows are documents of their own, with ranks of their own; of repeated items each term counts once; a null
item_id is an item; without items or documents the result is empty; other columns do not take part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.llm.decontaminate import words_of
from causalspark.llm.frames import or_least, slices, stored, text_bytes, text_key
from causalspark.llm.words import distinct, mix, word_table
from causalspark.operators.timejoin import top_per

TOP = 10
#: Rows that a term sets, and the share of bits that a block's longest document may set.
PROBES, DENSITY = 3, 0.25
#: Occurrences from which a term is in the slices of a level: the steps grow by a quarter to a half.
LEVELS = sorted({1, 2, 3, *(m << e for e in range(31) for m in (4, 5, 6, 7)[::1 if e < 2 else 2])})
#: Documents of a block, bits of a block, and (document, term) pairs that wait for their block.
BLOCK_DOCS, BLOCK_BITS, WAITING = 2048, 1 << 25, 1 << 22
#: (item, term) pairs of a lot; bits of the table that says which terms are counted; counted terms a task holds.
LOT_PAIRS, FILTER_BITS, COUNTED = 1 << 16, 22, 1 << 17

_LEVELS = np.array(LEVELS, np.int64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = pa.schema([("docs", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("n_rows", pa.int64()),
                    ("bits", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
                    ("seen", pa.list_(pa.struct([("term", pa.binary()), ("df", pa.int64())])))])
_BLOCK_SQL = ("docs int, ids binary, keys binary, sizes binary, n_rows bigint, bits binary, n_docs bigint, n_terms bigint, "
              "seen array<struct<term:binary,df:bigint>>")


def slice_rows(h: np.ndarray, level: np.ndarray | int, n_rows: int) -> np.ndarray:
    """The PROBES rows of each (term hash, level)."""
    a = mix(h + np.asarray(level, np.uint64) * _STEP)
    b = mix(a ^ _STEP) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(n_rows) for i in range(PROBES)], axis=-1).astype(np.int64)


class _Waiting:
    """Documents of a task until they are dealt to blocks."""

    def __init__(self):
        self.docs: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # id, key, words, term hashes, levels reached
        self.pairs = 0

    def add(self, doc_id: int, key: int, n: int, h: np.ndarray, tf: np.ndarray) -> None:
        reached = np.searchsorted(_LEVELS, tf, side="right")
        self.docs.append((doc_id, key, n, h, reached))
        self.pairs += int(reached.sum())

    def blocks(self) -> Iterator[list]:
        sized = sorted(((int(d[4].sum()), i) for i, d in enumerate(self.docs)))
        at = 0
        while at < len(sized):
            end = at + 1
            while (end < len(sized) and end - at < BLOCK_DOCS and sized[end][0] <= 2 * sized[at][0]
                   and _rows_for(sized[end][0]) * (end + 1 - at) <= BLOCK_BITS):
                end += 1
            yield _block([self.docs[i] for _, i in sized[at:end]], _rows_for(sized[end - 1][0]))
            at = end
        self.docs, self.pairs = [], 0


def _rows_for(pairs: int) -> int:
    return max(64, int(np.ceil(-PROBES * pairs / np.log1p(-DENSITY))))


def _block(docs: list[tuple], n_rows: int) -> list:
    matrix = np.zeros((n_rows, -(-len(docs) // 8) * 8), bool)
    for column, (_, _, _, h, reached) in enumerate(docs):
        first = np.cumsum(reached) - reached
        level = np.arange(reached.sum()) - np.repeat(first, reached)
        matrix[slice_rows(np.repeat(h, reached), level, n_rows).ravel(), column] = True
    ids, keys, sizes = (np.array([d[k] for d in docs], np.int64).tobytes() for k in range(3))
    return [len(docs), ids, keys, sizes, n_rows, np.packbits(matrix, axis=1, bitorder="little").tobytes()]


def _index(batches: Iterator[pa.RecordBatch], counted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc id, text key, text) to blocks; what was counted since the last block goes with the next one."""
    waiting, seen, n_docs, n_terms = _Waiting(), Counter(), 0, 0

    def out(blocks):
        nonlocal seen, n_docs, n_terms
        for block in [*blocks, [0, b"", b"", b"", 64, b""]]:
            row = [*block, n_docs, n_terms, [{"term": t, "df": c} for t, c in seen.items()]]
            seen, n_docs, n_terms = Counter(), 0, 0
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    for batch in slices(batches):
        ids, keys, texts = (c.to_pylist() for c in batch.columns)
        buffer, doc, start, end, h = word_table(texts)
        place, tf = distinct(doc, h)
        low = h[place] & np.uint64((1 << FILTER_BITS) - 1)
        watched = place[(counted[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        seen.update([buffer[a:b] for a, b in zip(start[watched].tolist(), end[watched].tolist(), strict=True)])
        words = np.bincount(doc, minlength=len(texts))
        n_docs, n_terms = n_docs + int(np.count_nonzero(words)), n_terms + len(doc)
        cut = np.searchsorted(doc[place], np.arange(len(texts) + 1))
        for i in np.flatnonzero(words).tolist():
            part = slice(cut[i], cut[i + 1])
            waiting.add(ids[i], keys[i], int(words[i]), h[place[part]], tf[part])
        if waiting.pairs > WAITING or len(seen) > COUNTED:
            yield from out(waiting.blocks())
    yield from out(waiting.blocks())


def build_index(docs: DataFrame, counted: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored blocks of all documents. ``counted`` (all terms if left out) says whose document counts go with them."""
    full = np.full(1 << FILTER_BITS - 3, 255, np.uint8) if counted is None else counted
    shared = docs.sparkSession.sparkContext.broadcast(full)
    rows = docs.select(or_least(id_col), text_key(text_col), text_bytes(text_col))
    return stored(rows.mapInArrow(lambda batches: _index(batches, shared.value), _BLOCK_SQL), "search_index")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, h: each term of an item once."""
    head = items.select(F.col(id_col).alias("item_id")).schema
    names = ["item_id", "term", "h"]

    def run(batches):
        for batch in slices(batches):
            buffer, doc, start, end, h = word_table(batch.column(1).to_pylist())
            place, _ = distinct(doc, h)
            terms = [buffer[a:b] for a, b in zip(start[place].tolist(), end[place].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[place])), pa.array(terms, pa.binary()), pa.array(h[place].view(np.int64))], names=names)
    rows = items.select(F.col(id_col).alias("item_id"), text_bytes(text_col))
    return rows.mapInArrow(run, head.add("term", "binary").add("h", "long")).distinct()


def _filter(terms: DataFrame) -> np.ndarray:
    """A bit table of the items' terms (at most 2 ** FILTER_BITS numbers reach the driver)."""
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for batch in terms.select(F.expr(f"CAST(h & {(1 << FILTER_BITS) - 1} AS INT)").alias("low")).distinct().toArrow().to_batches():
        at = batch.column(0).to_numpy()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


class Lot:
    """A bounded number of items with their terms, hashes and weights, and the corpus totals."""

    def __init__(self, n: int, total: int):
        self.n, self.total, self.items, self.pairs = n, total, [], 0
        self.of: list[list[int]] = []
        self.terms: dict[bytes, int] = {}
        self.h: list[int] = []
        self.w: list[int] = []

    def add(self, item, rows: list) -> None:
        self.items.append(item)
        self.pairs += len(rows)
        for r in rows:
            if r.term not in self.terms:
                self.terms[bytes(r.term)] = len(self.h)
                self.h.append(r.h)
                self.w.append(r.w)
        self.of.append([self.terms[r.term] for r in rows])

    def arrays(self):
        return np.array(self.h, np.int64).view(np.uint64), np.array(self.w, np.float64), [np.array(x, np.int64) for x in self.of]

    def m(self, n):
        return 10 + (90 * n * self.n) // self.total

    def scores(self, text: bytes, items: list[int]) -> list[int]:
        """The exact scores of a text."""
        words = words_of(text)
        m, tf = self.m(len(words)), Counter(words)
        terms = list(self.terms)
        part = {}
        for t in {t for i in items for t in self.of[i]}:
            k = tf.get(terms[t], 0)
            part[t] = self.w[t] * (1_000_000_000 * k // (1000 * k + 8 * m))
        return [sum(part[t] for t in self.of[i]) for i in items]


def _lots(rows: Iterator, n: int, total: int) -> Iterator[Lot]:
    """Rows (item_id, term, h, w), by item, to lots."""
    lot, item, own = Lot(n, total), None, []

    def close():
        nonlocal lot
        if lot.items and lot.pairs + len(own) > LOT_PAIRS:
            yield lot
            lot = Lot(n, total)
        if own:
            lot.add(item, own)
    for r in rows:
        if r.item_id != item:
            yield from close()
            item, own = r.item_id, []
        own.append(r)
    yield from close()
    if lot.items:
        yield lot


def upper_bounds(lot: tuple, size: Lot, n_rows: int, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, items by documents; ``n`` has the documents' lengths."""
    h, w, of = lot
    out = np.zeros((len(of), len(n)), np.int64)
    m, before = size.m(n), np.zeros(len(n), np.int64)
    place, held = np.arange(len(h)), None  # terms that may still be there, and their slices
    for j in range(len(LEVELS) - 1):
        parts = [np.bitwise_and.reduce(bits[slice_rows(h[some], j, n_rows)], axis=1) for some in np.array_split(place, max(1, len(place) // 1024))]
        now = np.concatenate(parts)
        if held is not None:
            now &= held
        there = now.any(axis=1)
        if not there.any():
            break
        place, held = place[there], now[there]
        most = 1_000_000_000 * (LEVELS[j + 1] - 1) // (1000 * (LEVELS[j + 1] - 1) + 8 * m)
        row = np.full(len(h), -1)
        row[place] = np.arange(len(place))
        for i, terms in enumerate(of):
            terms = terms[row[terms] >= 0]
            if len(terms):
                sums = w[terms] @ np.unpackbits(held[row[terms]], axis=1, bitorder="little", count=len(n)).astype(np.float64)
                out[i] += sums.astype(np.int64) * (most - before)
        before = most
    return out


def _blocks(batches: Iterator[pa.RecordBatch], lot: Lot):
    """ids, keys and upper bounds of each block."""
    arrays = lot.arrays()
    for batch in batches:
        for ids, keys, sizes, n_rows, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(sizes, np.int64)
            yield np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64), upper_bounds(arrays, lot, n_rows, np.frombuffer(bits, np.uint8).reshape(n_rows, -1), n)


def _best(batches, lot: Lot, top: int):
    """The documents with the highest bounds of each item among a task's blocks."""
    best = [np.zeros((0, 3), np.int64) for _ in lot.items]
    for ids, keys, bound in _blocks(batches, lot):
        for i, b in enumerate(bound):
            least = best[i][-1, 0] if len(best[i]) == top else 1
            at = np.flatnonzero(b >= least)
            if len(at) > top:
                at = at[b[at] >= np.partition(b[at], -top)[-top]]
            if len(at):
                new = np.concatenate([best[i], np.stack([b[at], ids[at], keys[at]], axis=1)])
                best[i] = new[np.lexsort((new[:, 1], -new[:, 0]))][:top]
    item = np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best])
    rows = np.concatenate([*best, np.zeros((0, 3), np.int64)])
    yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 0))], names=["item", "id", "key", "bound"])


def _reaching(batches, lot: Lot, score: np.ndarray, last: np.ndarray):
    """Every (item, document) whose bound can still win."""
    for ids, keys, bound in _blocks(batches, lot):
        item, at = np.nonzero((bound > score[:, None]) | ((bound == score[:, None]) & (bound > 0) & (ids[None, :] <= last[:, None])))
        for i in range(0, len(item), 10_000):
            a, part = at[i:i + 10_000], item[i:i + 10_000].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(ids[a]), pa.array(keys[a])], names=["item", "id", "key"])


def _exact(docs: DataFrame, found: DataFrame, lot, id_col: str, text_col: str) -> DataFrame:
    """item, doc_id, score, rank of the best of the found (item, id, key). The stored list is sent to the texts if Catalyst finds its files small, else both are shuffled."""
    wanted = stored(found.groupBy("id", "key").agg(F.collect_set("item").alias("items")), "search_found")  # at most the items of a lot
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), or_least(id_col).alias("id"), text_key(text_col).alias("key"), text_bytes(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches):
            ids, out = batch.column(0).to_pylist(), []
            for d, text, items in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out += [(i, d, s) for i, s in zip(items, lot.value.scores(text, items), strict=True) if s > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])
    joined = rows.join(wanted, ["id", "key"]).select("doc_id", "text", "items")
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return joined.mapInArrow(run, "item int, doc_id bigint, score bigint").withColumn("rank", place).where(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame, index: DataFrame | None = None, top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` (at most TOP) highest-scoring documents of each item.

    ``index`` is a stored ``build_index`` of the same documents that counts all terms; left out, one is built that counts the items' terms.
    """
    spark = docs.sparkSession
    terms = stored(item_terms(items), "search_terms")
    if index is None:
        index = build_index(docs, _filter(terms), id_col, text_col)
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    head = items.select("item_id").schema
    empty = spark.createDataFrame([], head.add("rank", "integer").add("doc_id", "long").add("score", "long"))
    if not total:
        return empty
    df = index.select(F.explode("seen").alias("s")).groupBy("s.term").agg(F.sum("s.df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    known = stored(terms.join(df, "term").select("item_id", "term", "h", weight.alias("w")), "search_weights").orderBy("item_id")
    blocks = index.where("docs > 0").select("ids", "keys", "sizes", "n_rows", "bits")
    out = empty
    for lot in _lots(known.toLocalIterator(), n, total):
        shared = spark.sparkContext.broadcast(lot)
        best = blocks.mapInArrow(lambda batches, shared=shared: _best(batches, shared.value, TOP), "item int, id bigint, key bigint, bound bigint")
        first = _exact(docs, top_per(best, ["item"], [F.desc("bound"), "id", "key"], TOP), shared, id_col, text_col)
        score, last = np.zeros(len(lot.items), np.int64), np.full(len(lot.items), np.iinfo(np.int64).max)
        tenth = first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max_by("doc_id", F.struct(-F.col("score"), "doc_id")).alias("d"), F.min("score").alias("s"))
        for r in tenth.collect():  # a row for each item of the lot
            if r.n >= TOP:
                score[r.item], last[r.item] = r.s, np.iinfo(np.int64).min if r.d is None else r.d
        limits = spark.sparkContext.broadcast((score, last))
        found = blocks.mapInArrow(lambda batches, shared=shared, limits=limits: _reaching(batches, shared.value, *limits.value), "item int, id bigint, key bigint")
        ranked = _exact(docs, found, shared, id_col, text_col)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(lot.items)], f"item int, item_id {head[0].dataType.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out.where(F.col("rank") <= top)
