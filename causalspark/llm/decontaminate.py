"""Benchmark decontamination by winnowing.

Of every ``WINDOW - K + 1`` consecutive k-gram hashes the smallest is a fingerprint. A document and a benchmark item that
share ``WINDOW`` words share that choice, so joining the fingerprints finds every such span; a match is then extended
word by word to both sides, on the words themselves, and counts if the span reaches the window's length. Items with
fewer words than a window have one fingerprint, of all their words, at their own length.

The documents are read once. A bit table of the benchmark's fingerprints, of fixed size (``FILTER_BITS``), spares the
shuffle what cannot match; it filters only, the join decides, so a benchmark of any size gives the same result.

Defined cases: null and empty texts have no words and no hits, and an item without words has no window; a null doc_id
stays null; rows equal in doc_id and text get equal results, each its own row; repeated items count once by their
item_id; null item_ids are not listed; without items every document is clean; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import map_rows, slices, text_bytes, text_key
from causalspark.llm.segments import Segments, once
from causalspark.session import cut_lineage

WINDOW, K = 10, 5
FILTER_BITS = 22

#: Bytes to lower case, and all that is no word byte (0-9, a-z, 0x80 and up) to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _hash_word(word: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word)


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(word_hashes) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ word_hashes[i:i + n]) * _M1
        h ^= h >> np.uint64(29)
    h *= _M2
    return h ^ (h >> np.uint64(32))


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest of every w consecutive hashes (all positions that hold it)."""
    if w == 1:
        return np.arange(len(h))
    if len(h) < w:
        return np.empty(0, np.int64)
    least, reach = h, 1
    while reach < w:
        step = min(reach, w - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    chosen = np.zeros(len(h), bool)
    for o in range(w):
        chosen[o:o + len(least)] |= h[o:o + len(least)] == least
    return np.flatnonzero(chosen)


def seeds(words: list[bytes], lengths: Iterable[int], known: np.ndarray | None, whole: bool, window: int = WINDOW, k: int = K):
    """Fingerprints of a word list: (length, hash, place, words before, words from the place on).

    ``lengths`` are the windows' lengths; ``whole`` takes a list shorter than the window as one window (an item).
    ``known`` is the filter.
    """
    table = once("words", lambda: Segments(_hash_word))
    hashes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    for length in lengths:
        if len(words) < length or (whole and length != min(window, len(words))):
            continue
        gram = k if length == window else length
        h = gram_hashes(hashes, gram)
        if known is None:
            places = winnow(h, length - gram + 1)
        else:
            low = h & np.uint64((1 << FILTER_BITS) - 1)
            maybe = known[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1
            if not maybe.any():
                continue
            places = winnow(h, length - gram + 1)
            places = places[maybe[places].astype(bool)]
        reach = length - gram
        for p in places.tolist():
            yield (length, int(h[p].view(np.int64)), p, [w.decode(errors="replace") for w in words[max(0, p - reach):p]],
                   [w.decode(errors="replace") for w in words[p:p + length]])


_SEED = "length int, h bigint, place int, before array<string>, after array<string>"


def item_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """item_id and its fingerprints."""
    def make():
        def step(columns):
            rows = [(i, *s) for i, t in zip(*columns, strict=True) for s in seeds(words_of(t), range(1, window + 1), None, True, window, k)]
            return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 6
        return step
    return map_rows(benchmark.select(F.col(id_col).cast("string"), text_bytes(text_col)), make, "item_id string, " + _SEED)


def doc_seeds(docs: DataFrame, lengths: list[int], known: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
              window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, text_hash, n_words and the fingerprints that pass the filter, a row per document row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def make():
        bits = shared.value

        def step(columns):
            n, found = [], []
            for text in columns[2]:
                words = words_of(text)
                n.append(len(words))
                found.append([dict(zip(("length", "h", "place", "before", "after"), s, strict=True)) for s in seeds(words, lengths, bits, False, window, k)])
            return [columns[0], columns[1], n, found]
        return step
    rows = docs.select(F.col(id_col).cast("bigint"), text_key(text_col), text_bytes(text_col))
    return map_rows(rows, make, f"doc_id bigint, text_hash bigint, n_words bigint, seeds array<struct<{_SEED.replace(' ', ':').replace(',:', ',')}>>")


def _filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bit table (at most 2 ** FILTER_BITS numbers reach the driver) and the window lengths that occur."""
    low = items.select(F.expr(f"CAST(h & {(1 << FILTER_BITS) - 1} AS INT)").alias("low"), "length").distinct()
    bits, lengths = np.zeros(1 << FILTER_BITS - 3, np.uint8), set()
    for batch in low.toArrow().to_batches():
        at = batch.column(0).to_numpy()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        lengths |= set(batch.column(1).to_pylist())
    return bits, sorted(lengths)


def _extend(batches, window: int):
    """Joined seeds to spans (doc_id, text_hash, item_id, first, last) of at least the window's length."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
    for batch in slices(batches):
        out = []
        for d, t, i, length, p, before, after, ibefore, iafter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            right = 0
            while right < min(len(after), len(iafter)) and after[right] == iafter[right]:
                right += 1
            left = 0
            while left < min(len(before), len(ibefore)) and before[-1 - left] == ibefore[-1 - left]:
                left += 1
            if right >= (K if length == window else length) and left + right >= length:
                out.append((d, t, i, p - left, p + right - 1))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_words) and the spans that documents share with items."""
    items = cut_lineage(item_seeds(benchmark, window=window))
    known, lengths = _filter(items)
    found = cut_lineage(doc_seeds(docs, lengths, known, window=window))
    hits = found.select("doc_id", "text_hash", F.explode("seeds").alias("s")).select("doc_id", "text_hash", "s.*").distinct()
    of = items.select("item_id", F.col("length").alias("l"), F.col("h").alias("ih"), F.col("before").alias("ibefore"), F.col("after").alias("iafter")).distinct()
    joined = hits.join(of, (F.col("h") == F.col("ih")) & (F.col("length") == F.col("l"))).select(
        "doc_id", "text_hash", "item_id", "length", "place", "before", "after", "ibefore", "iafter")
    out = joined.mapInArrow(lambda batches: _extend(batches, window), "doc_id bigint, text_hash bigint, item_id string, first int, last int")
    return found.select("doc_id", "text_hash", "n_words"), cut_lineage(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found = spans(docs, benchmark, window)
    key = ["doc_id", "text_hash"]
    hit = found.select(*key, "first", "last").distinct().select(*key, F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select(*key, "item_id").distinct().groupBy(*key).agg(
        F.count("item_id").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    totals = hit.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}).join(
        items.withColumnsRenamed({"doc_id": "d2", "text_hash": "t2"}), F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2")))
    return rows.join(totals, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    _, found = spans(docs, benchmark, window)
    bad = cut_lineage(found.select("doc_id", "text_hash").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_hash"))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["doc_id"]) & (rows["text_hash"] == bad["text_hash"]), "left_anti").select("row.*")
