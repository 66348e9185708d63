"""SimHash near-deduplication with one-wildcard segment signatures.

A fingerprint has 64 bits and links reach over three differing bits. Cut into two segments, one of them differs in at
most one bit. So each distinct fingerprint is indexed under 64 keys, each a segment with one bit taken as a wildcard, and
an equality on the key (a shuffle) brings every possible link together; the full fingerprints are then compared.

Inside a key's group only links that join separate parts are emitted, never all pairs. A group of more than
``PAIR_LIMIT`` fingerprints is not compared in one task: its members are indexed once more under the variants of their
other segment, so that equal keys alone prove a link and no group has more members than a ball of two flipped bits.

Defined cases: a null text is empty; a text without words has fingerprint zero; equal texts have equal fingerprints and
so one component; a null doc_id never names a component unless all its members' are null; repeated rows give repeated
results; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.components import components
from causalspark.llm.frames import one_of_equal, or_least, slices, text_bytes, text_key
from causalspark.session import cut_lineage

SHINGLE_WORDS, MAX_BITS = 3, 3
PAIR_LIMIT = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text in UTF-8, as a signed number."""
    import xxhash
    words = text.lower().split()  # of bytes: only A-Z, and white space is space, \\t, \\n, \\v, \\f, \\r
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        grams = [joined[s:e] for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(grams), 65536):
        part = np.array([digest(g, 42) for g in grams[i:i + 65536]], np.uint64)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(grams), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp: one row per document row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], schema=schema)
    return docs.select(F.col(id_col).cast("bigint"), text_key(text_col), text_bytes(text_col)).mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def wildcard_keys(nodes: DataFrame) -> DataFrame:
    """``nodes(fp)`` to ``(key, fp)``: for both segments of 32 bits, the segment with each bit in turn cleared.

    The key holds the segment's number (bit 37), the wildcard's place (bits 32 to 36) and the other 31 bits.
    """
    spread = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    return spread.selectExpr(
        "(CAST(v AS BIGINT) << 32) | ((CASE WHEN v < 32 THEN fp ELSE shiftrightunsigned(fp, 32) END & 4294967295L) & ~(1L << (v % 32))) AS key", "fp")


def _tree_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what pairs within MAX_BITS connect, and no more than one fewer than members."""
    n = len(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= MAX_BITS
    left, links = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            u = todo.pop()
            found = np.flatnonzero(near[u] & left)
            left[found] = False
            links += [(u, int(v)) for v in found]
            todo += found.tolist()
    return links


def _group_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), sorted, to links (a, b, null) and, of groups over the limit, members (null, fp, key)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def out(a, b, key=None):
        return pa.RecordBatch.from_arrays([
            pa.nulls(len(b), pa.int64()) if a is None else pa.array(a, pa.int64()), pa.array(b, pa.int64()),
            pa.nulls(len(b), pa.int64()) if key is None else pa.array(np.full(len(b), key), pa.int64())], schema=schema)

    keys, fps, large = np.empty(0, np.int64), np.empty(0, np.int64), None

    def close(keys, fps):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        x, y = fps[two], fps[two + 1]
        ok = np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS
        a, b = [x[ok]], [y[ok]]
        for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if m > limit:
                yield out(None, fps[s:s + m], keys[s])
                continue
            own = fps[s:s + m]
            if links := _tree_links(own.view(np.uint64)):
                i = np.array(links)
                a.append(own[i[:, 0]])
                b.append(own[i[:, 1]])
        yield out(np.concatenate(a), np.concatenate(b))

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if large is not None:  # the rest of a group that is known to be over the limit
            more = int(np.searchsorted(k, large, "right"))
            if more:
                yield out(None, f[:more], large)
                k, f = k[more:], f[more:]
            if not len(k):
                continue
            large = None
        keys, fps = np.r_[keys, k], np.r_[fps, f]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield from close(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
        if len(keys) > limit:
            large = int(keys[0])
            yield out(None, fps, large)
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield from close(keys, fps)


def _large_links(members: DataFrame) -> DataFrame:
    """Links inside groups over the limit, from members (key, fp), without comparing pairs.

    Own segment within the wildcard, so at most one bit apart there. Variants of the other segment with at most one bit
    flipped: equal variants mean at most two bits apart there, together three. What is left is an equal own segment and
    three bits in the other one: a variant with up to two flips equals one with up to one, of the member named centre.
    """
    other = "CASE WHEN key < 137438953472L THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    own = "CASE WHEN key < 137438953472L THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    flips = members.selectExpr("key", "fp", f"explode(concat(array(0L), transform(sequence(0, 31), i -> 1L << i))) AS flip", f"{other} AS other")
    ball = flips.selectExpr("key", "other ^ flip AS variant", "fp")
    star = ball.groupBy("key", "variant").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where("size(all) > 1").select("a", F.explode("all").alias("b"))
    same = flips.where("(key >> 32) % 32 = 0").selectExpr("key >> 37 AS side", f"{own} AS own", "fp", "flip", "other")
    twice = same.selectExpr("side", "own", "fp", "flip", "explode(concat(array(0L), transform(sequence(0, 31), i -> 1L << i))) AS flip2", "other").where("flip2 = 0 OR flip2 > flip")
    centre = twice.selectExpr("side", "own", "other ^ flip ^ flip2 AS variant", "fp", "CASE WHEN flip = 0 OR flip2 = 0 THEN fp END AS near")
    wide = centre.groupBy("side", "own", "variant").agg(F.min("near").alias("a"), F.collect_set("fp").alias("all")).where("a IS NOT NULL AND size(all) > 1")
    return star.unionByName(wide.select("a", F.explode("all").alias("b")))


def links(nodes: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """``nodes(fp)``, distinct, to links (a, b) that connect exactly what all pairs within three bits connect."""
    keyed = wildcard_keys(nodes).repartition("key").sortWithinPartitions("key")
    found = cut_lineage(keyed.mapInArrow(lambda batches: _group_links(batches, limit), "a bigint, b bigint, key bigint"))
    small = found.where("key IS NULL").select("a", "b")
    return small.unionByName(_large_links(found.where("key IS NOT NULL").select("key", F.col("b").alias("fp"))))


def near_groups(fps: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """``fps(doc_id, fp)`` to one row per fingerprint: fp, component_id (smallest doc_id that can be reached)."""
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), limit)).withColumnRenamed("node", "fp")
    known = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = cut_lineage(known.groupBy("root").agg(F.min("first").alias("component_id")))  # so that both join sides are shuffled
    return known.join(best, "root").select("fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = PAIR_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    return fps.join(near_groups(fps, limit), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = PAIR_LIMIT) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    named = fps.join(near_groups(fps, limit), "fp")
    kept = named.where("doc_id <=> component_id").groupBy("component_id", "doc_id").agg(F.min("text_hash").alias("text_hash")).select(
        or_least("doc_id").alias("doc_id"), "text_hash")
    rows = docs.select(F.struct("*").alias("row"), or_least(id_col).alias("doc_id"), text_key(text_col).alias("text_hash"))
    found = rows.join(kept, ["doc_id", "text_hash"], "left_semi")  # the window below reuses this partitioning
    plain = [f"row.`{f.name}`" for f in docs.schema.fields if f.name != text_col and "map" not in f.dataType.simpleString()]
    return one_of_equal(found, ["doc_id", "text_hash"], [F.xxhash64(*[F.col(c) for c in plain])]).select("row.*")
