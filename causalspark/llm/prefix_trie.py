"""The trie of conversation prefixes, screened by a count-min sketch of prefix digests.

The digest of a prefix is a running sum of its turns' hashes, each times a power of an odd base, in two lanes of 64 bits;
so it is worked out over many tasks however long a conversation is. Every conversation adds each of its prefixes once to
a count-min sketch. A sketch only overestimates: an estimate of one proves that no other conversation has the prefix. Then
all longer prefixes of it are its own too, and their nodes are emitted where they stand, without a shuffle. What may be
shared (and the first node that is not) is grouped exactly.

Sums over subtrees need no walk: a node belongs to its smallest member, whose nodes are the end of its own path. So a
node's subtree is, for each of its members, what that member owns from the node's depth on.

Defined cases: rows without conv_id belong to no conversation and are left out; a null role or text is empty; turns are
ordered by turn (null first), role, text; repeated rows are turns of their own; an empty table gives no nodes; other
columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from causalspark.llm.frames import slices
from causalspark.llm.running import running
from causalspark.llm.words import mix
from causalspark.session import cut_lineage

#: Turns that a rebuilt conversation may take over, and how many conversations share a base.
MOST_HEAD, BASE_EACH = 8, 5
#: Rows of the sketch; its columns are four times the prefixes, within these bounds; cells that travel in one record.
LANES, LEAST_CELLS, MOST_CELLS, PIECE = 4, 1 << 16, 1 << 24, 1 << 16
#: Bytes of an ends list that are one record.
CHUNK = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_NODE = ["depth", "k1", "k2"]


def _hash_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, role, text to conv_id, two hash lanes and the bytes of the text."""
    for batch in slices(batches):
        role, text = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        digest = b"".join(hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16).digest() for r, t in zip(role, text, strict=True))
        lanes = np.frombuffer(digest, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(2)), pa.array([len(t) for t in text], pa.int64())],
                                         names=["conv_id", "x1", "x2", "n_bytes"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn hashes to terms of the digests: each lane times the base to the power of the turn's place."""
    for batch in batches:
        place = batch.column(batch.schema.get_field_index("position")).to_numpy().astype(np.uint64)
        out = []
        for name, base in zip(("x1", "x2"), _BASES, strict=True):
            x = batch.column(batch.schema.get_field_index(name)).to_numpy().view(np.uint64)
            out.append(pa.array((x * _powers(base, place)).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("conv_id")), pa.array(place.view(np.int64)), *out,
                                          batch.column(batch.schema.get_field_index("n_bytes"))], names=["conv_id", "position", "x1", "x2", "n_bytes"])


def _powers(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2 ** 64, by squaring."""
    out, square, left = np.ones(len(exponent), np.uint64), np.uint64(base), exponent.copy()
    while left.any():
        out[(left & np.uint64(1)).astype(bool)] *= square
        left >>= np.uint64(1)
        square = np.uint64(int(square) * int(square) % (1 << 64))
    return out


def _plain(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), n_bytes of the text, digest lanes (k1, k2) of the prefix and (p1, p2) of the one before."""
    def narrow(rows):
        return rows.select("conv_id", F.col("role").cast("binary"), F.col("text").cast("binary")).mapInArrow(_hash_turns, "conv_id bigint, x1 bigint, x2 bigint, n_bytes bigint")
    placed = running(_plain(conversations), "conv_id", ["turn", "role", "text"], [], shape=narrow)
    terms = placed.mapInArrow(_prefixes, "conv_id bigint, position bigint, x1 bigint, x2 bigint, n_bytes bigint")
    summed = running(terms, "conv_id", ["position"], ["x1", "x2"], number="__again")

    def lanes(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            before = [pa.array((col[f"x{i}_run"].to_numpy().view(np.uint64) - col[f"x{i}"].to_numpy().view(np.uint64)).view(np.int64)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([col["conv_id"], col["position"], col["n_bytes"], col["x1_run"], col["x2_run"], *before],
                                             names=["conv_id", "position", "n_bytes", "k1", "k2", "p1", "p2"])
    return summed.mapInArrow(lanes, "conv_id bigint, position bigint, n_bytes bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint")


_ROW = "conv_id bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, n_bytes bigint, length bigint, source bigint, position bigint"


def rebuilt(turns: DataFrame, head: Column, base: Column) -> DataFrame:
    """The prefixes (depth from 0) of conversations that start with the first ``head`` turns of another one.

    ``head`` (at most MOST_HEAD) and ``base`` are columns over conv_id. ``source`` and ``position`` name the prefix's last turn.
    """
    head, base = head.cast("bigint"), base.cast("bigint")
    convs = turns.withColumn("h", head).groupBy("conv_id", "h").agg(
        F.max("position").alias("own"), *[F.max(F.when(F.col("position") == F.col("h"), F.col(k))).alias(f"{k}_h") for k in ("k1", "k2")])
    # at most MOST_HEAD turns of each base
    heads = turns.where(F.col("position") <= MOST_HEAD).where(base == F.col("conv_id")).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("position", "n_bytes", "k1", "k2", "p1", "p2"))).alias("turns"))
    meta = cut_lineage(convs.withColumn("base", base).join(heads, "base", "left").withColumn(
        "taken", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.greatest(F.col("h").cast("int"), F.lit(0)))).select(
        "conv_id", "base", "h", "own", "k1_h", "k2_h", "taken", F.size("taken").cast("bigint").alias("m")).withColumn(
        "length", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    zero = F.lit(0).cast("bigint")
    root = meta.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("n_bytes"), "length",
                       F.lit(None).cast("bigint").alias("source"), zero.alias("position"))
    taken = meta.select("conv_id", "base", "length", F.inline("taken")).select(
        "conv_id", F.col("position").alias("depth"), "k1", "k2", "p1", "p2", "n_bytes", "length", F.col("base").alias("source"), "position")
    last = F.element_at("taken", -1)
    rest = turns.join(meta.where("own > h").select(
        "conv_id", "h", "m", "length", F.coalesce("k1_h", zero).alias("k1_h"), F.coalesce("k2_h", zero).alias("k2_h"),
        *[F.coalesce(F.when(F.col("m") > 0, last[k]), zero).alias(f"{k}_b") for k in ("k1", "k2")]), "conv_id").where("position > h")

    def shifted(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            u = {n: c.to_numpy().view(np.uint64) for n, c in col.items()}
            shift, lanes = u["h"] - u["m"], {}
            for i in (1, 2):
                back = _powers(_INVERSE[i - 1], shift)
                for name in ("k", "p"):
                    lanes[name, i] = pa.array((u[f"k{i}_b"] + (u[f"{name}{i}"] - u[f"k{i}_h"]) * back).view(np.int64))
            yield pa.RecordBatch.from_arrays([col["conv_id"], pa.array((u["position"] - shift).view(np.int64)), lanes["k", 1], lanes["k", 2], lanes["p", 1], lanes["p", 2],
                                              col["n_bytes"], col["length"], col["conv_id"], col["position"]], names=[c.split()[0] for c in _ROW.split(", ")])
    return root.unionByName(taken).unionByName(rest.mapInArrow(shifted, _ROW))


def _cells(k1: np.ndarray, k2: np.ndarray, depth: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """The sketch cell of each prefix in each lane."""
    h = mix(k1.view(np.uint64) + mix(k2.view(np.uint64) + depth.astype(np.uint64)))
    for lane in range(LANES):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        yield (h & np.uint64(cells - 1)).astype(np.int64) + lane * cells


def _sketch(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """A task's counts (0, 1, more) as bit pieces: cells counted at all, cells counted more than once."""
    count = np.zeros(LANES * cells, np.uint8)
    for batch in batches:
        depth, k1, k2 = (c.to_numpy() for c in batch.columns)
        for cell in _cells(k1, k2, depth, cells):
            at, n = np.unique(cell, return_counts=True)
            count[at] = np.minimum(2, count[at] + np.minimum(n, 2)).astype(np.uint8)
    for piece in range(LANES * cells // PIECE):
        own = count[piece * PIECE:(piece + 1) * PIECE]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), *(pa.array([np.packbits(own >= k).tobytes()], pa.binary()) for k in (1, 2))], names=["piece", "some", "more"])


def _merge_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the pieces of all tasks, in order of the piece, to the bits of cells counted more than once."""
    piece, some, more = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([more.tobytes()], pa.binary())], names=["piece", "more"])
    for batch in batches:
        for p, s, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s, m = np.frombuffer(s, np.uint8), np.frombuffer(m, np.uint8)
            if p == piece:
                some, more = some | s, more | m | (some & s)
            else:
                if piece is not None:
                    yield out()
                piece, some, more = p, s, m
    if piece is not None:
        yield out()


def shared_cells(rows: DataFrame) -> np.ndarray:
    """The count-min sketch of all prefixes, as bits (a row for each lane) of cells that count more than one; its size is bounded by MOST_CELLS."""
    cells = LEAST_CELLS
    n = rows.count()
    while cells < min(4 * n, MOST_CELLS):
        cells *= 2
    pieces = rows.select(*_NODE).mapInArrow(lambda b: _sketch(b, cells), "piece int, some binary, more binary")
    merged = pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_merge_pieces, "piece int, more binary")
    out = np.zeros((LANES * cells // PIECE, PIECE // 8), np.uint8)
    for r in merged.toLocalIterator():
        out[r.piece] = np.frombuffer(r.more, np.uint8)
    return out.reshape(LANES, -1)


def _alone(more: np.ndarray, k1: np.ndarray, k2: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether the sketch proves that one conversation alone has the prefix."""
    cells, out = more.shape[1] * 8, np.zeros(len(k1), bool)
    flat = more.reshape(-1)
    for cell in _cells(k1, k2, depth, cells):
        out |= (flat[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1) == 0
    return out


def screened(rows: DataFrame) -> DataFrame:
    """The rows with ``alone`` and ``tail``: the sketch proves that the prefix, and the one before it, has one conversation."""
    shared = rows.sparkSession.sparkContext.broadcast(shared_cells(rows))
    schema = StructType(list(rows.schema.fields)).add("alone", "boolean").add("tail", "boolean")

    def run(batches):
        for batch in batches:
            u = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names) if n in (*_NODE, "p1", "p2")}
            alone = _alone(shared.value, u["k1"], u["k2"], u["depth"])
            tail = (u["depth"] > 0) & _alone(shared.value, u["p1"], u["p2"], u["depth"] - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(tail)], names=schema.names)
    return rows.mapInArrow(run, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, k1, k2, conv_id) to pieces of the nodes' id lists."""
    names = [*_NODE, "first", "ids"]
    node, ids, size = None, [], 0
    full: list[tuple] = []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array([f[i] for f in full], pa.int64()) for i in range(4)] + [pa.array([f[4] for f in full], pa.binary())], names=names)
        full.clear()
        return batch
    for batch in batches:
        for *own, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if ids and (own != node or size > CHUNK):
                full.append((*node, ids[0], ",".join(map(str, ids)).encode()))
                ids, size = [], 0
            node = own
            ids.append(c)
            size += 12
        if len(full) > 1000:
            yield out()
    if ids:
        full.append((*node, ids[0], ",".join(map(str, ids)).encode()))
    yield out()


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one SHA-256 per node; the state is one digest."""
    node, state, done = None, None, []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)] + [pa.array([d[3] for d in done], pa.string())], names=[*_NODE, "ends_sha256"])
        done.clear()
        return batch
    for batch in batches:
        for *own, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if own == node:
                state.update(b"," + ids)
                continue
            if state:
                done.append((*node, state.hexdigest()))
            node, state = own, hashlib.sha256(ids)
        if len(done) > 1000:
            yield out()
    if state:
        done.append((*node, state.hexdigest()))
    yield out()


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of rows (depth, k1, k2, conv_id). The ids are sorted over all tasks; only the digest itself is serial."""
    order = [*_NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth bigint, k1 bigint, k2 bigint, first bigint, ids binary")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digest_ends, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``rebuilt`` conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    place (source, position) of the prefix's last turn in the given conversations.
    """
    rows = cut_lineage(screened(cut_lineage(rows)))
    nothing = F.sha2(F.lit(""), 256)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    own_end = F.when(F.col("length") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing)
    tails = rows.where("tail").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("length") > F.col("depth")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), own_end.alias("ends_sha256"), "source", "position")

    maybe = rows.where("NOT tail")
    nodes = cut_lineage(maybe.groupBy(*_NODE).agg(
        F.min(F.struct("conv_id", "source", "position")).alias("least"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.bool_or("alone").alias("alone"), F.max("length").alias("length")).select("*", "least.*"))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("kids"))
    goes_on = F.col("alone") & (F.col("length") > F.col("depth"))
    nodes = nodes.join(kids, _NODE, "left").withColumn("n_children", F.coalesce("kids", goes_on.cast("bigint")))
    nodes = cut_lineage(nodes.withColumn("save", (F.col("n_convs") - 1) * F.col("n_bytes")).withColumn(
        "leaf", (goes_on | (F.col("n_children") == 0)).cast("bigint")).drop("kids", "least"))

    owners = cut_lineage(nodes.groupBy("conv_id").agg(F.sum("save").alias("total"), F.max("leaf").alias("leaf")))
    of_members = maybe.join(owners.where("total > 0 OR leaf > 0"), "conv_id").groupBy(*_NODE).agg(F.sum("total").alias("all_saved"), F.sum("leaf").alias("n_leaves"))
    below = running(nodes.drop("leaf").withColumn("up", -F.col("depth")), "conv_id", ["up"], ["save"], number="__row")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    ends = ends_digests(maybe.where("depth = length"))
    shared = (below.join(owners.select("conv_id", "total"), "conv_id").join(of_members, _NODE).join(parents, ["depth", "p1", "p2"], "left").join(ends, _NODE, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("all_saved") - F.col("total") + F.col("save_run")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "source", "position"))
    return shared.unionByName(tails)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that each start with some turns of the first of their five (see ``rebuilt``)."""
    turns = cut_lineage(turn_prefixes(conversations))
    return prefix_trie(rebuilt(turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_HEAD + 1), F.col("conv_id") - F.col("conv_id") % BASE_EACH))


def node_texts(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn (null for the root)."""
    turns = running(_plain(conversations), "conv_id", ["turn", "role", "text"], []).select(F.col("conv_id").alias("source"), "position", "role", "text")
    return nodes.join(turns, ["source", "position"], "left")
