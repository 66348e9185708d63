"""Exact deduplication by Grace hashing.

Every map task first folds its own copies in an open-addressing table and sends each distinct text once, with the
largest doc_id and the number of rows, so a text that makes up a third of all rows costs one record per table.
Spark's shuffle is the first partitioning into spill files. A bucket is then read into an open-addressing table that
compares complete contents; a content that no longer fits the table's budget goes to a local spill file chosen by the
next bits of its hash, and each such file is treated in the same way.

Defined cases: a null text is the empty text; a null doc_id is the smallest; of repeated rows (equal doc_id and text)
each counts in ``group_size`` and one stays; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import one_of_equal, or_least, slices, text_bytes, text_key

#: Bytes of distinct content that one table holds before it is emitted (map side) or spills (bucket side).
TABLE_BYTES = 64 * 1024 * 1024
#: Spill files of one level, and the levels that the 64 hash bits allow.
FAN_BITS, LEVELS = 4, 16

_PARTIAL = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("keep_id", pa.int64()), ("copies", pa.int64())])
_PARTIAL_SQL = "h bigint, content binary, keep_id bigint, copies bigint"


class OpenTable:
    """Open addressing with linear probing; equal hashes are told apart by the complete content."""

    def __init__(self, size: int = 1024):
        self.slots = [-1] * size
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keep: list[int | None] = []
        self.copies: list[int] = []
        self.nbytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """The entry's number (-1: not there) and the slot where the probe ended."""
        mask = len(self.slots) - 1
        slot = h & mask
        while (entry := self.slots[slot]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, slot
            slot = (slot + 1) & mask
        return -1, slot

    def merge(self, entry: int, doc_id: int | None, copies: int) -> None:
        old = self.keep[entry]
        if old is None or (doc_id is not None and doc_id > old):
            self.keep[entry] = doc_id
        self.copies[entry] += copies

    def insert(self, slot: int, h: int, content: bytes, doc_id: int | None, copies: int) -> None:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.keep.append(doc_id)
        self.copies.append(copies)
        self.nbytes += len(content) + 120
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.slots, mask = [-1] * size, size - 1
        for entry, h in enumerate(self.hashes):
            slot = h & mask
            while self.slots[slot] >= 0:
                slot = (slot + 1) & mask
            self.slots[slot] = entry


def _partial(table: OpenTable) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(table.hashes), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 2000], t.type) for c, t in zip(
            (table.hashes, table.contents, table.keep, table.copies), _PARTIAL, strict=True)], schema=_PARTIAL)


def fold_copies(batches: Iterator[pa.RecordBatch], budget: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Map side: rows (h, content, doc_id) to one record per distinct content and filled table."""
    table = OpenTable()
    for batch in slices(batches):
        for h, content, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entry, slot = table.find(h, content)
            if entry >= 0:
                table.merge(entry, doc_id, 1)
            else:
                table.insert(slot, h, content, doc_id, 1)
        if table.nbytes > budget:
            yield from _partial(table)
            table = OpenTable()
    yield from _partial(table)


class _Spill:
    """The spill files of one level: Arrow streams in a folder that goes when the level is done."""

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory()
        self.writers: dict[int, pa.RecordBatchStreamWriter] = {}

    def path(self, part: int) -> str:
        return os.path.join(self.folder.name, str(part))

    def add(self, part: int, rows: list[tuple]) -> None:
        if part not in self.writers:
            self.writers[part] = pa.ipc.new_stream(self.path(part), _PARTIAL)
        self.writers[part].write_batch(pa.RecordBatch.from_arrays(
            [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL))

    def parts(self) -> list[int]:
        for writer in self.writers.values():
            writer.close()
        return sorted(self.writers)

    def read(self, part: int) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(self.path(part)) as reader:
            yield from reader


def grace_groups(batches: Iterator[pa.RecordBatch], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[OpenTable]:
    """Bucket side: tables of complete groups. What does not fit is partitioned by the next hash bits and treated alike."""
    table, spill, full = OpenTable(), None, False
    try:
        for batch in slices(batches):
            away: dict[int, list[tuple]] = {}
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, content, doc_id, copies = row
                entry, slot = table.find(h, content)
                if entry >= 0:
                    table.merge(entry, doc_id, copies)
                elif full:
                    away.setdefault(h >> (FAN_BITS * level) & (1 << FAN_BITS) - 1, []).append(row)
                else:
                    table.insert(slot, h, content, doc_id, copies)
                    full = table.nbytes > budget and level < LEVELS
            for part, rows in away.items():
                spill = spill or _Spill()
                spill.add(part, rows)
        yield table
        table = None
        for part in spill.parts() if spill else []:
            yield from grace_groups(spill.read(part), budget, level + 1)
    finally:
        if spill:
            spill.folder.cleanup()


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (largest doc_id) and group_size."""
    rows = docs.select(text_key(text_col).alias("h"), text_bytes(text_col).alias("content"), F.col(id_col).cast("bigint").alias("doc_id"))
    schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def buckets(batches):
        for table in grace_groups(batches, budget):
            digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
            for i in range(0, len(digests), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 10_000], t.type) for c, t in zip(
                    (digests, table.keep, table.copies), schema, strict=True)], schema=schema)

    return (rows.mapInArrow(lambda batches: fold_copies(batches, budget), _PARTIAL_SQL).repartition("h")
            .mapInArrow(buckets, "text_sha256 string, keep_id bigint, group_size bigint"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows meet their group on the digest of the content; that join is a plain sort-merge join, whose hot keys AQE splits.
    """
    groups = equal_groups(docs, id_col, text_col)
    rows = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(text_bytes(text_col), 256).alias("text_sha256"))
            .groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times")))
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of repeated rows the first by the hash of their other columns stays."""
    groups = equal_groups(docs, id_col, text_col).select("text_sha256", or_least("keep_id").alias("keep_id"))
    plain = [f"`{f.name}`" for f in docs.schema.fields if f.name not in (id_col, text_col) and "map" not in f.dataType.simpleString()]
    rows = docs.select(
        F.struct("*").alias("row"), or_least(id_col).alias("keep_id"), F.sha2(text_bytes(text_col), 256).alias("text_sha256"),
        F.xxhash64(*plain, F.lit(0)).alias("tie"))
    kept = rows.join(groups, ["text_sha256", "keep_id"], "left_semi")  # the window below reuses this partitioning
    return one_of_equal(kept, ["text_sha256", "keep_id"], [F.col("tie")]).select("row.*")
