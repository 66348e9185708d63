"""Token ids packed into rows of fixed length: best fit, decreasing, with a segment tree over free room.

Texts are encoded to ids. A document longer than a row is cut into pieces of the row's length and one rest, so nothing is
lost. The pieces are packed in lots: a lot is a run of one input partition, of about ``lot_tokens`` ids. In a lot the
longest piece goes first, into the fullest row that still has room; a segment tree whose leaves are the amounts of free
room (0 to the row's length) finds that row in log2(length) steps. No shuffle is needed, and a lost task redoes its lots.

A packed row has the ids (``input_ids``, little-endian, 16 or 32 bits by the vocabulary, padded), the cumulative segment
lengths (``cu_seqlens``: 0, then the end of each segment), the places where positions restart at 0 (``resets``) and, for
each segment, its document and the id offset in it. ``position_ids`` and ``id_matrix`` give the dense forms.

Defined cases: null and empty texts have no ids and so one segment of length 0 on the row where it fits; a null doc_id
stays null; repeated rows are packed each; an empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import slices
from causalspark.llm.segments import BYTE_BPE, BYTE_BPE_CUT, Segments, byte_bpe, once

#: Ids in a row, ids in a lot, and the id that fills a row's end (free in the vocabulary).
ROW_LENGTH, LOT_TOKENS, PAD = 2048, 2_000_000, 50256

SCHEMA = ("lot string, row int, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, resets array<int>, "
          "doc_ids array<bigint>, doc_offsets array<bigint>")


class FreeRoom:
    """Open rows by free room: a segment tree over 0..capacity with the number of rows below each node."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need`` (the latest of equals), taken out; None if there is none."""
        count, node = self.count, need + self.size
        if not count[node]:  # climb until a right neighbour has rows, then go down to its leftmost leaf
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers. Equal lengths go in the order given."""
    free, rows = FreeRoom(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[piece])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        free.add(room - lengths[piece], row)
    return rows


class Encoder:
    """Text to ids with a memory of encoded stretches; a stretch ends before white space that follows other text."""

    def __init__(self, path: str = BYTE_BPE):
        coding = byte_bpe(path)
        self.dtype = np.dtype("<u2" if coding.n_vocab <= 1 << 16 else "<u4")
        self.known = Segments(lambda s: np.array(coding.encode_ordinary(s), self.dtype).tobytes())

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, BYTE_BPE_CUT(text))), self.dtype)


def encoder(path: str = BYTE_BPE) -> Encoder:
    return once(("encoder", path), lambda: Encoder(path))


def pack_lot(name: str, docs: list[tuple], length: int, pad: int, dtype) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, ids) pairs."""
    pieces = [(d, at, ids[at:at + length]) for d, ids in docs for at in range(0, max(1, len(ids)), length)]
    for number, row in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], length)):
        out, ends, at = np.full(length, pad, dtype), [0], 0
        for i in row:
            ids = pieces[i][2]
            out[at:at + len(ids)] = ids
            at += len(ids)
            ends.append(at)
        yield (name, number, at, len(row), out.tobytes(), ends, ends[:-1], [pieces[i][0] for i in row], [pieces[i][1] for i in row])


def packed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = ROW_LENGTH, tokenizer: str = BYTE_BPE,
                pad: int = PAD, lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """The packed rows (columns of SCHEMA) of all documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        from pyspark import TaskContext
        encode, part, lots = encoder(tokenizer), TaskContext.get().partitionId(), 0
        waiting, tokens = [], 0

        def flush():
            rows = list(pack_lot(f"{part}-{lots}", waiting, length, pad, encode.dtype))
            for i in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + 500], strict=True), schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text)
                waiting.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= lot_tokens or len(waiting) >= lot_tokens:
                    yield from flush()
                    lots, waiting, tokens = lots + 1, [], 0
        if waiting:
            yield from flush()
    return docs.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, SCHEMA)


def id_matrix(rows: list[bytes], dtype="<u2") -> np.ndarray:
    """The ids of packed rows as a matrix."""
    return np.stack([np.frombuffer(r, dtype) for r in rows])


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions of a row: they restart at each segment and at the padding."""
    ends = np.array([*cu_seqlens, length])
    return np.arange(length) - np.repeat(ends[:-1], np.diff(ends))


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, the id rows as fixed-length binary values."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """doc_id, doc_offset, ids: the segments of packed rows."""
    def run(batches):
        dtype = encoder(tokenizer).dtype
        schema = pa.schema([("doc_id", pa.int64()), ("doc_offset", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in slices(batches):
            out = []
            for ids, ends, docs, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = np.frombuffer(ids, dtype)
                out += [(d, o, row[s:e].tolist()) for d, o, s, e in zip(docs, offsets, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 3, schema, strict=True)], schema=schema)
    return packed.select("input_ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(run, "doc_id bigint, doc_offset bigint, ids array<int>")
