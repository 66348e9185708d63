"""Running numbers and sums of one key's rows over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.session import cut_lineage


def _last_runs(batches: Iterator[pa.RecordBatch], n_sums: int) -> Iterator[pa.RecordBatch]:
    """One row per partition: its number, first key, last key, and the count and sums of the last key's rows."""
    part = first = last = None
    run = [0] * (1 + n_sums)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(1).to_numpy()
        if part is None:
            part, first = batch.column(0)[0].as_py(), int(keys[0])
        start = len(keys) - int(np.argmax(np.r_[keys[::-1] != keys[-1], True]))
        if start or last != keys[-1]:
            run = [0] * len(run)
        last = int(keys[-1])
        run[0] += len(keys) - start
        for i in range(n_sums):
            run[i + 1] = (run[i + 1] + int(batch.column(i + 2).to_numpy()[start:].view(np.uint64).sum(dtype=np.uint64))) % (1 << 64)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([last], pa.int64()),
                                          pa.array([np.array(run, np.uint64).view(np.int64).tolist()], pa.list_(pa.int64()))], names=["part", "first", "last", "run"])


def _carries(rows: list) -> dict[int, tuple[int, list[int]]]:
    """For each partition that goes on with the key of the one before: the key and what earlier partitions have of it."""
    out, key, run = {}, None, []
    for r in sorted(rows, key=lambda r: r.part):
        own = [x % (1 << 64) for x in r.run]
        if key == r.first:
            out[r.part] = (key, run)
            if r.first == r.last:
                own = [(a + b) % (1 << 64) for a, b in zip(run, own, strict=True)]
        key, run = r.last, own
    return out


def _number(batches: Iterator[pa.RecordBatch], carries: dict, sums: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    key, run = None, []
    for i, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        if key is None:
            key, run = carries.get(batch.column(0)[0].as_py(), (None, [0] * (1 + len(sums))))
        keys = batch.column(1).to_numpy()
        new = np.r_[keys[0] != key, keys[1:] != keys[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        inherits = (np.cumsum(new) == 0)
        values = [np.ones(len(keys), np.uint64), *(batch.column(c).to_numpy().view(np.uint64) for c in sums)]
        out = []
        for value, before in zip(values, run, strict=True):
            total = np.cumsum(value, dtype=np.uint64)
            own = total - (total - value)[first]
            own[inherits] = total[inherits] + np.uint64(before)
            out.append(own)
        key, run = int(keys[-1]), [int(x[-1]) for x in out]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x.view(np.int64)) for x in out)], names=names)


def running(df: DataFrame, key: str, order: list, sums: list[str], number: str = "position", shape=None) -> DataFrame:
    """Adds the row's number (from 1) and the running sums (named ``<name>_run``, wrapping at 64 bits) of its key's rows in ``order``.

    The rows are sorted over all tasks by key and order, so a key with very many rows spreads over tasks; what the
    partitions before hold of a partition's first key (one row per partition on the driver) is then added.
    ``shape`` may narrow the sorted rows before they are stored; all columns left but the sums and the key may have any type.
    """
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = shape(rows) if shape else rows
    rows = cut_lineage(rows.select(F.spark_partition_id().alias("__part"), key, *sums, *[c for c in rows.columns if c not in (key, *sums)]))
    last = rows.select("__part", key, *sums).mapInArrow(lambda b: _last_runs(b, len(sums)), "part int, first bigint, last bigint, run array<bigint>")
    carries = _carries(last.collect())
    schema = rows.drop("__part").schema.add(number, "long")
    for s in sums:
        schema = schema.add(f"{s}_run", "long")
    places = [rows.columns.index(s) for s in sums]
    return rows.mapInArrow(lambda b: _number(b, carries, places, schema.names), schema)
