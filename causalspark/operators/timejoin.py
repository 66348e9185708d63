"""Joins and windows over time that never gather a whole key in one task.

Every helper cuts the time line into slices and works on (key, slice) groups, so a key that
holds a third of all rows is still spread over as many groups as it has slices.
Times are epoch microseconds in a column ``t`` (``c_t`` for causes, ``e_t`` for effects).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slice_of(t: Column, width_us: int) -> Column:
    return F.floor(t / F.lit(width_us)).cast("long")


def range_join(causes: DataFrame, effects: DataFrame, keys: list[str], width_us: int,
               condition: Column | None = None, keep_slice: bool = False) -> DataFrame:
    """Pairs with equal keys and ``0 <= e_t - c_t <= width_us``, each exactly once.

    A cause lives in one slice; an effect probes its own slice and the one before. With ``keep_slice`` the cause's slice
    stays as ``_slice``: what is grouped by the keys, the slice and the cause is then grouped where the pairs are formed.
    """
    width_us = max(int(width_us), 1)
    c = causes.withColumn("_slice", slice_of(F.col("c_t"), width_us))
    own = slice_of(F.col("e_t"), width_us)
    e = effects.withColumn("_slice", F.explode(F.array(own - 1, own)))
    gap = F.col("e_t") - F.col("c_t")
    residual = (gap >= 0) & (gap <= width_us)
    if condition is not None:
        residual = residual & condition
    pairs = c.join(e, keys + ["_slice"]).where(residual)
    return pairs if keep_slice else pairs.drop("_slice")


def near_join(left: DataFrame, right: DataFrame, keys: list[str], width_us: int,
              condition: Column | None = None) -> DataFrame:
    """Pairs with equal keys and ``|c_t - e_t| <= width_us``."""
    c = left.withColumn("_slice", slice_of(F.col("c_t"), width_us))
    own = slice_of(F.col("e_t"), width_us)
    e = right.withColumn("_slice", F.explode(F.array(own - 1, own, own + 1)))
    residual = F.abs(F.col("e_t") - F.col("c_t")) <= width_us
    if condition is not None:
        residual = residual & condition
    return c.join(e, keys + ["_slice"]).where(residual).drop("_slice")


_MERGE = {
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "set": (F.collect_set, F.array_union),
}


def sliding(df: DataFrame, keys: list[str], before_us: int, after_us: int,
            aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add aggregates over the rows with the same keys in ``[t - before, t + after]``.

    ``aggs`` name a kind (count, max, set) and the value, whose nulls do not count. With slices
    as wide as the window, a window is the end of one slice and the start of the next, so two
    growing frames per slice, one from each side, give all of it: the work is linear however
    many rows a window has.
    """
    width = max(before_us + after_us, 1)
    values = {f"_v{i}": value for i, (_, value) in enumerate(aggs.values())}
    events = df.select(*keys, slice_of(F.col("t"), width).alias("_slice"), F.col("t").alias("_at"),
                       F.lit(0).alias("_probe"), *[v.alias(c) for c, v in values.items()])
    first = slice_of(F.col("t") - before_us, width)

    def growing(probes: DataFrame, latest_first: bool, prefix: str) -> DataFrame:
        at = F.desc("_at") if latest_first else F.asc("_at")
        w = W.partitionBy(*keys, "_slice").orderBy(at, "_probe").rowsBetween(W.unboundedPreceding, 0)
        both = events.unionByName(probes, allowMissingColumns=True)
        for i, (kind, _) in enumerate(aggs.values()):
            both = both.withColumn(f"{prefix}{i}", _MERGE[kind][0](f"_v{i}").over(w))
        return both.where("_probe = 1")

    probes = df.select(*keys, (first + 1).alias("_slice"), (F.col("t") + after_us).alias("_at"), F.lit(1).alias("_probe"), F.struct("*").alias("_row"))
    starts = growing(probes, False, "_s")
    probes = starts.select(*keys, (F.col("_slice") - 1).alias("_slice"), (F.col("_at") - (before_us + after_us)).alias("_at"), "_probe", "_row",
                           *[f"_s{i}" for i in range(len(aggs))])
    ends = growing(probes, True, "_e")
    return ends.select("_row.*", *[_MERGE[kind][1](F.col(f"_e{i}"), F.col(f"_s{i}")).alias(name)
                                   for i, (name, (kind, _)) in enumerate(aggs.items())])


def islands(df: DataFrame, keys: list[str], gap_us: int, aggs: dict[str, Column]) -> DataFrame:
    """Sessions: rows of one key whose gaps are at most ``gap_us`` share an ``island`` start.

    Rows are first summed per (key, slice of one gap): rows inside such a slice always belong
    together, so the ordered pass sees one row per slice and not one row per event.
    ``aggs`` name partial aggregates per slice; the result has one row per (keys, slice).
    """
    sliced = df.withColumn("_slice", slice_of(F.col("t"), gap_us)).groupBy(*keys, "_slice").agg(
        F.min("t").alias("_first"), F.max("t").alias("_last"),
        *[agg.alias(name) for name, agg in aggs.items()])
    w = W.partitionBy(*keys).orderBy("_slice")
    starts = sliced.withColumn("_new", F.when(
        F.col("_first") - F.lag("_last").over(w) <= gap_us, 0).otherwise(1))
    return starts.withColumn("island", F.max(F.when(F.col("_new") == 1, F.col("_first")))
                             .over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def numbered(df: DataFrame, keys: list[str], order: list, width_us: int,
             name: str = "position") -> DataFrame:
    """Running number of the rows of a key by time, counted slice by slice."""
    rows = df.withColumn("_slice", slice_of(F.col("t"), width_us))
    offsets = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (rows.withColumn("_row", F.row_number().over(inside))
            .join(offsets, keys + ["_slice"])
            .withColumn(name, (F.col("_row") + F.col("_offset")).cast("long"))
            .drop("_row", "_offset", "_slice"))


def top_per(df: DataFrame, keys: list[str], order: list, limit: int, offset: int = 0) -> DataFrame:
    """The rows at places ``offset + 1 .. offset + limit`` of every key. The rank filter is also
    applied before the shuffle, so a large key sends only its best rows of each task."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(
        (F.col("_place") > offset) & (F.col("_place") <= offset + limit)).drop("_place")


def latest(df: DataFrame, as_of=None) -> Column:
    """Explicit ``as_of`` micros, or the newest time of the frame as a scalar subquery."""
    return F.lit(as_of) if as_of is not None else df.select(F.max("t")).scalar()


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                  width_us: int) -> DataFrame:
    """Add ``prev_<value>`` of the row before, per key, worked out slice by slice.

    ``order`` starts with ``t``. The first row of a slice takes the last row of the slice
    before it, which is found on one row per slice.
    """
    rows = df.withColumn("_slice", slice_of(F.col("t"), width_us))
    tail = rows.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"))
    tail = tail.withColumn("_before", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_slice")))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    out = rows.withColumn("_prev", F.lag(F.struct(*values)).over(inside)).join(
        tail.select(*keys, "_slice", "_before"), keys + ["_slice"])
    prev = F.coalesce("_prev", "_before")
    for value in values:
        out = out.withColumn(f"prev_{value}", prev[value])
    return out.drop("_slice", "_prev", "_before")
