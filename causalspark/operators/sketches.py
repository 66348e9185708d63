"""Quantiles and distinct counts from sketches that are stored by slice and merged by reports.

A store has one row per key and time slice, with a quantile sketch, a distinct sketch and a count. Reports merge stored
rows and never read the values again; new values are sketched on their own and merged into the slices they fall in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalspark.functions.scalar import MINUTE_US

QUANTILE_K = 800
DISTINCT_LG_K = 12
# Rank error of a quantile sketch of that size (99 % of the queries) and three standard errors of the
# distinct sketch, both with room for merges.
RANK_ERROR = 0.01
DISTINCT_ERROR = 0.05


def build(values: DataFrame, keys: list[str], slice_min: int = 60) -> DataFrame:
    """Store of values (keys, t, value, item): keys, slice, n, quantiles, items.

    A null value or item counts in ``n`` only; rows without a time share the null slice. Both sketches combine in the
    map tasks, so a hot key costs one row per task and slice.
    """
    slot = F.floor(F.col("t") / (slice_min * MINUTE_US)).cast("long")
    return values.groupBy(*keys, slot.alias("slice")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("value").cast("double"), QUANTILE_K).alias("quantiles"),
        F.hll_sketch_agg(F.col("item").cast("string"), DISTINCT_LG_K).alias("items"))


def merge(store: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows merged to coarser keys: keys, n, quantiles, items."""
    return store.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles", QUANTILE_K).alias("quantiles"),
                                    F.hll_union_agg("items").alias("items"))


def add(store: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the rows of ``fresh`` (a store of new values) merged in; other slices keep their sketches."""
    return merge(store.unionByName(fresh), [*keys, "slice"])


def quantile(p: float) -> Column:
    """Value of rank ``p`` (0 to 1), null for a sketch without values."""
    filled = F.kll_sketch_get_n_double("quantiles") > 0
    return F.when(filled, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))))


def distinct() -> Column:
    return F.hll_sketch_estimate("items")


def percentiles(store: DataFrame, keys: list[str], ps=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """keys, n, one column ``p50``... per rank, and ``items``: the approximate number of distinct items."""
    name = lambda p: "p" + f"{p * 100:g}".replace(".", "_")
    return merge(store, keys).select(*keys, "n", *[quantile(p).alias(name(p)) for p in ps], distinct().alias("items"))


def rank_errors(values: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """How far estimates (keys, p, estimate) are from their rank among the values: keys, p, n, error.

    The rank of an estimate is an interval where values repeat; the error is 0 inside it.
    """
    rows = values.where("value IS NOT NULL").join(estimates, keys)
    below, upto = (F.count(F.when(c, 1)) for c in (F.col("value") < F.col("estimate"), F.col("value") <= F.col("estimate")))
    ranks = rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), (below / F.count("*")).alias("low"), (upto / F.count("*")).alias("high"))
    return ranks.select(*keys, "p", "n", F.greatest(F.lit(0.0), F.col("low") - F.col("p"), F.col("p") - F.col("high")).alias("error"))
