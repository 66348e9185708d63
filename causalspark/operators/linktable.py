"""The stored link table: partitioned by tenant and day of the effect, rebuilt only where a change can reach.

A link depends on its two events and on the distance between their resources. So an event that came, changed or went
can alter the links into effects of its own time and of one window later; an edge that came or went can alter those
into effects on resources within two hops of its ends, in the graph before or after. All other partitions stay as
they are on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import DAY_US, MINUTE_US
from causalspark.operators import reach
from causalspark.operators.causality import build_causality
from causalspark.session import cut_lineage

WINDOW_US = R.ADAPTIVE_WINDOW_MAX * MINUTE_US
SLICE = ["client_id", "day"]
SCHEMA = ("cause string, effect string, hops int, temporal_score double, distance_score double, domain_score double, confidence double, "
          "time_gap_seconds long, rank int, client_id string, day long")


def day_of(t: Column) -> Column:
    return F.floor(t / F.lit(DAY_US)).cast("long")


def slices_of_events(events: DataFrame) -> DataFrame:
    """Slices whose links the given events can alter, as effects or as causes."""
    t = F.col("t")
    return events.select("client_id", F.explode(F.array_distinct(F.array(day_of(t), day_of(t + WINDOW_US)))).alias("day")).distinct()


def changed_ends(before: DataFrame, after: DataFrame) -> DataFrame:
    """(client_id, rid) of edges that only one of the two graphs has."""
    a, b = reach.undirected(before), reach.undirected(after)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("client_id", F.col("a").alias("rid")).distinct()


def slices_of_edges(before: DataFrame, after: DataFrame, episodes: DataFrame) -> DataFrame:
    """Slices with an effect within two hops of a changed edge. Vertices are walked, not pairs, so a hub adds its neighbours once."""
    both = reach.undirected(before).unionByName(reach.undirected(after)).distinct()
    near = changed_ends(before, after)
    for _ in range(2):
        step = both.join(near.withColumnRenamed("rid", "a"), ["client_id", "a"]).select("client_id", F.col("b").alias("rid"))
        near = near.unionByName(step).distinct()
    return episodes.join(near, ["client_id", "rid"], "left_semi").select("client_id", day_of(F.col("t")).alias("day")).distinct()


def rebuild(path: str, episodes: DataFrame, edges: DataFrame, slices: DataFrame | None = None, **build) -> DataFrame:
    """Writes the given slices (all, if left out) of the link table anew and returns them.

    Causes are read one window beyond a slice. A slice left without links keeps an empty marker row, so that its old
    links go. Writing the same slices again gives the same files' content: a repeated run changes nothing.
    """
    dated = episodes.withColumn("day", day_of(F.col("t")))
    slices = cut_lineage(dated.select(*SLICE).distinct() if slices is None else slices.select(*SLICE).distinct())
    effects = dated.join(slices, SLICE, "left_semi")
    eve = dated.where(day_of(F.col("t") + WINDOW_US) > F.col("day")).join(
        slices.select("client_id", (F.col("day") - 1).alias("day")), SLICE, "left_semi").join(slices, SLICE, "left_anti")
    links = build_causality(effects.unionByName(eve).drop("day"), edges, effects=effects.drop("day"), **build)
    day = effects.select("client_id", F.col("eid").alias("effect"), "day")
    rows = links.join(day, ["client_id", "effect"]).unionByName(slices, allowMissingColumns=True)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows.select(*columns).hint("rebalance", *SLICE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SLICE).parquet(path)
    return slices


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where("effect IS NOT NULL")


def apply_changes(path: str, episodes: DataFrame, edges: DataFrame, events: DataFrame | None = None, edges_before: DataFrame | None = None, **build) -> DataFrame:
    """Repairs the link table after ``events`` came, changed or went and the graph was ``edges_before``; returns the slices written."""
    parts = [slices_of_events(events)] if events is not None else []
    parts += [slices_of_edges(edges_before, edges, episodes)] if edges_before is not None else []
    slices = parts[0].unionByName(parts[-1]).distinct()
    return rebuild(path, episodes, edges, slices, **build)
