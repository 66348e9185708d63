"""Bounded distance between resources, exact and without enumerating the pairs under a hub.

Any path of at most three edges from u to v has a meeting vertex x with d(u,x) <= 1 and
d(x,v) <= 2, or the mirror image. The two-edge side is only walked through a middle vertex
that has no more neighbours than the vertex it leads to; one of the two mirror images always
allows that. A node with p pods is then never the middle of p * p pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOPOLOGY_TYPES = ("SELECTS", "RUNS_ON", "CONTROLS")


def undirected(edges: DataFrame, types=TOPOLOGY_TYPES) -> DataFrame:
    """(client_id, a, b) in both directions, without loops and doubles."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    ends = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.explode(F.array(ends("src", "dst"), ends("dst", "src")))  # one scan gives both directions
    return e.where("src <> dst").select("client_id", both.alias("e")).select("client_id", "e.a", "e.b").distinct()


def balls(edges: DataFrame, k: int = 3, types=TOPOLOGY_TYPES) -> DataFrame:
    """(client_id, rid, x, d): meeting vertices of every resource that has edges."""
    und = undirected(edges, types)
    met = lambda x, d: F.struct(F.col(x).alias("x"), F.lit(d).alias("d"))
    out = und.select("client_id", F.col("a").alias("rid"), F.explode(F.array(met("a", 0), met("b", 1))).alias("m")
                     ).select("client_id", "rid", "m.x", "m.d")
    if k >= 3:
        degree = und.groupBy("client_id", "a").agg(F.count("*").alias("deg"))
        upward = (und.join(degree.withColumnRenamed("deg", "deg_a"), ["client_id", "a"])
                  .join(degree.select("client_id", F.col("a").alias("b"), F.col("deg").alias("deg_b")),
                        ["client_id", "b"])
                  .where(F.struct("deg_a", "a") < F.struct("deg_b", "b")))
        # Edges are kept in the direction of more neighbours before they are joined: a hub among
        # small vertices has no such edge, so nothing is joined below it.
        two = und.select("client_id", F.col("b").alias("rid"), F.col("a").alias("mid")).join(
            upward.select("client_id", F.col("a").alias("mid"), F.col("b").alias("x")),
            ["client_id", "mid"]).where("rid <> x")
        out = out.unionByName(two.select("client_id", "rid", "x", F.lit(2).alias("d")))
    return out.groupBy("client_id", "rid", "x").agg(F.min("d").alias("d"))


def labels(edges: DataFrame, k: int = 3, types=TOPOLOGY_TYPES) -> DataFrame:
    """(client_id, rid, x, d): two resources within ``k`` hops share an ``x``, where their ``d`` add up to their least hops.

    An edge leads up to its end with more neighbours. A resource carries itself, its neighbours up (1 hop), what is one
    edge up of any neighbour (2) and one more edge up of that (3). Of the ends of a path one always climbs to where the
    other one stands or comes down, so a hub does not carry the many small vertices below it, as in :func:`balls`:
    they carry the hub.
    """
    und = undirected(edges, types)
    degree = und.groupBy("client_id", "a").agg(F.count("*").alias("deg"))
    up = (und.join(degree.withColumnRenamed("deg", "deg_a"), ["client_id", "a"])
          .join(degree.select("client_id", F.col("a").alias("b"), F.col("deg").alias("deg_b")), ["client_id", "b"])
          .where(F.struct("deg_a", "a") < F.struct("deg_b", "b")).select("client_id", "a", "b"))
    above = up.select("client_id", F.col("a").alias("mid"), F.col("b").alias("x"))
    out = und.select("client_id", F.col("a").alias("rid"), F.col("a").alias("x"), F.lit(0).alias("d")).unionByName(
        up.select("client_id", F.col("a").alias("rid"), F.col("b").alias("x"), F.lit(1).alias("d")))
    step = und.select("client_id", F.col("a").alias("rid"), F.col("b").alias("mid"))
    for d in range(2, k + 1):
        step = step.join(above, ["client_id", "mid"]).where("rid <> x").select("client_id", "rid", F.col("x").alias("mid")).distinct()
        out = out.unionByName(step.select("client_id", "rid", F.col("mid").alias("x"), F.lit(d).alias("d")))
    return out.groupBy("client_id", "rid", "x").agg(F.min("d").alias("d"))


def twins(und: DataFrame) -> DataFrame:
    """(client_id, rid, twin): resources with the same neighbours in :func:`undirected` edges share a twin, the least of them.

    Twins have equal distances to all others. A neighbour set is known by its size, ends and a 128-bit digest, so that no
    hub's neighbours are put into one row.
    """
    digest = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "b"))
    sets = und.groupBy("client_id", F.col("a").alias("rid")).agg(
        F.count("*").alias("s0"), F.min("b").alias("s1"), F.max("b").alias("s2"), digest("x").alias("s3"), digest("y").alias("s4"))
    keys = ["client_id", "s0", "s1", "s2", "s3", "s4"]
    return sets.join(sets.groupBy(*keys).agg(F.min("rid").alias("twin")), keys).select("client_id", "rid", "twin")


def hops(pairs: DataFrame, edges: DataFrame, k: int = 3, types=TOPOLOGY_TYPES) -> DataFrame:
    """Smallest distance 1..k of the given (client_id, src, dst) pairs; others are left out."""
    if not 1 <= k <= 3:
        raise ValueError("k must be 1, 2 or 3")
    ball = labels(edges, k, types)
    left = pairs.select("client_id", "src", "dst").where("src <> dst").distinct().join(
        ball.select("client_id", F.col("rid").alias("src"), "x", F.col("d").alias("d1")),
        ["client_id", "src"])
    met = left.join(ball.select("client_id", F.col("rid").alias("dst"), "x",
                                F.col("d").alias("d2")), ["client_id", "dst", "x"])
    return (met.withColumn("h", F.col("d1") + F.col("d2")).where(F.col("h").between(1, k))
            .groupBy("client_id", "src", "dst").agg(F.min("h").cast("int").alias("hops")))
