"""Connected components of a link table, as a loop of joins with a short lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.session import cut_lineage

#: Rounds after which the loop gives up with an error; hooking and jumping need a few times log2 of the nodes.
MAX_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of 64-bit nodes to ``(node, root)``: the smallest node of each component.

    Each round sends both ends' roots over every link, to the ends and to their roots (hooking), then replaces a root by
    its own root (jumping). Messages are minima, so they combine in the map tasks; the joins read checkpointed tables on
    both sides, so AQE may split a node with very many links. Every round's table is a checkpoint in the shared folder.
    """
    both = links.where("a <> b").select("a", "b").distinct()
    both = cut_lineage(both)
    roots = both.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    roots = cut_lineage(roots)
    for _ in range(MAX_ROUNDS):
        ra = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
        rb = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        ends = both.join(ra, "a").join(rb, "b").where("x <> y")
        told = ends.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("y").alias("less")), F.struct(F.col("b").alias("node"), F.col("x").alias("less")),
            F.struct(F.col("x").alias("node"), F.col("y").alias("less")), F.struct(F.col("y").alias("node"), F.col("x").alias("less")),
        )).alias("m")).select("m.*").where("less < node").groupBy("node").agg(F.min("less").alias("less"))
        hooked = cut_lineage(roots.join(told, "node", "left").select(
            "node", F.least("root", F.coalesce("less", "root")).alias("root"), F.col("less").isNotNull().alias("told")))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = cut_lineage(hooked.join(up, "root").select("node", F.least("root", "above").alias("root"), "told", (F.col("above") < F.col("root")).alias("moved")))
        roots = jumped.select("node", "root")
        if not jumped.where("told or moved").limit(1).count():
            return roots
    raise RuntimeError("components: no fixed point")
