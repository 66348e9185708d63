"""A stored vector index: inverted lists under trained centroids, grown by batches, searched without loss.

A vector goes to the list of its nearest centroid and, by its angle to that centroid, to a ring of the list. By the
triangle inequality of angles no vector of a ring can be nearer to a query than the ring's edge is, so each cell
(list, ring) has a highest similarity that it can hold for a query. A search first reads the cells of a query's nearest lists,
which gives the similarity its k-th best match has at least, and then every other cell that could still hold a better
one. On clustered vectors few cells are left; on vectors without clusters no cell is excluded and all are read, so
the matches are those of an exact search at any rate.

The centroids are fitted on at most ``TRAIN_ROWS`` vectors; every vector is indexed. They stay as they are when
batches come, and are trained anew only with a new index; an index made from an empty table is trained on its first batch.

Defined cases: rows with a null id or vector are left out, a zero vector has similarity zero to all, of rows of one
batch with equal ids the one with the least hash stays, ids that other batches hold are not added again, further
columns are stored (their names must not be those of ``OWN``). All vectors of an index have the same length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.operators.search import _normalized
from causalspark.session import cut_lineage

TRAIN_ROWS = 16_384
LISTS_MAX = 1_024
ROUNDS = 10
RING = np.pi / 48
SHELF = 16
BLOCK_ROWS = 4_096
PROBES = 2
OWN = ("list", "ring", "shelf", "angle", "batch", "cell")
MATCHES = "query_id long, item_id long, similarity double"


def train(path: str, vectors: DataFrame, lists: int | None = None) -> None:
    """Fits the centroids (spherical k-means on a hashed sample) and writes them under ``path``.

    The number of lists is the root of the number of vectors, at most ``LISTS_MAX``, unless given.
    """
    known = vectors.where("id IS NOT NULL AND vec IS NOT NULL")
    lists = min(LISTS_MAX, lists or max(1, int(known.count() ** 0.5)))
    sample = known.select("id", "vec").orderBy(F.xxhash64("id", "vec"), "id").limit(TRAIN_ROWS).toPandas()
    x = _normalized(sample["vec"]) if len(sample) else np.zeros((0, 1))
    centres = np.unique(x[:lists], axis=0)
    for _ in range(ROUNDS if len(x) else 0):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.where(norm > 1e-9, norm, 1.0), centres)
    spark = vectors.sparkSession
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    """At most ``LISTS_MAX`` rows."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 1))


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _batches(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """Rows or cells of all batches; None before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.option("basePath", f"{path}/{part}").parquet(f"{path}/{part}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The indexed rows. A batch counts once its cells are written, after its rows."""
    rows, cells = _batches(spark, path, "rows"), _batches(spark, path, "cells")
    return rows.join(F.broadcast(cells.select("batch").distinct()), "batch", "left_semi")


def append(path: str, vectors: DataFrame, batch: int) -> None:
    """Adds the vectors whose id no other batch holds. A repeated batch is written anew, so a retry changes nothing."""
    spark = vectors.sparkSession
    if not len(_centres(spark, path)):
        train(path, vectors)
    centres = _centres(spark, path)
    columns = [c for c in vectors.columns if c not in ("id", "vec")]
    assert not set(columns) & set(OWN), columns
    new = vectors.where("id IS NOT NULL AND vec IS NOT NULL")
    if _batches(spark, path, "cells") is not None:
        new = new.join(read(spark, path).where(F.col("batch") != batch).select("id"), "id", "left_anti")
    new = new.groupBy("id").agg(F.min_by(F.struct("vec", *columns), F.xxhash64("vec", *columns)).alias("row")).select("id", "row.*")

    def place(frames):
        for pdf in frames:
            if len(pdf) and len(centres):
                angle = _angles(_normalized(pdf["vec"]), centres)
                home = angle.argmin(axis=1)
                near = angle[np.arange(len(pdf)), home]
                yield pdf.assign(list=home.astype("int32"), angle=near, ring=(near / RING).astype("int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
    placed = new.mapInPandas(place, f"{fields}, list int, angle double, ring int").withColumn("shelf", F.floor(F.col("list") / SHELF).cast("int"))
    rows = f"{path}/rows/batch={int(batch)}"
    (placed.repartitionByRange(F.col("list"), F.col("ring"), F.xxhash64("id")).sortWithinPartitions("list", "ring")
     .write.mode("overwrite").partitionBy("shelf").parquet(rows))
    written = spark.read.schema(placed.schema).parquet(rows)
    if written.isEmpty():  # a file without rows, so that the columns can be read
        placed.limit(0).drop("shelf").coalesce(1).write.parquet(f"{rows}/shelf=0")
    (written.groupBy("list", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells/batch={int(batch)}"))


def _cells(spark: SparkSession, path: str, block_rows: int) -> pd.DataFrame:
    """(list, ring, n, low, high, page) over all batches: at most lists times rings (1,024 times 49) rows.

    Neighbouring cells make a page of about ``block_rows`` rows, so that a query is sent to pages, not to each small cell.
    """
    found = _batches(spark, path, "cells").groupBy("list", "ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    cells = found.orderBy("list", "ring").toPandas()
    return cells.assign(page=((cells["n"].cumsum() - cells["n"]) // block_rows).astype("int64"))


def _ask(queries: DataFrame, centres: np.ndarray, cells: pd.DataFrame, min_sim: float, probes: int, first: bool) -> DataFrame:
    """(query_id, vec, page, cells): cells of the nearest lists, or else the others that can hold a match of at least ``floor``."""
    lists, low, high, pages = (cells[c].to_numpy() for c in ("list", "low", "high", "page"))
    filled = np.unique(lists)
    # so many queries at once that neither the bounds nor the copies of the vectors grow large
    width = len(cells) + len(np.unique(pages)) * centres.shape[1]
    step = max(1, 500_000 // max(1, width))

    def ask(frames):
        for pdf in frames:
            for start in range(0, len(pdf) if len(cells) else 0, step):
                part = pdf.iloc[start:start + step]
                angle = _angles(_normalized(part["vec"]), centres)
                order = filled[np.argsort(angle[:, filled], axis=1, kind="stable")[:, :probes]]
                near = np.zeros(angle.shape, dtype=bool)
                np.put_along_axis(near, order, True, axis=1)
                gap = np.maximum(0.0, np.maximum(angle[:, lists] - high, low - angle[:, lists]))
                bound = np.cos(np.minimum(gap, np.pi))
                floor = np.full(len(part), min_sim) if first else np.maximum(min_sim, part["floor"].fillna(-1.0).to_numpy())
                wanted = (near if first else ~near)[:, lists] & (bound >= floor[:, None] - 1e-7)
                i, j = np.nonzero(wanted)
                if len(i):
                    starts = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(pages[j]) != 0)])
                    yield pd.DataFrame({"query_id": part["id"].to_numpy()[i[starts]], "vec": part["vec"].to_numpy()[i[starts]],
                                        "page": pages[j[starts]], "cells": np.split(j.astype("int32"), starts[1:])})

    return queries.mapInPandas(ask, "query_id long, vec array<double>, page long, cells array<int>")


def _k_best(names, items, sims, k: int) -> pd.DataFrame:
    """The ``k`` best of each name, equal similarities by item."""
    order = np.lexsort((items, -sims, names))
    names, items, sims = names[order], items[order], sims[order]
    place = np.arange(len(names)) - np.searchsorted(names, names)
    keep = place < k
    return pd.DataFrame({"query_id": names[keep], "item_id": items[keep], "similarity": sims[keep]})


def _compare(asked: DataFrame, rows: DataFrame, cells: pd.DataFrame, k: int, min_sim: float, block_rows: int) -> DataFrame:
    """The k best of each asked (query, part of a page), its asked cells only: both sides of a task have about ``block_rows`` rows."""
    spark = asked.sparkSession
    counts = {r["page"]: r["n"] for r in asked.groupBy("page").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], MATCHES)
    blocks = lambda n: int(-(-n // block_rows))
    used = cells[cells["page"].isin(list(counts))]
    sizes = used.groupby("page")["n"].sum()
    plan = F.broadcast(spark.createDataFrame([(int(p), blocks(sizes[p]), blocks(counts[p])) for p in sizes.index], "page long, parts int, query_parts int"))
    where = F.broadcast(spark.createDataFrame([(int(c), int(r.list), int(r.ring), int(r.page)) for c, r in zip(used.index, used.itertuples())],
                                              "c int, list int, ring int, page long"))
    shelves = sorted({int(n) // SHELF for n in used["list"]})
    block = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    left = asked.join(plan, "page").select("query_id", "vec", "cells", "page", block("query_id", "query_parts").alias("qb"),
                                           F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("ib"))
    right = rows.where(F.col("shelf").isin(shelves)).select("id", F.col("vec").alias("item"), "list", "ring").join(where, ["list", "ring"]).join(plan, "page").select(
        "id", "item", "c", F.col("page").alias("p"), block("id", "parts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("q"))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            x, y = _normalized(a["vec"]), _normalized(b["item"])
            names, items = a["query_id"].to_numpy(), b["id"].to_numpy()
            cell, owner = np.concatenate(a["cells"].tolist()), np.repeat(np.arange(len(a)), a["cells"].map(len))
            order = np.argsort(cell, kind="stable")
            cell, owner = cell[order], owner[order]
            at = np.argsort(b["c"].to_numpy(), kind="stable")
            here, starts = np.unique(b["c"].to_numpy()[at], return_index=True)
            for c, members in zip(here, np.split(at, starts[1:])):
                asking = owner[np.searchsorted(cell, c):np.searchsorted(cell, c, "right")]
                for start in range(0, len(asking), 256):
                    part = asking[start:start + 256]
                    sims = np.round(x[part] @ y[members].T, 12)
                    i, j = np.nonzero((sims >= min_sim) & (names[part][:, None] != items[members][None, :]))
                    found.append(_k_best(names[part][i], items[members][j], sims[i, j], k))
        if not found:
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        every = pd.concat(found)
        return _k_best(*(every[c].to_numpy() for c in ("query_id", "item_id", "similarity")), k)

    return left.groupBy("page", "qb", "ib").cogroup(right.groupBy("p", "q", "i")).applyInPandas(match, MATCHES)


def _best(matches: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(path: str, queries: DataFrame, k: int = 10, min_sim: float = 0.6, keep: Column | None = None, probes: int = PROBES,
           block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` indexed rows of each query (id, vec) with at least ``min_sim``, and what was read for them.

    Matches: query_id, item_id, similarity, rank; equal similarities by item id; a row is no match of the query with its own id.
    Reads: query_id, cells (of the index), near_cells and far_cells (read first, and after the bound), rows_read, rows.
    ``keep`` is a condition on stored columns, put to the scan before anything is compared. Query ids are distinct;
    queries without id or vector have no rows in either result.
    """
    spark = queries.sparkSession
    centres, cells, rows = _centres(spark, path), _cells(spark, path, block_rows), read(spark, path)
    rows = rows if keep is None else rows.where(keep)
    asked = cut_lineage(queries.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec"))
    near = cut_lineage(_ask(asked, centres, cells, min_sim, probes, True))
    found = cut_lineage(_best(_compare(near, rows, cells, k, min_sim, block_rows), k))
    floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("similarity").alias("floor"))
    far = cut_lineage(_ask(asked.join(floors, "id", "left"), centres, cells, min_sim, probes, False))
    more = _compare(far, rows, cells, k, min_sim, block_rows)
    matches = _best(found.drop("rank").unionByName(more), k)
    sizes = F.broadcast(spark.createDataFrame([(int(c), int(n)) for c, n in cells["n"].items()], "cell int, n long"))
    both = near.select("query_id", F.explode("cells").alias("cell"), F.lit(1).alias("first")).unionByName(
        far.select("query_id", F.explode("cells").alias("cell"), F.lit(0).alias("first")))
    reads = both.join(sizes, "cell").groupBy("query_id").agg(
        F.sum("first").alias("near_cells"), F.sum(1 - F.col("first")).alias("far_cells"), F.sum("n").alias("rows_read"))
    total = int(cells["n"].sum())
    reads = asked.select(F.col("id").alias("query_id")).join(reads, "query_id", "left").na.fill(0).select(
        "query_id", F.lit(len(cells)).alias("cells"), "near_cells", "far_cells", "rows_read", F.lit(total).cast("long").alias("rows"))
    return matches, reads
