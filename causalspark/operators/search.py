"""Filtering, text search and vector search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import HOUR_US
from causalspark.operators.timejoin import latest, top_per
from causalspark.session import cut_lineage


def filter_events(episodes: DataFrame, client_id=None, namespaces=None, kinds=None, reasons=None,
                  severities=None, etypes=None, hours=None, text=None, as_of=None) -> DataFrame:
    """Conjunction of the given filters; each is a plain predicate that reaches the scan."""
    rows = episodes
    if client_id:
        rows = rows.where(F.col("client_id") == client_id)
    for column, values in (("s_ns", namespaces), ("s_kind", kinds), ("reason", reasons),
                           ("severity", severities), ("etype", etypes)):
        if values:
            rows = rows.where(F.col(column).isin(list(values)))
    if hours:
        rows = rows.where(F.col("t") >= latest(episodes, as_of) - hours * HOUR_US)
    if text:
        needle = F.lit(text.lower())
        rows = rows.where(F.contains(F.lower("message"), needle) | F.contains(F.lower("reason"), needle))
    return rows


def text_search(episodes: DataFrame, links: DataFrame, members: DataFrame, text: str, top_k: int = 10,
                min_similarity: float = 0.6, days: int = 7, as_of=None, **filters) -> DataFrame:
    """Events whose reason or message has the text, with their causes and incident.

    Filters and the time window come before the top-k, which is of each tenant; causes are counted before the join.
    """
    rows = filter_events(episodes, hours=days * 24, text=text, as_of=as_of, **filters)
    in_reason = F.contains(F.lower("reason"), F.lit(text.lower()))
    rows = rows.withColumn("similarity", F.when(in_reason, 0.9).otherwise(0.7)).where(
        F.col("similarity") >= min_similarity)
    best = top_per(rows, ["client_id"], [F.desc("similarity"), F.desc("t"), "eid"], top_k)
    causes = links.groupBy("client_id", F.col("effect").alias("eid")).agg(F.count("*").alias("root_causes"))
    inc = members.select("client_id", "eid", "incident_id")
    return (best.join(causes, ["client_id", "eid"], "left").join(inc, ["client_id", "eid"], "left")
            .na.fill(0, ["root_causes"]).na.fill("", ["incident_id"])
            .withColumn("explanation", explain_text(text, F.col("reason"), F.col("similarity"))))


def explain_text(query: str, reason, similarity):
    terms = F.array(*[F.lit(t) for t in query.lower().split()])
    found = F.array_join(F.filter(terms, lambda t: F.contains(F.lower(reason), t)), ", ")
    quoted = F.concat(F.lit("'"), reason, F.lit("'"))
    return (F.when(similarity >= 0.8, F.concat(F.lit("Strong match: "), quoted, F.lit(" closely matches query terms: "), found))
            .when(similarity >= 0.6, F.concat(F.lit("Partial match: "), quoted, F.lit(" contains: "), found))
            .otherwise(F.concat(F.lit("Weak match: "), quoted, F.lit(" has semantic similarity"))))


def keywords(query: str) -> list[str]:
    """Query words without stop words, longer than two letters."""
    words = [w.strip(".,?!") for w in query.lower().split()]
    return [w for w in words if w not in R.STOP_WORDS and len(w) > 2]


def keyword_search(rows: DataFrame, query: str, columns=("reason", "message")) -> DataFrame:
    """Rows with any keyword in one of the columns, with the matched words."""
    words = F.array(*[F.lit(w) for w in keywords(query)])
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    has = lambda w: reduce(lambda a, b: a | b, [F.contains(t, w) for t in texts])
    out = rows.withColumn("matched", F.filter(words, has))
    return out.where(F.size("matched") > 0)


def explain_keywords(query: str, first, second):
    """``'w' in reason`` or ``'w' in message`` per keyword, or a general note."""
    low1, low2 = F.lower(first), F.lower(second)
    notes = F.array_compact(F.array(*[
        F.when(F.contains(low1, F.lit(w)), F.lit(f"'{w}' in reason")).when(
            F.contains(low2, F.lit(w)), F.lit(f"'{w}' in message")) for w in keywords(query)]))
    return F.when(F.size(notes) > 0, F.concat(F.lit("Matched: "), F.array_join(notes, ", "))).otherwise(
        "Semantic similarity")


def term_index(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Inverted index (term, id): distinct words are taken inside each row before the explode."""
    words = F.array_distinct(F.filter(F.split(F.lower(text_column), r"\s+"), lambda w: F.length(w) > 2))
    return rows.select(id_column, F.explode(words).alias("term"))


def index_lookup(index: DataFrame, queries: DataFrame, id_column: str) -> DataFrame:
    """(query_id, id, hits) for many queries (query_id, term) at once."""
    return index.join(queries.select("query_id", "term").distinct(), "term").groupBy("query_id", id_column).agg(
        F.count("*").alias("hits"))


def keyword_vectors(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Sparse normalized bag-of-keywords vectors (id, dim, value); rows without keywords are left out.

    Word positions choose the dimension. Words without weight are dropped before the explode.
    """
    words = F.filter(F.split(F.lower(text_column), r"\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in R.KEYWORD_WEIGHTS.items() for x in kv])
    placed = F.transform(words, lambda w, i: F.struct(
        ((i * R.KEYWORD_STRIDE) % R.KEYWORD_DIMENSIONS).alias("dim"), F.try_element_at(table, w).alias("weight")))
    kept = F.filter(placed, lambda p: p["weight"].isNotNull())
    # weights have one decimal, so sums are kept as whole tenths
    sums = rows.select(id_column, F.explode(kept).alias("p")).groupBy(id_column, "p.dim").agg(
        F.sum(F.round(F.col("p.weight") * 10).cast("long")).alias("tenths"))
    norm = sums.groupBy(id_column).agg(F.sqrt(F.sum(F.col("tenths") * F.col("tenths"))).alias("norm"))
    return sums.join(norm, id_column).select(id_column, "dim", (F.col("tenths") / F.col("norm")).alias("value"))


# --- dense vectors ----------------------------------------------------------------------------

PIVOTS = 32
BLOCK_ROWS = 8192


def _normalized(series: pd.Series) -> np.ndarray:
    x = np.array(series.tolist(), dtype="float64").reshape(len(series), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def _homes(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, vec, home, dist): nearest pivot of each vector."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _normalized(pdf["vec"])
                dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ pivots.T))
                home = dist.argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "home": home.astype("int32"),
                                    "dist": dist[np.arange(len(x)), home]})
    return vectors.mapInPandas(run, "id long, vec array<float>, home int, dist double")


def vector_matches(left: DataFrame, right: DataFrame | None, min_sim: float, k: int | None = None,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact cosine matches of at least ``min_sim``: (left_id, right_id, similarity).

    left, right: id, vec. With ``right`` None every pair inside ``left`` is found once; with
    ``k`` only the best k per left vector are kept, per block and then overall.

    Vectors are put with their nearest pivot, and pivots with many vectors are cut into blocks,
    so a task sees two bounded blocks. A pair of pivots is skipped when their distance minus the
    radii of their vectors exceeds the distance that ``min_sim`` allows; nothing else is.
    """
    self_join = right is None
    corpus = left if self_join else right
    spark = left.sparkSession
    sample = corpus.where("vec IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    schema = "left_id long, right_id long, similarity double"
    if not sample:
        return spark.createDataFrame([], schema)
    pivots = _normalized(pd.Series([r["vec"] for r in sample]))
    l = cut_lineage(_homes(left.select("id", "vec"), pivots))
    r = l if self_join else cut_lineage(_homes(right.select("id", "vec"), pivots))
    stats = lambda df: {x["home"]: (-(-x["n"] // block_rows), x["radius"]) for x in
                        df.groupBy("home").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}
    ls = stats(l)
    rs = ls if self_join else stats(r)
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * min_sim))) + 1e-9
    between = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots @ pivots.T))
    plan = [(i, j, ls[i][0], rs[j][0]) for i in ls for j in rs
            if (not self_join or i <= j) and between[i, j] - ls[i][1] - rs[j][1] <= reach]
    pairs = F.broadcast(spark.createDataFrame(plan or [(-1, -1, 1, 1)], "hi int, hj int, ni int, nj int"))
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    lx = l.join(pairs, l["home"] == pairs["hi"]).select(
        "id", "vec", "hi", "hj", block(F.col("ni")).alias("bi"),
        F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("bj"))
    rx = r.join(pairs, r["home"] == pairs["hj"]).select(
        "id", "vec", "hi", "hj", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("bi"),
        block(F.col("nj")).alias("bj"))
    if self_join:
        lx, rx = (d.where("hi < hj OR bi <= bj") for d in (lx, rx))
    keys = ["hi", "hj", "bi", "bj"]
    rx = rx.select(*[F.col(c).alias(f"r_{c}") for c in ("id", "vec", *keys)])

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"left_id": [], "right_id": [], "similarity": []})
        x, y = _normalized(a["vec"]), _normalized(b["r_vec"])
        ids, others = a["id"].to_numpy(), b["r_id"].to_numpy()
        same = self_join and a["hi"].iat[0] == a["hj"].iat[0] and a["bi"].iat[0] == a["bj"].iat[0]
        parts = []
        for start in range(0, len(x), 512):
            sims = x[start:start + 512] @ y.T
            keep = sims >= min_sim
            if same:
                keep &= ids[start:start + 512, None] < others[None, :]
            if k is not None and len(others) > k:
                sims_kept = np.where(keep, sims, -2.0)
                floor = np.partition(sims_kept, -k, axis=1)[:, -k][:, None]
                keep &= sims >= floor
            i, j = np.nonzero(keep)
            parts.append(pd.DataFrame({"left_id": ids[start + i], "right_id": others[j], "similarity": sims[i, j]}))
        out = pd.concat(parts)
        if self_join:
            lo, hi = np.minimum(out["left_id"], out["right_id"]), np.maximum(out["left_id"], out["right_id"])
            out = out.assign(left_id=lo, right_id=hi)
        return out

    found = lx.groupBy(*keys).cogroup(rx.groupBy(*[f"r_{c}" for c in keys])).applyInPandas(match, schema)
    if k is None:
        return found
    w = W.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar(queries: DataFrame, corpus: DataFrame, k: int = 10, min_sim: float = 0.6) -> DataFrame:
    """Best ``k`` corpus vectors of each query vector (id, vec), the query itself left out."""
    rows = vector_matches(queries, corpus, min_sim, k + 1).where("left_id <> right_id").drop("rank")
    w = W.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_duplicates(vectors: DataFrame, min_sim: float = 0.95) -> DataFrame:
    return vector_matches(vectors, None, min_sim)


def missing_vectors(items: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Items that have no vector of the model yet."""
    done = index.where(F.col("model") == model).select("id")
    return items.join(done, "id", "left_anti").withColumn("model", F.lit(model))
