"""Named queries for search and vectors (E rows)."""

from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import round_to
from causalspark.operators import hashing, search as E, vectorindex
from causalspark.plans.ingest_queries import LINES, _lines
from causalspark.plans.registry import query
from causalspark.plans.sqltables import r3
from causalspark.session import shared_folder

COS = "list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[]))"


def _vectors(x):
    return x.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _with_copies(x):
    """The vectors plus one shifted copy of each (first component moved, id offset)."""
    v = _vectors(x)
    moved = F.transform("vec", lambda c, i: F.when(i == 0, c + (F.col("id") % 5).cast("float") * F.lit(0.1).cast("float")).otherwise(c))
    return v.unionByName(v.select((F.col("id") + 10000000).alias("id"), moved.alias("vec")))


COPIES = {"vectors": """SELECT vec_id AS id, embedding AS vec FROM embeddings UNION ALL
    SELECT vec_id + 10000000, list_concat([CAST(embedding[1] + CAST(vec_id % 5 AS FLOAT) * CAST(0.1 AS FLOAT) AS FLOAT)], embedding[2:]) FROM embeddings"""}


@query("e1_text_search", """SELECT b.client_id, b.eid, b.reason, b.similarity, coalesce(c.n, 0) AS root_causes, coalesce(m.incident_id, '') AS incident_id,
    CASE WHEN similarity >= 0.8 THEN 'Strong match: ''' || b.reason || ''' closely matches query terms: ' || CASE WHEN contains(lower(b.reason), 'oom') THEN 'oom' ELSE '' END ELSE 'Partial match: ''' || b.reason || ''' contains: ' END AS explanation
  FROM (SELECT *, CAST(CASE WHEN contains(lower(reason), 'oom') THEN 0.9 ELSE 0.7 END AS DOUBLE) AS similarity FROM episodes, clock WHERE severity IN ('ERROR','FATAL','INFO') AND t >= now - 1728000000000 AND (contains(lower(reason), 'oom') OR contains(lower(message), 'oom'))
    QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY similarity DESC, t DESC, eid) <= 100) b LEFT JOIN (SELECT client_id, effect, count(*) AS n FROM links GROUP BY 1, 2) c ON c.client_id = b.client_id AND c.effect = b.eid LEFT JOIN incident_members m ON m.client_id = b.client_id AND m.eid = b.eid""")
def e1(x):
    return E.text_search(x.episodes, x.links, x.incident_members, "oom", top_k=100, days=20, severities=["ERROR", "FATAL", "INFO"]).select(
        "client_id", "eid", "reason", "similarity", "root_causes", "incident_id", "explanation")


WORDS = ["deadlock", "memory", "timeout", "volume"]
QUESTION = "What caused the deadlock, memory or timeout by volume?"


@query("e2_keyword_search", "SELECT id, matched FROM (SELECT id, array_to_string(list_filter(['deadlock','memory','timeout','volume'], lambda w: contains(lower(line), w)), ',') AS matched FROM lines) WHERE matched <> ''", {"lines": LINES})
def e2(x):
    assert E.keywords(QUESTION) == WORDS
    return E.keyword_search(_lines(x), QUESTION, columns=("line",)).select("id", F.array_join("matched", ",").alias("matched"))


@query("e2_index_lookup", """SELECT q.reason AS query_id, i.id, count(*) AS hits FROM (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda w: length(w) > 2))) AS term FROM lines) i
  JOIN (SELECT DISTINCT reason, unnest(['deadlock', 'memory', lower(reason)]) AS term FROM episodes WHERE severity = 'FATAL') q USING (term) GROUP BY 1, 2""", {"lines": LINES})
def e2i(x):
    q = x.episodes.where("severity = 'FATAL'").select(F.col("reason").alias("query_id"), F.explode(F.array(F.lit("deadlock"), F.lit("memory"), F.lower("reason"))).alias("term"))
    return E.index_lookup(E.term_index(_lines(x), "id", "line"), q, "id")


WEIGHT = "CASE w " + " ".join(f"WHEN '{k}' THEN {int(round(v * 10))}" for k, v in R.KEYWORD_WEIGHTS.items()) + " END"


@query("e3_keyword_vectors", f"""SELECT id, dim, {r3('tenths / sqrt(sum(tenths * tenths) OVER (PARTITION BY id))', 6)} AS value FROM (
    SELECT id, CAST(((i - 1) * 17) % 384 AS INTEGER) AS dim, CAST(sum(n) AS BIGINT) AS tenths FROM (SELECT id, i, {WEIGHT} AS n FROM (
      SELECT id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM (SELECT id, list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda w: w <> '') AS words FROM lines))) WHERE n IS NOT NULL GROUP BY 1, 2)""", {"lines": LINES})
def e3(x):
    return E.keyword_vectors(_lines(x), "id", "line").withColumn("dim", F.col("dim").cast("int")).withColumn("value", round_to(F.col("value"), 6))


SIMILAR = f"SELECT query_id, item_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT a.id AS query_id, b.id AS item_id, {r3(COS, 6)} AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM vectors a JOIN vectors b ON b.id < 10000000 AND {COS} >= 0.2 WHERE a.id >= 10000000) WHERE rank <= 5"


@query("e4_similar_vectors", SIMILAR, COPIES)
def e4(x):
    queries = _with_copies(x).where("id >= 10000000")
    out = E.similar(queries, _vectors(x), k=5, min_sim=0.2)
    return out.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("item_id"), round_to(F.col("similarity"), 6).alias("similarity"), "rank")


@query("e5_near_duplicates", f"SELECT a.id AS left_id, b.id AS right_id, {r3(COS, 6)} AS similarity FROM vectors a JOIN vectors b ON a.id < b.id AND {COS} >= 0.95", COPIES)
def e5(x):
    return E.near_duplicates(_with_copies(x), 0.95).withColumn("similarity", round_to(F.col("similarity"), 6))


CLASSES = {**COPIES, "classes": "SELECT min(id) AS id, vec, count(*) AS copies FROM vectors GROUP BY vec",
           "timed": "SELECT v.id, v.vec, epoch_us(e.ts) AS t FROM vectors v JOIN events e ON e.event_id = v.id % 10000000",
           "fresh": "SELECT min(id) AS id, vec FROM timed WHERE t >= (SELECT max(t) FROM timed) - 86400000000 GROUP BY vec"}


@query("e5_hashed_duplicates", f"SELECT a.id AS left_id, b.id AS right_id, {r3(COS, 6)} AS similarity FROM classes a JOIN classes b ON a.id < b.id AND {COS} >= 0.95", CLASSES)
def e5_hashed(x):
    """Pairs between distinct vectors, found under hyperplane signatures."""
    return hashing.near_duplicates(_with_copies(x), 0.95).withColumn("similarity", round_to(F.col("similarity"), 6))


@query("e5_vector_classes", "SELECT v.id, c.id AS class_id FROM vectors v JOIN classes c ON c.vec = v.vec", CLASSES)
def e5_classes(x):
    v = _with_copies(x)
    return hashing.members(v, hashing.distinct_vectors(v))


@query("e5_recent_duplicates", f"SELECT a.id AS left_id, b.id AS right_id, {r3(COS, 6)} AS similarity FROM fresh a JOIN fresh b ON a.id < b.id AND {COS} >= 0.95", CLASSES)
def e5_recent(x):
    """As above, of the vectors of events of the last 24 hours."""
    times = x.raw("events").select((F.col("event_id")).alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    timed = _with_copies(x).withColumn("event", F.col("id") % 10000000).join(times, "event").drop("event")
    return hashing.near_duplicates(timed, 0.95, hours=24).withColumn("similarity", round_to(F.col("similarity"), 6))


ITEMS = f"SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.id AS query_id, b.id AS item_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM vectors a JOIN vectors b ON a.id <> b.id AND {COS} >= 0.3) WHERE rank <= 3"


@query("e6_similar_items", ITEMS,
       {"vectors": "SELECT vec_id AS id, embedding AS vec FROM embeddings"})
def e6(x):
    v = _vectors(x)
    return E.similar(v, v, k=3, min_sim=0.3).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("item_id"), "rank")


@query("e7_missing_vectors", "SELECT doc_id AS id, 'keywords' AS model FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def e7(x):
    index = x.raw("embeddings").select(F.col("vec_id").alias("id"), F.lit("keywords").alias("model"))
    return E.missing_vectors(x.raw("documents").select(F.col("doc_id").alias("id")), index, "keywords")


FILTERED = f"SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS.replace('.vec', '.embedding')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.label IN (1, 3) AND a.vec_id <> b.vec_id AND {COS.replace('.vec', '.embedding')} >= 0.1) WHERE rank <= 3 AND query_id IS NOT NULL".replace("a.label = b.label AND a.label IN (1, 3)", "a.label = 1 AND b.label = 3")


@query("e8_filtered_vectors", FILTERED)
def e8(x):
    """Filters apply to both sides before the top-k: label 1 searched in label 3."""
    rows = x.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    out = E.similar(rows.where("label = 1"), rows.where("label = 3"), k=3, min_sim=0.1)
    return out.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("item_id"), "rank")


def _index(x, name):
    """An index over the sample's vectors: trained on and filled with the even ids, then given all, the last batch twice."""
    rows = x.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    path = f"{shared_folder(x.spark)}/vectors/{name}-{''.join(c if c.isalnum() else '_' for c in x.directory)}"
    vectorindex.train(path, rows.where("id % 2 = 0"))
    vectorindex.append(path, rows.where("id % 2 = 0"), 0)
    for _ in range(2):
        vectorindex.append(path, rows, 1)
    return path, rows


@query("e4_indexed_vectors", SIMILAR, COPIES)
def e4_indexed(x):
    path, _ = _index(x, "e4")
    found, _ = vectorindex.search(path, _with_copies(x).where("id >= 10000000"), k=5, min_sim=0.2)
    return found.withColumn("similarity", round_to(F.col("similarity"), 6))


@query("e6_indexed_items", ITEMS, {"vectors": "SELECT vec_id AS id, embedding AS vec FROM embeddings"})
def e6_indexed(x):
    path, rows = _index(x, "e6")
    return vectorindex.search(path, rows, k=3, min_sim=0.3)[0].select("query_id", "item_id", "rank")


@query("e7_indexed_batches", "SELECT vec_id AS id, CAST(vec_id % 2 AS INTEGER) AS batch FROM embeddings")
def e7_batches(x):
    """What each batch has added: only rows that no other batch holds, a repeated batch nothing."""
    return vectorindex.read(x.spark, _index(x, "e7")[0]).select("id", F.col("batch").cast("int").alias("batch"))


@query("e8_indexed_filtered", FILTERED)
def e8_indexed(x):
    path, rows = _index(x, "e8")
    found, _ = vectorindex.search(path, rows.where("label = 1"), k=3, min_sim=0.1, keep=F.col("label") == 3)
    return found.select("query_id", "item_id", "rank")


NOTE = " || ".join(f"CASE WHEN contains(lower(reason), '{w}') THEN '''{w}'' in reason, ' WHEN contains(lower(message), '{w}') THEN '''{w}'' in message, ' ELSE '' END" for w in ["killed", "memory"])


@query("e9_match_explanation", f"SELECT eid, CASE WHEN n = '' THEN 'Semantic similarity' ELSE 'Matched: ' || substr(n, 1, length(n) - 2) END AS explanation FROM (SELECT eid, {NOTE} AS n FROM episodes)")
def e9(x):
    return x.episodes.select("eid", E.explain_keywords("show me all killed memory", F.col("reason"), F.col("message")).alias("explanation"))
