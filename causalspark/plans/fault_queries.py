"""Named queries for fault graphs, ranking and patterns (F, R, K rows and C13, C14, A31, A32).

The choice of edges feeds back into later scores; the check SQL follows it event by event with a
recursive table. Pattern matches are compared with all shapes scored against all patterns, expected paths with all
shortest ways.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import round_to
from causalspark.operators import faults as X
from causalspark.plans.registry import query
from causalspark.plans.sqltables import lookup_case, r3
from causalspark.plans.ingest_queries import ABSTRACT

WINDOW_MIN = 360


def depends(x):
    """Each service of a tenant depends on the next one by name."""
    s = x.episodes.select("client_id", "service").distinct()
    return s.withColumn("needs", F.lead("service").over(W.partitionBy("client_id").orderBy("service"))).where("needs IS NOT NULL")


def events(x):
    return X.fault_events(x.episodes, ["client_id", "s_ns"], WINDOW_MIN)


def scored(x):
    return X.with_predecessors(events(x), depends(x))


def nodes(x):
    """The chosen graphs are stored once, like the links."""
    return x.stored("fault_nodes", lambda: X.build_fpg(scored(x)))


def abstract(x):
    return x.stored("abstract_faults", lambda: X.abstract_faults(nodes(x)))


def patterns(x):
    return X.pattern_store(abstract(x), min_frequency=2)


FAULT_SQL = {
    "fe0": f"SELECT client_id, severity, client_id || CASE WHEN s_ns = '' THEN '|' ELSE '|' || s_ns END || '|' || CAST(t // {WINDOW_MIN * 60000000} AS STRING) AS fault_id, eid, t, service, CASE WHEN s_kind = 'Pod' THEN rid END AS pod, {ABSTRACT} AS a FROM episodes WHERE severity <> 'INFO'",
    "fe": f"SELECT *, {lookup_case('a', R.FAULT_TYPES, chr(39) + 'custom' + chr(39))} AS type, row_number() OVER (PARTITION BY fault_id ORDER BY t, eid) AS pos FROM fe0",
    "dep": "SELECT client_id, service, lead(service) OVER (PARTITION BY client_id ORDER BY service) AS needs FROM (SELECT DISTINCT client_id, service FROM episodes)",
    "fp": """SELECT p.fault_id, p.eid AS source, e.eid AS target, (e.t - p.t) / CAST(1000000.0 AS DOUBLE) AS dt, p.service = e.service AS same, d.service IS NOT NULL AS dep, p.pod IS NOT NULL AND p.pod = e.pod AS pod,
        CAST(CASE p.type || '>' || e.type """ + " ".join(f"WHEN '{a}>{b}' THEN {v}" for (a, b), v in R.FAULT_CAUSALITY.items()) + """ ELSE 0.1 END AS DOUBLE) AS cause
      FROM fe e JOIN fe p ON p.fault_id = e.fault_id AND e.pos - p.pos BETWEEN 1 AND 5 LEFT JOIN dep d ON d.client_id = e.client_id AND d.service = e.service AND d.needs = p.service""",
}


@query("f2_pair_scores", f"""SELECT fault_id, source, target, {r3('CASE WHEN dt <= 0 THEN 0 ELSE least(1.0, pow(2.0, -dt / 60.0)) END * 0.3 + CASE WHEN same THEN 0.25 ELSE 0 END + CASE WHEN dep THEN 0.25 ELSE 0 END + cause * 0.2 + CASE WHEN pod THEN 0.15 ELSE 0 END', 6)} AS base,
    CASE WHEN cause > 0.7 THEN 'CAUSES' WHEN dep THEN 'PROPAGATES_TO' WHEN same THEN 'SEQUENTIAL' ELSE 'CORRELATES_WITH' END AS relation, dt AS time_delta FROM fp""", FAULT_SQL)
def f2(x):
    return X.pair_scores(scored(x)).withColumn("base", round_to(F.col("base"), 6))


PAIRS = "MAP {" + ", ".join(f"'{a}>{b}': CAST({v} AS DOUBLE)" for (a, b), v in R.FAULT_CAUSALITY.items()) + "}"
NODE = "recent[len(recent) - p.j + 1]"
ALONE = "{'indeg': 0, 'succ': CAST([] AS VARCHAR[]), 'depth': 0, 'path': [eid]}"
GRAPH = {
    **FAULT_SQL,
    "fbase": """SELECT fault_id, source, target, dt, CAST(CASE WHEN dt <= 0 THEN 0 ELSE least(1.0, pow(2.0, -dt / 60.0)) END * 0.3 + CASE WHEN same THEN 0.25 ELSE 0 END + CASE WHEN dep THEN 0.25 ELSE 0 END
        + cause * 0.2 + CASE WHEN pod THEN 0.15 ELSE 0 END AS DOUBLE) AS base,
        CASE WHEN cause > 0.7 THEN 'CAUSES' WHEN dep THEN 'PROPAGATES_TO' WHEN same THEN 'SEQUENTIAL' ELSE 'CORRELATES_WITH' END AS relation FROM fp""",
    "fprev": """SELECT b.fault_id, e.pos, list({'j': CAST(e.pos - p.pos AS INTEGER), 'eid': b.source, 'base': b.base, 'relation': b.relation, 'dt': b.dt} ORDER BY e.pos - p.pos) AS prev
        FROM fbase b JOIN fe e ON e.fault_id = b.fault_id AND e.eid = b.target JOIN fe p ON p.fault_id = b.fault_id AND p.eid = b.source GROUP BY 1, 2""",
    "fev": "SELECT fe.*, prev, pos = max(pos) OVER (PARTITION BY fault_id) AS is_last FROM fe LEFT JOIN fprev USING (fault_id, pos)",
    # one event of every fault in each round; 'recent' holds the last five nodes, 'best' the chosen sources
    "fgraph": f"""SELECT fault_id, pos, eid, type, CAST([] AS STRUCT(nc DOUBLE, nj INTEGER, eid VARCHAR, relation VARCHAR, dt DOUBLE)[]) AS best, [{ALONE}] AS recent FROM fev WHERE pos = 1
      UNION ALL SELECT fault_id, pos, eid, type, best, list_append(list_transform(recent, lambda n, i: CASE WHEN list_contains(list_transform(best, lambda b: len(recent) + b.nj + 1), i)
            THEN {{'indeg': n.indeg, 'succ': list_append(n.succ, type), 'depth': n.depth, 'path': n.path}} ELSE n END)[-4:],
          CASE WHEN len(best) = 0 THEN {ALONE} ELSE {{'indeg': CAST(len(best) AS INTEGER), 'succ': CAST([] AS VARCHAR[]), 'depth': near.depth + 1, 'path': list_append(near.path, eid)}} END) AS recent
      FROM (SELECT *, list_sort(list_transform(best, lambda b: {{'depth': recent[len(recent) + b.nj + 1].depth, 'path': recent[len(recent) + b.nj + 1].path}}))[1] AS near
        FROM (SELECT fault_id, pos, eid, type, recent, list_sort(list_filter(list_transform(prev, lambda p: {{'nc': -least(CAST(1.0 AS DOUBLE), p.base + CAST(0.15 AS DOUBLE) * least(CAST(1.0 AS DOUBLE),
                CASE WHEN {NODE}.indeg = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CASE WHEN len({NODE}.succ) = 0 THEN CAST(0 AS DOUBLE)
                  WHEN len(list_filter({NODE}.succ, lambda s: coalesce({PAIRS}[s || '>' || type], 0.1) > 0.5)) > 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END)),
                'nj': -p.j, 'eid': p.eid, 'relation': p.relation, 'dt': p.dt}}), lambda b: b.nc <= -0.3))[1:2] AS best
          FROM (SELECT e.fault_id, e.pos, e.eid, e.type, e.prev, g.recent FROM fgraph g JOIN fev e ON e.fault_id = g.fault_id AND e.pos = g.pos + 1)))""",
    "fedges": "SELECT fault_id, s.eid AS source, target, s.relation AS relation, -s.nc AS confidence, s.dt AS time_delta FROM (SELECT fault_id, eid AS target, unnest(best) AS s FROM fgraph)",
    "froots": "SELECT e.* FROM fev e JOIN fgraph g USING (fault_id, pos) WHERE len(g.best) = 0",
}
SIG = "type || '|' || regexp_replace(service, '-[^-]{9,}$', '-*') || '|' || severity"
SHAPES = {
    **GRAPH,
    "fsig": f"SELECT *, {SIG} AS sig FROM fev",
    "fseq": "SELECT fault_id, list(sig ORDER BY t, eid) AS sequence FROM (SELECT fault_id, sig, min({'t': t, 'eid': eid}).t AS t, min({'t': t, 'eid': eid}).eid AS eid FROM fsig GROUP BY fault_id, sig, type, service) GROUP BY 1",
    "fpairs": "SELECT DISTINCT d.fault_id, a.sig AS source_sig, b.sig AS target_sig FROM fedges d JOIN fsig a ON a.fault_id = d.fault_id AND a.eid = d.source JOIN fsig b ON b.fault_id = d.fault_id AND b.eid = d.target WHERE a.sig <> b.sig",
    "flinks": """SELECT fault_id, count(*) AS n, '[' || string_agg('{"source_sig":"' || source_sig || '","target_sig":"' || target_sig || '"}', ',' ORDER BY source_sig, target_sig) || ']' AS js FROM fpairs GROUP BY 1""",
    "fabs": "SELECT s.fault_id, r.root_type, sequence, coalesce(n, 0) AS n, coalesce(js, '[]') AS js FROM fseq s JOIN (SELECT fault_id, arg_min(type, {'t': t, 'eid': eid}) AS root_type FROM froots GROUP BY 1) r USING (fault_id) LEFT JOIN flinks USING (fault_id)",
    "fstore": "SELECT root_type, sequence, js, count(*) AS frequency FROM fabs GROUP BY 1, 2, 3",
}
ID = "md5(root_type || '|' || array_to_string(sequence, '>') || '|' || js)"
STORED = {**SHAPES, "fids": f"SELECT {ID} AS pattern_id, root_type, sequence, js, frequency FROM fstore"}
PATHS = {
    **STORED,
    "kpattern": "SELECT * FROM fids WHERE frequency >= 2",
    "karc": "SELECT pattern_id, e ->> 'source_sig' AS source, e ->> 'target_sig' AS target FROM (SELECT pattern_id, unnest(CAST(js AS JSON[])) AS e FROM kpattern)",
    "kroot": "SELECT DISTINCT pattern_id, node FROM (SELECT pattern_id, unnest(sequence) AS node FROM kpattern) n WHERE NOT EXISTS (SELECT 1 FROM karc a WHERE a.pattern_id = n.pattern_id AND a.target = n.node)",
    "kreach": """SELECT pattern_id, node AS root, node, 0 AS d FROM kroot UNION SELECT r.pattern_id, r.root, a.target, r.d + 1 FROM kreach r JOIN karc a ON a.pattern_id = r.pattern_id AND a.source = r.node
        JOIN kpattern p ON p.pattern_id = r.pattern_id AND r.d < len(p.sequence)""",
    "kleast": "SELECT pattern_id, root, node, min(d) AS d FROM kreach GROUP BY 1, 2, 3",
    "kway": """SELECT pattern_id, node AS root, node, [node] AS path FROM kroot UNION ALL SELECT w.pattern_id, w.root, a.target, list_append(w.path, a.target) FROM kway w JOIN karc a ON a.pattern_id = w.pattern_id AND a.source = w.node
        JOIN kleast l ON l.pattern_id = w.pattern_id AND l.root = w.root AND l.node = a.target AND l.d = len(w.path)""",
}
STATISTICS = """SELECT *, CASE WHEN events > 1 THEN relations / CAST(events * (events - 1) AS DOUBLE) ELSE 0 END AS density FROM (SELECT fault_id, count(*) AS events, CAST(sum(len(best)) AS BIGINT) AS relations, count(*) FILTER (len(best) = 0) AS roots,
    count(DISTINCT service) AS services, count(DISTINCT e.type) AS types, (max(t) - min(t)) / CAST(1000000.0 AS DOUBLE) AS span_seconds FROM fev e JOIN fgraph g USING (fault_id, pos) GROUP BY 1)"""
EXPLANATION = """type || ' on ' || service || ' happened ' || CASE WHEN time_score > 0.8 THEN 'very close in time to' WHEN time_score > 0.5 THEN 'shortly before' ELSE 'well before' END || ' the alarm, '
    || CASE WHEN distance_score > 0.8 THEN 'on the same or a direct service' WHEN distance_score > 0.5 THEN 'on a near service' ELSE 'on a distant service' END"""
# All shapes with all patterns, and the common subsequence by the plain table of prefixes, one row of it in each round.
MATCHES = {
    **STORED,
    "kfirst": "SELECT fault_id, sig, type, regexp_replace(regexp_replace(service, '-[^-]{9,}$', '-*'), '-\\*$', '') AS family, min({'t': t, 'eid': eid}) AS seen FROM fsig GROUP BY fault_id, sig, type, service",
    "kfault": """SELECT f.*, ts, types, services FROM fabs f JOIN (SELECT fault_id, list(type ORDER BY seen) AS ts, list_sort(list_distinct(list(type))) AS types, list_sort(list_distinct(list(family))) AS services FROM kfirst GROUP BY 1) USING (fault_id)""",
    "kshape": "SELECT DISTINCT ts, types, services, js, CAST(n AS DOUBLE) AS m FROM kfault",
    "kpattern": f"SELECT {ID} AS pattern_id, count(*) AS frequency, ts, types, services, CAST(n AS DOUBLE) AS m FROM kfault GROUP BY root_type, sequence, js, ts, types, services, n HAVING count(*) >= 2",
    "klcs": """SELECT a, b, 0 AS i, list_transform(b, lambda y: 0) AS dp FROM (SELECT DISTINCT s.ts AS a, p.ts AS b FROM kshape s, kpattern p)
        UNION ALL SELECT a, b, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda q: greatest(dp[q],
          CASE WHEN b[q] = a[i + 1] THEN 1 + CASE WHEN q = 1 THEN 0 ELSE dp[q - 1] END ELSE 0 END)))) FROM klcs WHERE i < len(a)""",
    "kratio": "SELECT a, b, 2.0 * CAST(dp[len(b)] AS DOUBLE) / CAST(len(a) + len(b) AS DOUBLE) AS sequence_score FROM klcs WHERE i = len(a)",
    "kpair": """SELECT *, CASE WHEN m1 = 0 AND m2 = 0 THEN 1.0 ELSE (CAST(least(m1, m2) AS DOUBLE) / greatest(m1, m2, 1) + CASE WHEN d1 = 0 AND d2 = 0 THEN CAST(1 AS DOUBLE) ELSE 1 - abs(d1 - d2) END) / CAST(2 AS DOUBLE) END AS structure FROM (
        SELECT s.ts, s.types, s.services, s.js, p.pattern_id, p.frequency, p.types AS p_types, s.m AS m1, p.m AS m2, r.sequence_score,
          CASE WHEN len(s.ts) > 1 THEN s.m / CAST(len(s.ts) * (len(s.ts) - 1) AS DOUBLE) ELSE 0 END AS d1, CASE WHEN len(p.ts) > 1 THEN p.m / CAST(len(p.ts) * (len(p.ts) - 1) AS DOUBLE) ELSE 0 END AS d2,
          len(list_intersect(s.types, p.types)) / CAST(len(list_distinct(list_concat(s.types, p.types))) AS DOUBLE) AS jt,
          len(list_intersect(s.services, p.services)) / CAST(len(list_distinct(list_concat(s.services, p.services))) AS DOUBLE) AS js_
        FROM kshape s, kpattern p JOIN kratio r ON r.a = s.ts AND r.b = p.ts)""",
    "kscored": """SELECT *, CAST(0.35 AS DOUBLE) * jt + CAST(0.25 AS DOUBLE) * js_ + CAST(0.30 AS DOUBLE) * sequence_score + CAST(0.10 AS DOUBLE) * structure AS similarity FROM kpair""",
    "kbest": """SELECT *, CAST(row_number() OVER (PARTITION BY ts, types, services, js ORDER BY similarity DESC, frequency DESC, pattern_id) AS INTEGER) AS rank FROM kscored QUALIFY rank <= 3""",
    "kmatch": "SELECT f.fault_id, k.* FROM kfault f JOIN kbest k ON k.ts = f.ts AND k.types = f.types AND k.services = f.services AND k.js = f.js",
}
SCORED = {
    **GRAPH,
    "fback": """SELECT fault_id, eid, 0 AS dist FROM fev WHERE is_last UNION SELECT b.fault_id, d.source, b.dist + 1 FROM fback b JOIN fedges d ON d.fault_id = b.fault_id AND d.target = b.eid""",
    "fdist": "SELECT fault_id, eid, min(dist) AS dist FROM fback GROUP BY 1, 2",
    "fchain": "SELECT client_id, service, row_number() OVER (PARTITION BY client_id ORDER BY service) AS place FROM (SELECT DISTINCT client_id, service FROM episodes)",
    "fscore0": """SELECT r.fault_id, r.eid, r.t, r.type, r.service, a.service AS other, (a.t - r.t) / CAST(1000000.0 AS DOUBLE) AS dt, d.dist, n.n, y.place - x.place AS hops
      FROM froots r JOIN (SELECT * FROM fev WHERE is_last) a USING (fault_id) JOIN (SELECT fault_id, count(*) AS n FROM fev GROUP BY 1) n USING (fault_id)
      LEFT JOIN fdist d ON d.fault_id = r.fault_id AND d.eid = r.eid
      JOIN fchain x ON x.client_id = r.client_id AND x.service = r.service JOIN fchain y ON y.client_id = r.client_id AND y.service = a.service""",
    "fscore1": """SELECT *, CASE WHEN dt < 0 THEN 0 ELSE pow(CAST(2.0 AS DOUBLE), -dt / CAST(120.0 AS DOUBLE)) END AS time_score, coalesce(CAST(1.0 AS DOUBLE) - dist / CAST(n AS DOUBLE), 0) AS graph,
        CASE WHEN hops BETWEEN 1 AND 5 THEN CAST(1.0 AS DOUBLE) - hops / CAST(5.0 AS DOUBLE) ELSE 0 END AS near FROM fscore0""",
    "fscores": "SELECT *, CASE WHEN service = other THEN 1 WHEN graph > 0 THEN CAST(0.7 AS DOUBLE) * graph + CAST(0.3 AS DOUBLE) * near ELSE near END AS distance_score FROM fscore1",
    "franked": """SELECT *, row_number() OVER (PARTITION BY fault_id ORDER BY rank_score DESC, t, eid) AS rank FROM (SELECT *, CAST(0.6 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - (rank() OVER (PARTITION BY fault_id ORDER BY time_score DESC) - 1) / CAST(count(*) OVER (PARTITION BY fault_id) AS DOUBLE))
        + CAST(0.4 AS DOUBLE) * (CAST(1.0 AS DOUBLE) - (rank() OVER (PARTITION BY fault_id ORDER BY distance_score DESC) - 1) / CAST(count(*) OVER (PARTITION BY fault_id) AS DOUBLE)) AS rank_score FROM fscores)""",
}


@query("f1_fault_graphs", f"SELECT fault_id, source, target, relation, {r3('confidence', 6)} AS confidence, time_delta FROM fedges", GRAPH)
def f1(x):
    return X.fpg_edges(X.build_fpg(scored(x))).withColumn("confidence", round_to(F.col("confidence"), 6))


@query("f3_context_scores", f"SELECT fault_id, source, target, {r3('(d.confidence - b.base) / CAST(0.15 AS DOUBLE)', 3)} AS context FROM fedges d JOIN fbase b USING (fault_id, source, target)", GRAPH)
def f3(x):
    """What the graph context added to the base score of each chosen edge."""
    base = X.pair_scores(scored(x)).select("fault_id", "source", "target", "base")
    return X.fpg_edges(nodes(x)).join(base, ["fault_id", "source", "target"]).select(
        "fault_id", "source", "target", round_to((F.col("confidence") - F.col("base")) / 0.15, 3).alias("context"))


@query("f4_root_candidates", "SELECT fault_id, eid, type, service, t FROM froots", GRAPH)
def f4(x):
    return X.root_candidates(nodes(x)).drop("client_id")


@query("f5_propagation_paths", "SELECT fault_id, eid AS alarm, recent[-1].path[1] AS root, recent[-1].depth AS depth, array_to_string(recent[-1].path, '>') AS path FROM fgraph JOIN (SELECT fault_id, pos FROM fev WHERE is_last) USING (fault_id, pos)", GRAPH)
def f5(x):
    return X.propagation_paths(nodes(x)).withColumn("path", F.array_join("path", ">"))


@query("f6_expected_paths", """SELECT p.pattern_id, array_to_string(coalesce(w.path, p.sequence), '>') AS path FROM kpattern p LEFT JOIN (
    SELECT pattern_id, path FROM kway QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY len(path) DESC, path) = 1) w USING (pattern_id)""", PATHS)
def f6(x):
    return X.expected_paths(patterns(x)).withColumn("path", F.array_join("path", ">"))


@query("f7_sequence_jaccard", """SELECT a.fault_id, b.fault_id AS next_fault, len(list_intersect(a.types, b.types)) / CAST(len(list_distinct(list_concat(a.types, b.types))) AS DOUBLE) AS jaccard FROM ft a JOIN ft b ON a.k = b.k AND b.n = a.n + 1""",
       {**FAULT_SQL, "ft": "SELECT fault_id, types, k, row_number() OVER (PARTITION BY k ORDER BY slot) AS n FROM (SELECT fault_id, list_distinct(list(type)) AS types, regexp_replace(fault_id, '\\|[0-9]+$', '') AS k, CAST(regexp_extract(fault_id, '([0-9]+)$', 1) AS BIGINT) AS slot FROM fe GROUP BY 1)"})
def f7(x):
    """Event types of consecutive faults of one tenant and namespace."""
    t = events(x).groupBy("fault_id").agg(F.collect_set("type").alias("types"))
    w = W.partitionBy(F.regexp_replace("fault_id", r"\|[0-9]+$", "")).orderBy(F.substring_index("fault_id", "|", -1).cast("long"))
    nxt = t.withColumn("next", F.lead(F.struct("fault_id", "types")).over(w)).where("next IS NOT NULL")
    return nxt.select("fault_id", F.col("next.fault_id").alias("next_fault"), X.jaccard(F.col("types"), F.col("next.types")).alias("jaccard"))


def _scores(x):
    return X.root_scores(nodes(x), depends(x))


@query("r1_root_scores", f"SELECT fault_id, eid, {r3('time_score', 6)} AS time_score, {r3('distance_score', 6)} AS distance_score FROM fscores", SCORED)
def r1(x):
    return _scores(x).select("fault_id", "eid", round_to(F.col("time_score"), 6).alias("time_score"), round_to(F.col("distance_score"), 6).alias("distance_score"))


@query("r2_ranked_causes", f"SELECT fault_id, eid, CAST(rank AS INTEGER) AS rank, {r3('rank_score', 6)} AS rank_score FROM franked WHERE rank <= 5", SCORED)
def r2(x):
    return X.rank_root_causes(_scores(x)).select("fault_id", "eid", "rank", round_to(F.col("rank_score"), 6).alias("rank_score"))


@query("r3_explanations", f"SELECT fault_id, eid, {EXPLANATION} AS explanation FROM franked WHERE rank = 1", SCORED)
def r3_(x):
    return X.rank_root_causes(_scores(x), top_n=1).select("fault_id", "eid", X.explanation().alias("explanation"))


CONFIDENCE = r3('least(CAST(1 AS DOUBLE), CAST(0.7 AS DOUBLE) * similarity + least(CAST(0.3 AS DOUBLE), CAST(0.1 AS DOUBLE) * sqrt(frequency)))', 6)


@query("r4_fault_analysis", f"""SELECT s.*, p.alarm, p.depth, r.eid AS root_cause, {r3('r.rank_score', 6)} AS rank_score, r.explanation, k.pattern_id, k.confidence AS pattern_confidence FROM fstats s
  JOIN (SELECT fault_id, eid AS alarm, recent[-1].depth AS depth FROM fgraph JOIN (SELECT fault_id, pos FROM fev WHERE is_last) USING (fault_id, pos)) p USING (fault_id)
  JOIN (SELECT fault_id, eid, rank_score, {EXPLANATION} AS explanation FROM franked WHERE rank = 1) r USING (fault_id)
  LEFT JOIN (SELECT fault_id, pattern_id, {CONFIDENCE} AS confidence FROM kmatch WHERE rank = 1) k USING (fault_id)""",
       {**SCORED, **MATCHES, "fstats": STATISTICS})
def r4(x):
    found = X.analyse(nodes(x), depends(x), abstract(x), patterns(x))
    return found.withColumns({c: round_to(F.col(c), 6) for c in ("rank_score", "pattern_confidence")})


@query("k1_pattern_matches", f"SELECT fault_id, pattern_id, rank, {r3('similarity', 6)} AS similarity FROM kmatch", MATCHES)
def k1(x):
    return X.match_patterns(abstract(x), patterns(x)).select("fault_id", "pattern_id", "rank", round_to(F.col("similarity"), 6).alias("similarity"))


@query("k2_sequence_similarity", f"SELECT fault_id, pattern_id, {r3('sequence_score', 6)} AS sequence FROM kmatch", MATCHES)
def k2(x):
    return X.match_patterns(abstract(x), patterns(x)).select("fault_id", "pattern_id", round_to(F.col("sequence"), 6).alias("sequence"))


@query("k3_structure_similarity", f"SELECT fault_id, pattern_id, {r3('structure', 6)} AS structure FROM kmatch", MATCHES)
def k3(x):
    return X.match_patterns(abstract(x), patterns(x)).select("fault_id", "pattern_id", round_to(F.col("structure"), 6).alias("structure"))


@query("k4_match_confidence", f"""SELECT fault_id, pattern_id, {CONFIDENCE} AS confidence,
    array_to_string(list_sort(list_intersect(types, p_types)), ',') AS matched, array_to_string(list_filter(p_types, lambda p: NOT list_contains(types, p)), ',') AS missing,
    array_to_string(list_filter(types, lambda p: NOT list_contains(p_types, p)), ',') AS extra FROM kmatch""", MATCHES)
def k4(x):
    return X.match_patterns(abstract(x), patterns(x)).select("fault_id", "pattern_id", round_to(F.col("confidence"), 6).alias("confidence"), "matched", "missing", "extra")


@query("c13_pattern_store", "SELECT md5(root_type || '|' || array_to_string(sequence, '>') || '|' || js) AS pattern_id, CASE WHEN frequency >= 2 THEN 2 * frequency ELSE frequency END AS frequency, root_type FROM fstore", SHAPES)
def c13(x):
    """A first store of the repeated patterns, merged with the patterns of all faults."""
    merged = X.merge_patterns(patterns(x), X.pattern_store(abstract(x)))
    return merged.select("pattern_id", "frequency", "root_type")


@query("c13_patterns_by_root", "SELECT pattern_id, root_type, frequency, CAST(row_number() OVER (PARTITION BY root_type ORDER BY frequency DESC, pattern_id) AS INTEGER) AS rank FROM fids QUALIFY rank <= 5", STORED)
def c13_by_root(x):
    """The five most frequent patterns of each root type."""
    return X.read_patterns(X.pattern_store(abstract(x)), limit=5).select("pattern_id", "root_type", "frequency", "rank")


@query("c13_pattern_events", """SELECT p.pattern_id, p.position, p.event, (SELECT count(*) FROM arcs a WHERE a.pattern_id = p.pattern_id AND a.target = p.event) AS causes,
    (SELECT count(*) FROM arcs a WHERE a.pattern_id = p.pattern_id AND a.source = p.event) AS effects
  FROM (SELECT pattern_id, unnest(sequence) AS event, CAST(unnest(range(len(sequence))) AS INTEGER) AS position FROM fids) p""",
       {**STORED, "arcs": "SELECT pattern_id, e ->> 'source_sig' AS source, e ->> 'target_sig' AS target FROM (SELECT pattern_id, unnest(CAST(js AS JSON[])) AS e FROM fids)"})
def c13_events(x):
    return X.pattern_events(X.pattern_store(abstract(x)))


@query("c14_abstract_faults", "SELECT fault_id, root_type, array_to_string(sequence, '>') AS sequence, n AS edges FROM fabs", SHAPES)
def c14(x):
    return abstract(x).select("fault_id", "root_type", F.array_join("sequence", ">").alias("sequence"), F.size("edges").alias("edges"))


@query("a31_pattern_statistics", "SELECT root_type, count(*) AS patterns, CAST(sum(frequency) AS BIGINT) AS faults, max(frequency) AS most, max(len(sequence)) AS longest FROM fstore GROUP BY 1", SHAPES)
def a31(x):
    return X.pattern_statistics(X.pattern_store(abstract(x)))


@query("a32_graph_statistics", STATISTICS, GRAPH)
def a32(x):
    return X.graph_statistics(nodes(x))
