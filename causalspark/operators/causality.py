"""Linking events to their likely causes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.functions import rules as R
from causalspark.functions.scalar import MICROS, MINUTE_US, is_failure, round_to
from causalspark.operators import reach
from causalspark.operators.latest import COLUMNS, Elsewhere, Scoring, all_earlier, best_earlier, best_elsewhere
from causalspark.operators.timejoin import near_join, range_join, slice_of, sliding

LINK_COLUMNS = ["client_id", "cause", "effect", "hops", "temporal_score", "distance_score",
                "domain_score", "confidence"]
_SIDE = ["eid", "rid", "t", "reason", "severity", "message", "s_kind", "s_ns", "s_name"]


def side(episodes: DataFrame, prefix: str, columns=_SIDE) -> DataFrame:
    """Episodes as one side of a pair: ``client_id`` plus prefixed columns."""
    return episodes.select("client_id", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


# --- streaming-rule links -----------------------------------------------------------------

def sorted_rows(rows: DataFrame, window_us: int, slices: DataFrame | None = None) -> DataFrame:
    """Rows with groups in the order of the pass (:mod:`causalspark.operators.latest`).

    Time is cut into slices of two windows; a cause also goes to the next slice if that begins within its window.
    ``slices`` (client_id, slice), if given, are those that are asked.
    """
    at = slice_of(F.col("t"), 2 * window_us)
    cut = rows.withColumn("slice", F.explode(
        F.when((F.col("what") < 0) & (slice_of(F.col("t") + window_us, 2 * window_us) > at), F.array(at, at + 1)).otherwise(F.array(at))))
    if slices is not None:
        cut = cut.join(slices, ["client_id", "slice"], "left_semi")
    return cut.select(*COLUMNS).repartition("client_id", "slice").sortWithinPartitions("client_id", "slice", "t", F.desc("eid"))


def _spots(edges: DataFrame, k: int) -> DataFrame:
    """(client_id, rid, spots): the meeting vertices of a resource in one row."""
    return reach.labels(edges, k).groupBy("client_id", "rid").agg(F.collect_list(F.struct("x", F.col("d").cast("int").alias("d"))).alias("spots"))


def _stream_rows(episodes: DataFrame, edges: DataFrame, max_hops: int, cause: Column, effect: Column) -> DataFrame:
    """Every event as a cause and as an effect, with the vertices it meets others at. ``cause`` and ``effect`` are their
    numbers; an event without one is none."""
    roles = F.array_compact(F.array((-1 - cause).cast("int"), effect.cast("int")))
    both = episodes.select("client_id", "eid", "rid", "t", F.explode(roles).alias("what"))
    return both.join(_spots(edges, max_hops), ["client_id", "rid"]).select(
        "client_id", "eid", "t", "what", F.col("spots.x").alias("groups"), F.col("spots.d").alias("kinds"))


_PAIRS = "client_id string, cause string, effect string, hops int, gap_us long"


def link_causes(episodes: DataFrame, edges: DataFrame, window_min: int = 15, max_hops: int = 3,
                causes: Column | None = None) -> DataFrame:
    """Earlier-or-equal events (those for which ``causes`` holds, if given) inside the window on another resource within ``max_hops``.

    Events meet at a shared vertex inside a tenant's time slice, so only pairs that are close in the topology are
    formed. They come out where they are formed: what is shuffled are the events.
    """
    width = window_min * MINUTE_US
    rows = _stream_rows(episodes, edges, max_hops, F.lit(0) if causes is None else F.when(causes, 0), F.lit(0))
    return sorted_rows(rows, width).mapInArrow(lambda batches: all_earlier(batches, width, max_hops), _PAIRS)


def later_near(episodes: DataFrame, edges: DataFrame, window_min: int = 15, max_hops: int = 3, causes: Column | None = None) -> DataFrame:
    """(client_id, eid, n, nearest): of each cause, the later events of :func:`link_causes` and their least hops. Pairs are
    counted where they are formed, and none comes out."""
    width = window_min * MINUTE_US
    rows = _stream_rows(episodes, edges, max_hops, F.lit(0) if causes is None else F.when(causes, 0), F.lit(0))
    parts = sorted_rows(rows, width).mapInArrow(lambda batches: all_earlier(batches, width, max_hops, counted=True),
                                                "client_id string, cause string, n long, nearest int")
    return parts.groupBy("client_id", F.col("cause").alias("eid")).agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))


STREAM_TEXTS = {"conn": "(?i)(connection refused|timeout)", "db": "(?i)(database|deadlock)", "api": "(?i)(api|service)"}


def scored_causes_stream(episodes: DataFrame, edges: DataFrame, window_min: int = 15, max_hops: int = 3,
                         weights=(0.3, 0.3, 0.4), rules=None) -> DataFrame:
    """:func:`link_causes` with the scores of :func:`score_links_stream`, without joining texts to the pairs.

    The domain score depends on the rules and texts that either side matches. Events carry the number of what they
    match, and the pass looks the score up; there are as many numbers as matches that occur, whatever the data's size.
    """
    width = window_min * MINUTE_US
    marks, domain, cause, effect = _stream_marks(episodes, rules or R.STREAM_REASON_RULES)
    rows = _stream_rows(marks, edges, max_hops, cause, effect)
    pairs = sorted_rows(rows, width).mapInArrow(lambda batches: all_earlier(batches, width, max_hops, domain), _PAIRS + ", domain_score double")
    return _stream_scores(pairs, window_min, weights)


def _stream_marks(episodes: DataFrame, rules) -> tuple[DataFrame, np.ndarray, Column, Column]:
    """Events with what they match, the domain scores by cause class and effect signature, and the numbers of both."""
    found = lambda x: F.coalesce(x, F.lit(False)).cast("int").cast("string")
    text = lambda name: found(F.rlike(F.col("message"), F.lit(STREAM_TEXTS[name])))
    error = found(F.col("severity") == "ERROR")
    marks = episodes.withColumns({"c_reason": F.col("reason"), "e_reason": F.col("reason")}).withColumns({
        "c_mark": F.concat_ws("|", _signature(_hits(rules)), text("conn"), text("db"), error),
        "e_mark": F.concat_ws("|", _signature(_effect_hits(rules)), text("api"), error)})
    seen = lambda c: sorted(r[0] for r in marks.select(c).distinct().collect())
    c_marks, e_marks = seen("c_mark"), seen("e_mark")
    domain = np.full((max(1, len(c_marks)), max(1, len(e_marks))), float(R.STREAM_DOMAIN_DEFAULT))
    for i, c in enumerate(c_marks):
        for j, e in enumerate(e_marks):
            (hits, conn, db, c_error), (e_hits, api, e_error) = c.split("|"), e.split("|")
            first = [r for r in hits.split(",") if r and r in e_hits.split(",")]
            extra = [score for holds, score in ((conn + e_error, 0.70), (db + api, 0.65), (c_error + e_error, 0.50)) if holds == "11"]
            domain[i, j] = rules[int(first[0])][2] if first else (extra + [R.STREAM_DOMAIN_DEFAULT])[0]
    domain, of = np.unique(domain, axis=0, return_inverse=True)  # marks with equal scores are one class
    number = lambda name, values, at: R.lookup(F.col(name), {v: int(at[i]) for i, v in enumerate(values)}, F.lit(0)) if values else F.lit(0)
    return marks, domain, number("c_mark", c_marks, of.ravel()), number("e_mark", e_marks, range(len(e_marks)))


def best_causes_stream(episodes: DataFrame, edges: DataFrame, window_min: int = 15, max_hops: int = 3, weights=(0.3, 0.3, 0.4), rules=None,
                       top_m: int = 5, slices: DataFrame | None = None) -> DataFrame:
    """The best ``top_m`` rows of each effect in :func:`scored_causes_stream`, with rank and slice, without forming the pairs.

    Inside a class of causes with equal domain scores and at equal hops a score only falls with age, as in
    :func:`build_causality`. ``slices`` (client_id, slice of two windows) keeps to effects in these; repeated events count once.
    """
    width = window_min * MINUTE_US
    marks, domain, cause, effect = _stream_marks(episodes, rules or R.STREAM_REASON_RULES)
    scoring = Elsewhere(width, domain, max_hops, weights, top_m)
    once = marks.select("client_id", "eid", "rid", "t", cause.alias("c"), effect.alias("e")).dropDuplicates(["client_id", "eid"])
    rows = sorted_rows(_stream_rows(once, edges, max_hops, F.col("c"), F.col("e")), width, slices)
    found = rows.mapInArrow(lambda batches: best_elsewhere(batches, scoring), _PAIRS + ", domain_score double, rank int, slice long")
    return _stream_scores(found, window_min, weights, "rank", "slice")


def stream_domain(rules=None) -> Column:
    extra = [
        (F.rlike(F.col("c_message"), F.lit(STREAM_TEXTS["conn"]))
         & (F.col("e_severity") == "ERROR"), 0.70),
        (F.rlike(F.col("c_message"), F.lit(STREAM_TEXTS["db"]))
         & F.rlike(F.col("e_message"), F.lit(STREAM_TEXTS["api"])), 0.65),
        ((F.col("c_severity") == "ERROR") & (F.col("e_severity") == "ERROR"), 0.50),
    ]
    return R.pair_score(F.col("c_reason"), F.col("e_reason"), rules or R.STREAM_REASON_RULES,
                        R.STREAM_DOMAIN_DEFAULT, extra)


def score_links_stream(links: DataFrame, episodes: DataFrame, window_min: int = 15,
                       weights=(0.3, 0.3, 0.4), rules=None) -> DataFrame:
    text = ["eid", "reason", "severity", "message"]
    named = (links.join(side(episodes, "c", text).withColumnRenamed("c_eid", "cause"),
                        ["client_id", "cause"])
             .join(side(episodes, "e", text).withColumnRenamed("e_eid", "effect"),
                   ["client_id", "effect"]))
    return _stream_scores(named.withColumn("domain_score", stream_domain(rules)), window_min, weights)


def _stream_scores(pairs: DataFrame, window_min: int, weights, *more: str) -> DataFrame:
    wt, wd, wk = weights
    millis = F.floor(F.col("gap_us") / 1000)
    scored = (pairs
              .withColumn("temporal_score", 1.0 - millis / F.lit(60000.0 * window_min))
              .withColumn("distance_score", 1.0 / (F.col("hops") + 1.0)))
    return scored.withColumn(
        "confidence", F.col("temporal_score") * wt + F.col("distance_score") * wd
        + F.col("domain_score") * wk).select(*LINK_COLUMNS, "gap_us", *more)


# --- batch rebuild ------------------------------------------------------------------------

def adaptive_window_min(reason: Column) -> Column:
    return R.first_match([(R.matches_any(reason, p), n) for p, n in R.ADAPTIVE_WINDOWS],
                         R.ADAPTIVE_WINDOW_DEFAULT)


def batch_temporal(seconds: Column) -> Column:
    return (F.when(seconds <= 0, F.lit(0.0)).when(seconds >= 300, F.lit(0.1))
            .otherwise(1.0 - (seconds.cast("double") / 300.0) * 0.9))


def batch_distance(hops: Column) -> Column:
    return (F.when(F.col("c_s_name") == F.col("e_s_name"), F.lit(0.95))
            .when(hops == 1, F.lit(0.85)).when(hops == 2, F.lit(0.70))
            .when(hops == 3, F.lit(0.55))
            .when((F.col("c_s_ns") == F.col("e_s_ns")) & (F.col("c_s_kind") == F.col("e_s_kind")),
                  F.lit(0.40)).otherwise(F.lit(0.20)))


_C = ["c_eid", "c_rid", "c_reason", "c_s_kind", "c_s_ns", "c_s_name"]
_E = ["e_eid", "e_rid", "e_reason", "e_s_kind", "e_s_ns", "e_s_name"]


def _batch_sides(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (side(episodes, "c").select("client_id", "c_t", *_C),
            side(episodes, "e").select("client_id", "e_t", *_E))


def window_pairs(episodes: DataFrame) -> DataFrame:
    """All same-tenant pairs inside the adaptive window of the cause (strict on both ends)."""
    c, e = _batch_sides(episodes)
    gap = F.col("e_t") - F.col("c_t")
    inside = (gap > 0) & (gap < adaptive_window_min(F.col("c_reason")) * F.lit(MINUTE_US))
    return range_join(c, e, ["client_id"], R.ADAPTIVE_WINDOW_MAX * MINUTE_US, inside)


def with_hops(pairs: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    asked = pairs.select("client_id", F.col("c_rid").alias("src"), F.col("e_rid").alias("dst"))
    found = reach.hops(asked, edges, k).select(
        "client_id", F.col("src").alias("c_rid"), F.col("dst").alias("e_rid"), "hops")
    return pairs.join(found, ["client_id", "c_rid", "e_rid"], "left")


def score_links_batch(pairs: DataFrame, rules=None, weights=(0.4, 0.3, 0.3)) -> DataFrame:
    rules = R.BATCH_DOMAIN_RULES if rules is None else rules
    wt, wd, wk = weights
    gap = F.col("e_t") - F.col("c_t")
    seconds = F.floor(gap / MICROS).cast("long")
    return (pairs
            .withColumn("gap_us", gap).withColumn("time_gap_seconds", seconds)
            .withColumn("temporal_score", batch_temporal(seconds))
            .withColumn("distance_score", batch_distance(F.col("hops")))
            .withColumn("domain_score", R.pair_score(F.col("c_reason"), F.col("e_reason"), rules,
                                                     R.BATCH_DOMAIN_DEFAULT))
            .withColumn("conf", wt * F.col("temporal_score") + wd * F.col("distance_score")
                        + wk * F.col("domain_score")))


def _best(scored: DataFrame, min_conf: float, top_m: int) -> DataFrame:
    w = W.partitionBy("client_id", "e_eid").orderBy(F.desc("conf"), "gap_us", "c_eid")
    return (scored.where(F.col("conf") > min_conf)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_m))


def top_causes(scored: DataFrame, min_conf: float = 0.3, top_m: int = 5) -> DataFrame:
    """Best ``top_m`` causes per effect. The rank filter is pushed below the shuffle."""
    return _best(scored, min_conf, top_m).select(
        "client_id", F.col("c_eid").alias("cause"), F.col("e_eid").alias("effect"),
        F.coalesce("hops", F.lit(0)).alias("hops"),
        round_to(F.col("temporal_score")).alias("temporal_score"),
        round_to(F.col("distance_score")).alias("distance_score"),
        round_to(F.col("domain_score")).alias("domain_score"),
        round_to(F.col("conf")).alias("confidence"), "time_gap_seconds", "rank")


def build_causality(episodes: DataFrame, edges: DataFrame, rules=None, min_conf: float = 0.3,
                    top_m: int = 5, weights=(0.4, 0.3, 0.3), effects: DataFrame | None = None) -> DataFrame:
    """Best causes of every event (of ``effects``, if given), all tenants in one job, without forming the pairs.

    The work is linear in the events, whatever their density and whatever the rules. Causes that share window and
    matched rules are a class, in which the score of a pair only falls with its age
    (:mod:`causalspark.operators.latest`). A pair is scored with the relation of the groups it meets in; the nearest
    is its own, and a pair among the best of all is among the best there. So the pass gives the links as they are, and
    only events are shuffled.
    """
    rules = R.BATCH_DOMAIN_RULES if rules is None else rules
    c, e = _batch_sides(episodes)
    e = e if effects is None else _batch_sides(effects)[1]
    scoring, classes, signatures = _pass_scoring(c, e, rules, top_m, min_conf, weights)
    rows = sorted_rows(probe_rows(c, e, edges, rules, classes, signatures), R.ADAPTIVE_WINDOW_MAX * MINUTE_US)
    found = rows.mapInArrow(lambda batches: best_earlier(batches, scoring), _PAIRS + ", distance_score double, domain_score double, rank int")
    wt, wd, wk = weights
    seconds = F.floor(F.col("gap_us") / MICROS).cast("long")
    conf = wt * batch_temporal(seconds) + wd * F.col("distance_score") + wk * F.col("domain_score")
    return found.select("client_id", "cause", "effect", "hops", round_to(batch_temporal(seconds)).alias("temporal_score"),
                        round_to(F.col("distance_score")).alias("distance_score"), round_to(F.col("domain_score")).alias("domain_score"),
                        round_to(conf).alias("confidence"), seconds.alias("time_gap_seconds"), "rank")


def _hits(rules) -> Column:
    """Numbers of the rules whose cause part the reason matches."""
    return F.array_compact(F.array(*[F.when(R.matches(F.col("c_reason"), c), F.lit(i))
                                     for i, (c, _, _) in enumerate(rules)]))


def _effect_hits(rules) -> Column:
    """Numbers of the rules whose effect part the reason matches."""
    return F.array_compact(F.array(*[F.when(R.matches_any(F.col("e_reason"), e), F.lit(i))
                                     for i, (_, e, _) in enumerate(rules)]))


def _signature(hits: Column) -> Column:
    return F.array_join(hits, ",")


def cause_classes(causes: DataFrame, rules) -> list[tuple[int, tuple[int, ...]]]:
    """The (window, matched rules) that occur: at most as many as there are distinct reasons."""
    found = causes.select(adaptive_window_min(F.col("c_reason")).alias("w"), _hits(rules).alias("sig")).distinct().collect()
    return sorted((int(r["w"]), tuple(r["sig"])) for r in found)


def _pass_scoring(causes: DataFrame, effects: DataFrame, rules, top_m: int, min_conf: float, weights
                  ) -> tuple[Scoring, dict[str, int], dict[str, int]]:
    """Scores by class and signature, and the numbers of both."""
    classes = cause_classes(causes, rules)
    name = lambda s: ",".join(map(str, s))
    found = effects.select(_signature(_effect_hits(rules)).alias("s")).distinct().collect()  # bounded as the classes are
    signatures = sorted(r["s"] for r in found)
    domain = np.full((max(1, len(classes)), max(1, len(signatures))), float(R.BATCH_DOMAIN_DEFAULT))
    for i, (_, hits) in enumerate(classes):
        for j, signature in enumerate(signatures):
            both = [r for r in hits if str(r) in signature.split(",")]
            if both:
                domain[i, j] = rules[both[0]][2]
    # probe kinds: tenant, namespace and kind, name, meeting vertex at distance 0 to 3
    distance, steps = np.zeros((7, 4)), np.zeros((7, 4), np.int64)
    distance[:3, 0] = (0.20, 0.40, 0.95)
    for e in range(4):
        for c in range(4):
            if 1 <= e + c <= 3:
                distance[3 + e, c], steps[3 + e, c] = {1: 0.85, 2: 0.70, 3: 0.55}[e + c], e + c
    scoring = Scoring(np.array([w * MINUTE_US for w, _ in classes] or [0], np.int64), domain, distance, steps, 300.0, weights, min_conf, top_m)
    return scoring, {f"{w}|{name(s)}": i for i, (w, s) in enumerate(classes)}, {s: i for i, s in enumerate(signatures)}


def probe_rows(causes: DataFrame, effects: DataFrame, edges: DataFrame, rules, classes: dict[str, int], signatures: dict[str, int]) -> DataFrame:
    """Causes and probes with their groups, as rows of the sorted pass.

    A pair meets in the tenant's group, in that of its namespace and kind, of its name, and at vertices between its
    resources.
    """
    number = lambda table, key: R.lookup(key, table, F.lit(0)) if table else F.lit(0)
    own = F.concat(adaptive_window_min(F.col("c_reason")).cast("string"), F.lit("|"), _signature(_hits(rules)))
    plain = lambda df, p, what: df.select("client_id", *[F.col(f"{p}_{x}").alias(x) for x in ("eid", "rid", "t", "s_kind", "s_ns", "s_name")],
                                          what.cast("int").alias("what"))
    both = plain(causes, "c", -1 - number(classes, own)).unionByName(plain(effects, "e", number(signatures, _signature(_effect_hits(rules)))))
    group = lambda g, kind: F.struct(g.alias("g"), F.when(F.col("what") < 0, 0).otherwise(kind).alias("kind"))
    shared = F.array(group(F.lit("*"), 0), group(F.concat(F.lit("k@"), "s_ns", F.lit("|"), "s_kind"), 1), group(F.concat(F.lit("n@"), "s_name"), 2))
    met = F.transform(F.coalesce("spots", F.array()), lambda s: F.struct(
        F.concat(F.lit("v@"), s.x).alias("g"), (s.d + F.when(F.col("what") < 0, 0).otherwise(3)).alias("kind")))
    rows = both.join(_spots(edges, 3), ["client_id", "rid"], "left").withColumn(
        "all", F.filter(F.concat(shared, met), lambda s: s.g.isNotNull()))
    return rows.select("client_id", "eid", "t", "what", F.col("all.g").alias("groups"), F.col("all.kind").alias("kinds"))


def rescore_links(links: DataFrame, episodes: DataFrame, edges: DataFrame, rules=None,
                  weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """Score links that have no confidence from their events and the topology; others stay."""
    c, e = _batch_sides(episodes)
    holes = links.where("confidence IS NULL").select("client_id", F.col("cause").alias("c_eid"), F.col("effect").alias("e_eid"))
    pairs = holes.join(c, ["client_id", "c_eid"]).join(e, ["client_id", "e_eid"])
    scored = score_links_batch(with_hops(pairs, edges), rules, weights)
    new = scored.select("client_id", F.col("c_eid").alias("cause"), F.col("e_eid").alias("effect"),
                        *[round_to(F.col(c)).alias(f"new_{c}") for c in ("temporal_score", "distance_score", "domain_score")],
                        round_to(F.col("conf")).alias("new_confidence"))
    out = links.join(new, ["client_id", "cause", "effect"], "left")
    for column in ("temporal_score", "distance_score", "domain_score", "confidence"):
        out = out.withColumn(column, F.coalesce(column, f"new_{column}")).drop(f"new_{column}")
    return out


def build_causality_basic(episodes: DataFrame, min_conf: float = 0.3, window_min: int = 10
                          ) -> DataFrame:
    """Fixed window, rules that look at the resource, no topology; every link above the bar."""
    same_name = F.col("c_s_name") == F.col("e_s_name")
    same_ns = F.col("c_s_ns") == F.col("e_s_ns")
    same_kind = same_ns & (F.col("c_s_kind") == F.col("e_s_kind"))
    c_reason, e_reason = F.col("c_reason"), F.col("e_reason")
    domain = R.first_match([
        ((c_reason == "OOMKilled") & e_reason.isin("BackOff", "Failed", "Killing"), 0.95),
        (F.contains(c_reason, F.lit("ImagePull")) & e_reason.isin("Failed", "BackOff"), 0.90),
        ((c_reason == "Failed") & F.contains(F.col("c_message"), F.lit("pull"))
         & (e_reason == "BackOff"), 0.90),
        ((c_reason == "Unhealthy") & e_reason.isin("BackOff", "Failed", "Killing"), 0.80),
        ((c_reason == "Failed") & (e_reason == "BackOff"), 0.85),
        (c_reason.isin("FailedMount", "FailedScheduling")
         & e_reason.isin("BackOff", "Failed"), 0.80),
        (same_name, 0.65), (same_kind, 0.50), (same_ns, 0.40)], 0.30)
    distance = R.first_match([(same_name, 0.95), (same_kind, 0.60), (same_ns, 0.40)], 0.20)
    gap = F.col("e_t") - F.col("c_t")
    width = window_min * MINUTE_US
    pairs = range_join(side(episodes, "c"), side(episodes, "e"), ["client_id"], width,
                       (gap > 0) & (gap < width))
    seconds = F.floor(gap / MICROS).cast("long")
    scored = (pairs.withColumn("time_gap_seconds", seconds)
              .withColumn("temporal_score", batch_temporal(seconds))
              .withColumn("distance_score", distance).withColumn("domain_score", domain)
              .withColumn("conf", 0.4 * F.col("temporal_score") + 0.3 * F.col("distance_score")
                          + 0.3 * F.col("domain_score")))
    return scored.where(F.col("conf") > min_conf).select(
        "client_id", F.col("c_eid").alias("cause"), F.col("e_eid").alias("effect"),
        round_to(F.col("temporal_score")).alias("temporal_score"),
        round_to(F.col("distance_score")).alias("distance_score"),
        round_to(F.col("domain_score")).alias("domain_score"),
        round_to(F.col("conf")).alias("confidence"), "time_gap_seconds")


def rebuild_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links per tenant before and after a rebuild."""
    b = before.groupBy("client_id").agg(F.count("*").alias("links_before"))
    a = after.groupBy("client_id").agg(F.count("*").alias("links_after"))
    return (a.join(b, "client_id", "full_outer").na.fill(0)
            .withColumn("added", F.col("links_after") - F.col("links_before")))


# --- correlations -------------------------------------------------------------------------

def sequence_pairs(first: DataFrame, second: DataFrame, keys: list[str], max_gap_s: int,
                   allow_equal: bool = False) -> DataFrame:
    """(first, second) pairs with equal keys and a gap of at most ``max_gap_s``.

    ``keys`` are column names of episodes, for example ``["client_id", "rid"]``.
    """
    cols = [c for c in _SIDE if c not in keys]
    pick = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cols])
    gap = F.col("e_t") - F.col("c_t")
    strict = (gap >= 0) & (F.col("c_eid") != F.col("e_eid")) if allow_equal else gap > 0
    return range_join(pick(first, "c"), pick(second, "e"), keys, max_gap_s * MICROS, strict
                      ).withColumn("gap_us", gap)


def correlated_failures(episodes: DataFrame, max_gap_s: int = 300) -> DataFrame:
    """Earlier WARNING/ERROR and later ERROR/FATAL on one resource."""
    return sequence_pairs(episodes.where(F.col("severity").isin("WARNING", "ERROR")),
                          episodes.where(is_failure(F.col("severity"))),
                          ["client_id", "rid"], max_gap_s)


def with_link_flag(pairs: DataFrame, links: DataFrame) -> DataFrame:
    known = links.select("client_id", F.col("cause").alias("c_eid"), F.col("effect").alias("e_eid"),
                         F.lit(True).alias("linked"))
    return pairs.join(known, ["client_id", "c_eid", "e_eid"], "left").withColumn(
        "linked", F.coalesce("linked", F.lit(False)))


def warnings_with_failures(episodes: DataFrame, max_gap_s: int = 600) -> DataFrame:
    """Every warning with the number and first reason of the failures that follow it."""
    warn = episodes.where(F.col("severity") == "WARNING")
    fail = episodes.where(is_failure(F.col("severity")))
    pairs = sequence_pairs(warn, fail, ["client_id", "rid"], max_gap_s)
    after = pairs.groupBy("client_id", F.col("c_eid").alias("eid")).agg(
        F.count("*").alias("failures"),
        F.min_by("e_reason", F.struct("e_t", "e_eid")).alias("first_failure"),
        F.max("gap_us").alias("last_gap_us"))
    return warn.select("client_id", "eid", "rid", "reason").join(
        after, ["client_id", "eid"], "left").na.fill(0, ["failures", "last_gap_us"]).na.fill(
        "", ["first_failure"])


def concurrent_failures(episodes: DataFrame, keys: list[str], max_gap_s: int) -> DataFrame:
    """Failures of other resources within ``max_gap_s`` on either side (each pair once)."""
    fail = episodes.where(is_failure(F.col("severity")))
    cols = ["eid", "rid", "t", "reason"]
    pick = lambda p: fail.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in cols])
    order = F.struct("c_t", "c_eid") < F.struct("e_t", "e_eid")
    return near_join(pick("c"), pick("e"), keys, max_gap_s * MICROS,
                     (F.col("c_rid") != F.col("e_rid")) & order
                     ).withColumn("gap_us", F.abs(F.col("e_t") - F.col("c_t")))


def alerts_with_events(episodes: DataFrame, max_gap_s: int = 300) -> DataFrame:
    """Alert and cluster events on the same resource within the gap, on either side."""
    cols = ["eid", "t", "reason"]
    pick = lambda df, p: df.select("client_id", "rid", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    return near_join(pick(episodes.where("etype = 'prom.alert'"), "c"),
                     pick(episodes.where("etype = 'k8s.event'"), "e"),
                     ["client_id", "rid"], max_gap_s * MICROS
                     ).withColumn("gap_us", F.col("e_t") - F.col("c_t"))


def errors_before_fatal(episodes: DataFrame, window_s: int) -> DataFrame:
    """For each FATAL event: errors before it in the window, and the last of them."""
    is_error = F.col("severity") == "ERROR"
    rows = sliding(episodes, ["client_id", "rid"], window_s * MICROS, 0, {
        "errors_before": ("count", F.when(is_error, 1)),
        "last_error": ("max", F.when(is_error, F.struct("t", "eid", "reason")))})
    return rows.where("severity = 'FATAL'").select(
        "client_id", "eid", "rid", "t", "errors_before",
        F.coalesce("last_error.eid", F.lit("")).alias("last_error"),
        F.coalesce("last_error.reason", F.lit("")).alias("last_error_reason"))


def changes_before(changes: DataFrame, incidents: DataFrame, minutes: int = 30) -> DataFrame:
    """Change rows (client_id, rid, t, ...) in the minutes before an incident starts."""
    c = changes.withColumnRenamed("t", "c_t")
    e = incidents.withColumnRenamed("window_start", "e_t")
    return range_join(c, e, ["client_id"], minutes * MINUTE_US)


def error_cascades(episodes: DataFrame, max_gap_s: int = 300) -> DataFrame:
    """Each error with what follows inside the gap in its tenant.

    The followers are summarised (count, distinct reasons, span): listing them would repeat
    every event of a busy tenant once per earlier event.
    """
    fail = episodes.where(is_failure(F.col("severity")))
    rows = sliding(fail, ["client_id"], 0, max_gap_s * MICROS, {
        "at_or_after": ("count", F.lit(1)), "end_t": ("max", F.col("t")),
        "reasons": ("set", F.col("reason"))})
    same = rows.groupBy("client_id", "t").agg(F.count("*").alias("at_same_time"))
    return rows.join(same, ["client_id", "t"]).select(
        "client_id", "eid", "reason", "t",
        (F.col("at_or_after") - F.col("at_same_time")).alias("followers"),
        (F.col("end_t") - F.col("t")).alias("span_us"), F.array_sort("reasons").alias("reasons"))


# --- checks and adjustments ---------------------------------------------------------------

def named_links(links: DataFrame, episodes: DataFrame, columns=None) -> DataFrame:
    """Links with the columns of both events (``c_*`` and ``e_*``)."""
    cols = ["eid"] + [c for c in (columns or ["reason", "severity", "rid", "t", "etype",
                                              "s_kind", "s_ns", "s_name"]) if c != "eid"]
    return (links.join(side(episodes, "c", cols).withColumnRenamed("c_eid", "cause"),
                       ["client_id", "cause"])
            .join(side(episodes, "e", cols).withColumnRenamed("e_eid", "effect"),
                  ["client_id", "effect"]))


def temporal_validity(named: DataFrame) -> DataFrame:
    gap = F.floor((F.col("e_t") - F.col("c_t")) / MICROS)
    label = (F.when(gap > 0, "cause before effect").when(gap == 0, "same time")
             .otherwise("cause after effect"))
    counted = named.groupBy("client_id", label.alias("ordering")).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("client_id"))
    return counted.withColumn("percentage", round_to(share, 2))


def cross_tenant_rows(rows: DataFrame, left: DataFrame, right: DataFrame, left_key: str,
                      right_key: str, id_col: str) -> DataFrame:
    """Rows (links or edges) whose ends belong to different tenants.

    ``left`` and ``right`` hold (client_id, id) of the end nodes.
    """
    l = left.select(F.col(id_col).alias(left_key), F.col("client_id").alias("left_client"))
    r = right.select(F.col(id_col).alias(right_key), F.col("client_id").alias("right_client"))
    return rows.join(l, left_key).join(r, right_key).where(
        ~F.col("left_client").eqNullSafe(F.col("right_client")))


def adjust_confidence(named: DataFrame, episodes: DataFrame, window_min: int = 60) -> DataFrame:
    """Raise confidence when the cause reason keeps recurring before the cause event."""
    counts = sliding(episodes.select("client_id", "eid", "reason", "t"), ["client_id", "reason"],
                     window_min * MINUTE_US, 0, {"recent": ("count", F.lit(1))})
    joined = named.join(counts.select("client_id", F.col("eid").alias("cause"), "recent"),
                        ["client_id", "cause"])
    crash = F.col("c_reason").isin("OOMKilled", "CrashLoopBackOff") & (F.col("recent") > 3)
    factor = (F.when(F.col("recent") > 5, 1.2).otherwise(1.0)
              * F.when(crash, 1.3).otherwise(1.0))
    return joined.withColumn("adjusted", F.least(F.lit(1.0), F.col("confidence") * factor))
