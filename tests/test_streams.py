"""Streams in many batches: restarts, retries, late rows, versions; and the repaired link table."""

import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causalspark.functions.scalar import DAY_US, MINUTE_US
from causalspark.operators import causality as L, incidents as I, linktable, state
from causalspark.streaming import jobs
from causalspark.streaming.store import KeyedStore
from tests.conftest import T0, rows
from tests.test_causality import _burst

CHANGES = "client_id string, rid string, at long, offset long, op string, phase string"


def _files(spark, df, folder, parts):
    """One file for each part, in this order."""
    for part in parts:
        df.join(spark.createDataFrame([(e,) for e in part], "eid string"), "eid").select(*df.columns).coalesce(1).write.mode("append").parquet(folder)


def test_keyed_store_versions(spark, tmp_path):
    rnd = random.Random(1)
    changes = [("ab"[i % 2], f"r{rnd.randrange(15)}", rnd.randrange(40), i, rnd.choice(["UPSERT", "UPSERT", "DELETE", None]), f"p{i}") for i in range(120)]
    rnd.shuffle(changes)
    frames = [spark.createDataFrame(changes[i:i + 12], CHANGES) for i in range(0, 120, 12)]
    store = KeyedStore(str(tmp_path), ("client_id", "rid"), frames[0].schema, buckets=8)
    assert store.read(spark).count() == 0
    for i, frame in enumerate(frames[:5]):
        store.merge(frame, i)
    pinned = rows(store.read(spark, 4))
    held = store.manifest(spark, 4)
    store.merge(frames[4], 4)  # again
    assert rows(store.read(spark, 4)) == pinned and store.manifest(spark, 4) == held
    for i, frame in enumerate(frames[5:], 5):
        store.merge(frame, i)
    assert rows(store.read(spark, 4)) == pinned
    live = state.latest_rows(spark.createDataFrame(changes, CHANGES), ["client_id", "rid"]).where("coalesce(op, 'DELETE') <> 'DELETE'")
    assert rows(store.read(spark), *CHANGES.replace(" string", "").replace(" long", "").split(", ")) == rows(live, *CHANGES.replace(" string", "").replace(" long", "").split(", "))
    store.merge(frames[0].where("client_id = 'a'").limit(1), 99)
    before, after = store.manifest(spark, 9), store.manifest(spark, 99)
    assert sum(before[b] != after[b] for b in after) == 1  # one key, one bucket


def test_late_rows_are_kept_over_a_restart(spark, make, tmp_path):
    times = [0, 100, 4000, 50, 3500, 4100, 200, 9000, 8500, 4000, 9100, 1]
    ep = make.episodes([(f"e{i}", s, "X", "p") for i, s in enumerate(times)])
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[f"e{i}", f"e{i + 1}"] for i in range(0, 12, 2)]
    _files(spark, ep, folder, parts)
    failed = []

    def sink(batch, batch_id):
        if batch_id == 3 and not failed:
            failed.append(batch_id)
            raise ValueError("executor lost")
        jobs.to_folder(f"{out}/on_time")(batch, batch_id)

    def run():
        stream = spark.readStream.schema(ep.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.run_batches(stream, jobs.split_late(out, 15 * MINUTE_US, sink), str(tmp_path / "state"))
    with pytest.raises(Exception, match="executor lost"):
        run()
    run()
    late, newest = set(), None
    for part in parts:
        got = [times[int(e[1:])] for e in part]
        late |= {e for e in part if newest is not None and times[int(e[1:])] < newest - 900}
        newest = max([*got, *([newest] if newest is not None else [])])
    kept = spark.read.schema(ep.schema).parquet(f"{out}/on_time")
    assert failed and late and {r[0] for r in rows(jobs.read_late(spark, out, ep.schema), "eid")} == late
    assert rows(kept.unionByName(jobs.read_late(spark, out, ep.schema)), "eid") == rows(ep, "eid")


def test_ordered_state_over_a_restart(spark, make, tmp_path):
    """Twelve files out of order, half of them after a restart, with one hot key: the same as the batch operator."""
    rnd = random.Random(2)
    times = sorted(rnd.sample(range(3600), 90))
    ep = make.episodes([(f"e{i:02d}", s, rnd.choice(["Hot", "Hot", "Cold"]), rnd.choice(["p", "p", "q"]), rnd.choice(["WARNING", "ERROR", "FATAL"])) for i, s in enumerate(times)]
                       + [("last", 9000, "Hot", "p")])
    came = sorted(range(90), key=lambda i: times[i] + rnd.randrange(600))
    parts = [[f"e{i:02d}" for i in came[k:k + 8]] for k in range(0, 90, 8)] + [["last"]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(ep.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.run_available(jobs.escalations(stream), out, str(tmp_path / "state"))
    _files(spark, ep, folder, parts[:6])
    run()
    _files(spark, ep, folder, parts[6:])
    run()
    columns = ["client_id", "eid", "severity", "escalated", "repeat_count"]
    want = I.escalate_severity(ep).where("eid <> 'last'")
    got = spark.read.parquet(out)
    assert got.where("escalated").count() > 5
    assert rows(got, *columns[:3], "repeat_count") == rows(want, *columns[:3], "repeat_count")


def _partition_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_repaired_links_equal_a_full_build(spark, make, tmp_path):
    ep, edges = _burst(make, 21, n=250, span=600)
    days = ep.withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).withColumn("t", F.col("t") + F.col("k") * DAY_US).withColumn(
        "eid", F.concat("eid", F.lit("d"), F.col("k").cast("string"))).drop("k")
    gone = days.where("eid IN ('e0005d1', 'e0100d1')")  # one that is no longer there, on another day than the new ones
    new = days.where("eid LIKE 'e00%d2' AND s_name = 'hot'")
    lost_edge = edges.where("type = 'CONTROLS' AND dst = 'pod:n1:p3'")
    path = str(tmp_path / "links")
    linktable.rebuild(path, days.join(new, "eid", "left_anti").select(*days.columns), edges)
    files = _partition_files(path)
    now = days.join(gone, "eid", "left_anti").select(*days.columns)
    columns = ["client_id", "effect", "rank", "cause", "confidence", "hops"]
    written = linktable.apply_changes(path, now, edges, new.unionByName(gone)).count()
    assert rows(linktable.read(spark, path), *columns) == rows(L.build_causality(now, edges), *columns)
    total = now.select("client_id", linktable.day_of(F.col("t"))).distinct().count()
    print(f"slices rewritten: {written} of {total}")
    assert written < total and files & _partition_files(path)
    fewer = edges.join(lost_edge, "id", "left_anti").select(*edges.columns)
    linktable.apply_changes(path, now, fewer, edges_before=edges)
    assert rows(linktable.read(spark, path), *columns) == rows(L.build_causality(now, fewer), *columns)


def test_arriving_sets_of_files(spark, monkeypatch):
    """Every trigger's set of files grows with the rows, holds its part of the arrivals, and no task reads the table whole."""
    from causalspark.plans import stream_queries as S
    from causalspark.plans.engine import Engine
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no sample data")
    x = Engine(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(S, "FILE_ROWS", 20)
    jitter = 7 * MINUTE_US
    stream = S.arriving(x, jitter)
    path, files = next((k[1], n) for k, n in S._WRITTEN.items() if k[1].endswith(f"-{jitter}-0"))
    found = sorted(_partition_files(path.removeprefix("file:")), key=os.path.getmtime)
    assert files > 1 and len(found) == S.BATCHES * files
    came = F.col("t") + F.pmod(F.xxhash64("eid"), F.lit(jitter))
    ends = [spark.read.parquet(*found[i:i + files]).agg(F.min(came), F.max(came)).first() for i in range(0, len(found), files)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert rows(S.Run(x).append(stream.select("eid"))) == rows(x.episodes.select("eid"))


def test_ordered_state_is_by_shard(spark, make, tmp_path, monkeypatch):
    """Many keys and minutes in three batches: few rows of state, the groups of the batch operator, and the minute that ends at the watermark is out."""
    rnd = random.Random(3)
    times = sorted(rnd.sample(range(60, 7200), 600))
    ep = make.episodes([(f"e{i:03d}", s, f"R{rnd.randrange(40)}", "p", "ERROR", "prom.alert") for i, s in enumerate(times)])
    end = (T0 // MINUTE_US + 200) * MINUTE_US  # the watermark comes to stand at the end of a minute
    last = make.episodes([("last", 0, "X", "p", "ERROR", "prom.alert"), ("edge", 0, "X", "q", "ERROR", "prom.alert")]).withColumn(
        "t", F.when(F.col("eid") == "last", end + 15 * MINUTE_US).otherwise(end - 1)).withColumn("event_time", F.timestamp_micros("t"))
    ep = ep.unionByName(last)
    came = sorted(range(600), key=lambda i: times[i] + rnd.randrange(600))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _files(spark, ep, folder, [[f"e{i:03d}" for i in came[:300]], [f"e{i:03d}" for i in came[300:]] + ["edge"], ["last"]])
    monkeypatch.setattr(jobs, "SHARDS", 8, raising=False)
    stream = spark.readStream.schema(ep.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (jobs.grouped_alerts(stream, gap_min=5, max_size=3).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 8 * 6
    got = spark.read.parquet(out)
    want = I.group_alerts(ep, gap_min=5, max_size=3).where("eid <> 'last'")
    assert rows(got, "client_id", "eid", "action") == rows(want, "client_id", "eid", "action")
    keys = ["client_id", "fingerprint"]
    names = lambda df, *ids: rows(df.groupBy(*keys, *ids).agg(F.min("eid").alias("a"), F.max("eid").alias("b"), F.count("*").alias("n")), "a", "b", "n")
    assert names(got, "group_start", "part") == names(want, "group_id") and got.where("part > 0").count() > 0


def test_streamed_links_over_batches(spark, make, tmp_path, monkeypatch):
    """Bursts on one resource, in batches out of order with a repeated event and a repeated batch: the best of all pairs. No pair is formed."""
    from causalspark.operators import latest
    ep, edges = _burst(make, 31, 400, 2500)
    texts = F.element_at(F.array(*[F.lit(m) for m in ("connection refused", "Database gone", "api down", "quiet")]), (F.crc32("eid") % 4 + 1).cast("int"))
    ep = ep.withColumn("message", texts).withColumn("severity", F.when(F.crc32(F.concat("eid", F.lit("s"))) % 3 == 0, "INFO").otherwise("ERROR")).cache()
    scored = L.score_links_stream(L.link_causes(ep, edges), ep)
    w = W.partitionBy("client_id", "effect").orderBy(F.desc("confidence"), "gap_us", "cause")
    want = scored.withColumn("rank", F.row_number().over(w)).where("rank <= 5").drop("gap_us")
    columns = ["client_id", "effect", "rank", "cause", "hops", "confidence"]
    assert scored.count() > 3 * want.count()
    # small batches of rows, so that causes are carried on
    marks, domain, cause, effect = L._stream_marks(ep, L.R.STREAM_REASON_RULES)
    table = L.sorted_rows(L._stream_rows(marks, edges, 3, cause, effect), 15 * MINUTE_US).coalesce(1).sortWithinPartitions("client_id", "slice", "t", F.desc("eid")).toArrow()
    for at_once in (1, 40):
        monkeypatch.setattr(latest, "ROWS", at_once)
        found = latest.best_elsewhere(iter(table.to_batches(3)), latest.Elsewhere(15 * MINUTE_US, domain, 3, (0.3, 0.3, 0.4), 5))
        assert sorted(tuple(r[c] for c in columns[:5]) for b in found for r in b.to_pylist()) == rows(want, *columns[:5])

    def pairs_formed(*_, **__):
        raise AssertionError("all pairs are formed")
    for name in ("link_stream", "score_links_stream"):
        monkeypatch.setattr(jobs, name, pairs_formed, raising=False)
    path = str(tmp_path / "links")
    write = jobs.write_links(path, edges, top_m=5)
    late = F.col("eid").isin("e0005", "e0100", "e0200")
    parts = [ep.where((F.col("t") < T0 + 1200 * 1_000_000) & ~late), ep.where((F.col("t") >= T0 + 1200 * 1_000_000) & ~late), ep.where(late | (F.col("eid") == "e0007"))]
    for i, part in enumerate(parts):
        write(part, i)
    write(parts[2], 2)
    write(parts[0].limit(0), 3)
    assert rows(jobs.read_links(spark, path), *columns) == rows(want, *columns)
