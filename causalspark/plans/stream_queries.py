"""Named queries for streaming (ST rows): each runs its stream over the sample's event files
until nothing is left, and returns what the sink holds."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from causalspark.functions.scalar import DAY_US, MINUTE_US, round_to
from causalspark.operators import health, linktable, topology
from causalspark.plans.causal_queries import STREAM_PAIRS, STREAM_SCORED
from causalspark.plans.incident_queries import FINGERPRINT
from causalspark.plans.ingest_queries import _raw_events
from causalspark.plans.health_queries import ATK, RANKS
from causalspark.plans.registry import query
from causalspark.plans.sqltables import r3
from causalspark.session import shared_folder
from causalspark.sources import records, topics
from causalspark.streaming import jobs
from causalspark.streaming.store import KeyedStore


class Run:
    """Folders of one streaming run under the shared checkpoint folder."""

    def __init__(self, x):
        self.spark = x.spark
        self.base = f"{shared_folder(x.spark)}/streams/{uuid.uuid4().hex}"
        self.out, self.state = f"{self.base}/out", f"{self.base}/state"

    def append(self, df, mode="append"):
        with self.state_partitions():
            jobs.run_available(df, self.out, self.state, mode)
        return self.spark.read.schema(df.schema).parquet(self.out)

    def batches(self, df, handler):
        with self.state_partitions():
            jobs.run_batches(df, handler, self.state)

    @contextmanager
    def state_partitions(self):
        """A run that ends by itself needs no more state partitions than twice the cores."""
        name = "spark.sql.shuffle.partitions"
        before = self.spark.conf.get(name)
        wanted = min(int(before), 2 * self.spark.sparkContext.defaultParallelism)
        self.spark.conf.set(name, str(wanted))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)


#: Micro-batches of the streams that come in several, and rows that a file of theirs holds at least, if there is more than one.
BATCHES, FILE_ROWS = 12, 500_000


def arriving(x, jitter_us=10 * MINUTE_US, straggler_us=0):
    """The event table as a stream of BATCHES equal sets of files, read one per trigger, in the order of arrival.

    Arrival is event time plus up to ``jitter_us`` by the event's hash; alerts arrive ``straggler_us`` later still.
    """
    folder = "".join(c if c.isalnum() else "_" for c in x.directory)
    path = f"{shared_folder(x.spark)}/arriving/{folder}-{jitter_us}-{straggler_us}"
    key = (x.spark.sparkContext.applicationId, path)
    if key not in _WRITTEN:
        came = F.col("t") + F.pmod(F.xxhash64("eid"), F.lit(jitter_us)) + F.when(F.col("etype") == "prom.alert", straggler_us).otherwise(0)
        rows = x.episodes.withColumn("came", came)
        cuts = rows.agg(F.percentile_approx("came", [i / BATCHES for i in range(1, BATCHES)], 1000)).first()[0]
        part = sum(((F.col("came") > c).cast("int") for c in cuts), F.lit(0))
        counts = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
        files = max(1, min(counts.get(i, 0) for i in range(BATCHES)) // FILE_ROWS)  # so that none is empty, and a trigger takes one set
        for i in range(BATCHES):  # one after the other: a file source reads the oldest file first
            rows.where(part == i).drop("came").repartition(files).write.mode("append").parquet(path)
        _WRITTEN[key] = files
    return x.spark.readStream.schema(x.episodes.schema).option("maxFilesPerTrigger", _WRITTEN[key]).parquet(path)


#: Files of a set, by application and folder.
_WRITTEN: dict[tuple[str, str], int] = {}


def event_stream(x):
    """The stored event table as a file stream."""
    folder = "".join(c if c.isalnum() else "_" for c in x.directory)
    return x.spark.readStream.schema(x.episodes.schema).parquet(f"{shared_folder(x.spark)}/tables/{folder}/episodes")


@query("st1_topic_dispatch", "SELECT CASE etype WHEN 'k8s.log' THEN 'logs' ELSE 'events' END AS topic, count(*) AS n FROM episodes GROUP BY 1")
def st1(x):
    run = Run(x)
    rows = event_stream(x).withColumn("topic", F.when(F.col("etype") == "k8s.log", "logs").otherwise("events"))
    run.batches(rows, jobs.dispatch({t: jobs.to_folder(f"{run.out}/{t}") for t in ("logs", "events")}))
    read = lambda t: x.spark.read.parquet(f"{run.out}/{t}").groupBy("topic").agg(F.count("*").alias("n"))
    return read("logs").unionByName(read("events"))


@query("st2_upsert_state", "SELECT client_id, rid, at_us AS changed_at, offset_ AS change, phase FROM (SELECT *, row_number() OVER (PARTITION BY client_id, rid ORDER BY at_us DESC, offset_ DESC) AS n FROM resource_changes) WHERE n = 1 AND op <> 'DELETE'")
def st2(x):
    run = Run(x)
    source = f"{run.base}/changes"
    x.resource_changes.repartition(BATCHES).write.parquet(source)  # dealt out without regard to time: changes come out of order
    schema = x.resource_changes.schema
    stream = x.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = KeyedStore(run.out, ("client_id", "rid"), schema, buckets=16)
    run.batches(stream, table.merge)
    return table.read(x.spark).select("client_id", "rid", F.col("at").alias("changed_at"), F.col("offset").alias("change"), "phase")


@query("st3_deduplicated", "SELECT client_id, eid FROM episodes")
def st3(x):
    twice = arriving(x).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return Run(x).append(jobs.deduplicated(twice)).select("client_id", "eid")


@query("st4_causal_links", f"""SELECT client_id, cause, effect, hops, {r3('temporal_score * 0.3 + distance_score * 0.3 + domain_score * 0.4', 6)} AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY client_id, effect ORDER BY temporal_score * 0.3 + distance_score * 0.3 + domain_score * 0.4 DESC, gap_us, cause) AS rank FROM stream_scored) WHERE rank <= 5""",
       {"stream_pairs": STREAM_PAIRS, "stream_scored": STREAM_SCORED})
def st4(x):
    run = Run(x)
    run.batches(event_stream(x), jobs.write_links(run.out, x.edges, top_m=5))
    return jobs.read_links(x.spark, run.out).select("client_id", "cause", "effect", "hops", round_to(F.col("confidence"), 6).alias("confidence"))


@query("st4_late_repair", "SELECT client_id, cause, effect, hops, temporal_score, distance_score, domain_score, confidence, time_gap_seconds, rank FROM links")
def st4_late(x):
    """Alerts come six days late. What was on time is linked first; the late events then repair the slices they reach."""
    run = Run(x)
    stream = arriving(x, straggler_us=6 * DAY_US)
    run.batches(stream, jobs.split_late(run.out, 15 * MINUTE_US, jobs.to_folder(f"{run.out}/on_time")))
    kept = x.spark.read.schema(x.episodes.schema).parquet(f"{run.out}/on_time")
    late = jobs.read_late(x.spark, run.out, x.episodes.schema)
    path = f"{run.base}/links"
    linktable.rebuild(path, kept, x.edges)
    linktable.apply_changes(path, kept.unionByName(late), x.edges, late)
    return linktable.read(x.spark, path).drop("day")


ALERT_STATE = {
    "s1": f"SELECT *, {FINGERPRINT} AS fingerprint FROM episodes WHERE etype = 'prom.alert'",
    "s2": "SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client_id, fingerprint ORDER BY t, eid) <= 259200000000 THEN 0 ELSE 1 END AS new FROM s1",
    "s3": "SELECT *, sum(new) OVER (PARTITION BY client_id, fingerprint ORDER BY t, eid ROWS UNBOUNDED PRECEDING) AS g FROM s2",
    "s4": "SELECT *, row_number() OVER (PARTITION BY client_id, fingerprint, g ORDER BY t, eid) - 1 AS pos, min(t) OVER (PARTITION BY client_id, fingerprint, g) AS group_start FROM s3",
}


@query("st5_alert_groups", "SELECT client_id, fingerprint, eid, group_start, CAST(pos // 2 AS INTEGER) AS part, CASE WHEN pos % 2 = 0 THEN 'new' ELSE 'grouped' END AS action FROM s4, (SELECT max(t) AS now FROM episodes WHERE etype = 'prom.alert') WHERE (t // 60000000 + 1) * 60000 <= (now - 900000000) // 1000", ALERT_STATE)
def st5(x):
    """Alerts whose minute the watermark has passed; they arrive in twelve batches and out of order."""
    alerts = arriving(x).where("etype = 'prom.alert'")
    return Run(x).append(jobs.grouped_alerts(alerts, gap_min=3 * 1440, max_size=2)).drop("t")


@query("st6_escalations", """SELECT client_id, eid, n >= 2 AND severity IN ('WARNING','ERROR') AS escalated, CASE WHEN n >= 2 AND severity IN ('WARNING','ERROR') THEN n ELSE 0 END AS repeat_count,
    CASE WHEN n >= 2 AND severity = 'WARNING' THEN 'ERROR' WHEN n >= 2 AND severity = 'ERROR' THEN 'FATAL' ELSE severity END AS severity
  FROM (SELECT *, count(*) OVER (PARTITION BY client_id, rid, reason ORDER BY t RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) - 1 AS n FROM episodes), clock WHERE (t // 60000000 + 1) * 60000 <= (now - 900000000) // 1000""")
def st6(x):
    """Events whose minute the watermark has passed; they arrive in twelve batches and out of order."""
    return Run(x).append(jobs.escalations(arriving(x), window_min=7 * 1440, threshold=2))


@query("st7_incident_sessions", "SELECT client_id, resource_id, window_start, window_end, event_count, severity FROM incidents, clock WHERE window_end + 43200000000 <= now - 900000000")
def st7(x):
    """Sessions that the watermark has closed."""
    return Run(x).append(jobs.incident_sessions(arriving(x), gap="720 minutes"))


@query("st8_rate_windows", "SELECT client_id, severity, reason, n, window_start FROM (SELECT client_id, severity, reason, count(*) AS n, t // 3600000000 * 3600000000 AS window_start FROM episodes WHERE severity IN ('ERROR','FATAL') GROUP BY 1, 2, 3, 5), (SELECT max(t) AS newest FROM episodes WHERE severity IN ('ERROR','FATAL')) WHERE window_start + 3600000000 <= newest - 900000000")
def st8(x):
    return Run(x).append(jobs.rate_windows(arriving(x), "1 hour"))


@query("st9_enriched_alerts", "SELECT a.client_id, a.eid, coalesce(r.phase, '') AS phase, coalesce(r.node, '') AS node FROM episodes a LEFT JOIN resources r ON r.client_id = a.client_id AND r.rid = a.rid WHERE a.etype = 'prom.alert'")
def st9(x):
    alerts = event_stream(x).where("etype = 'prom.alert'").drop("node")
    return Run(x).append(jobs.enriched(alerts, x.resources).select("client_id", "eid", "phase", "node")).na.fill("")


@query("st10_liveness", "SELECT client_id, max(t) AS t, 'active' AS status FROM episodes GROUP BY 1 UNION ALL SELECT client_id, t + 60000000, 'stale' FROM (SELECT client_id, max(t) AS t FROM episodes GROUP BY 1), clock WHERE (t + 60000000) // 1000 < (now - 60000000) // 1000")
def st10(x):
    return Run(x).append(jobs.liveness_changes(event_stream(x), stale_min=1))


@query("st11_dead_letter_split", "SELECT 'ok' AS part, count(*) AS n FROM episodes WHERE reason <> 'LOG_INFO' AND severity <> 'FATAL' UNION ALL SELECT 'dead', count(*) FROM episodes WHERE reason = 'LOG_INFO' OR severity = 'FATAL'")
def st11(x):
    run = Run(x)
    raw = _raw_events(x)
    raw.write.parquet(f"{run.base}/raw")
    stream = x.spark.readStream.schema(raw.schema).parquet(f"{run.base}/raw")
    run.batches(stream, jobs.split_dead_letters(records.normalize_events, f"{run.out}/ok", f"{run.out}/dead"))
    read = lambda p: x.spark.read.parquet(f"{run.out}/{p}").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
    return read("ok").unionByName(read("dead"))


@query("st12_periodic_validation", ATK, RANKS)
def st12(x):
    """Each trigger measures the links that are stored at that moment, under its own version; the newest one is returned."""
    run = Run(x)

    def measure(batch, batch_id):
        r = health.accuracy_at_k(health.match_ranks(x.named_links, x.episodes, days=365, sample=None))
        jobs.to_folder(run.out)(r, batch_id)

    run.batches(event_stream(x), measure)
    measured = x.spark.read.parquet(run.out)
    return measured.where(F.col("batch") == measured.select(F.max("batch")).scalar()).drop("batch").withColumn("accuracy", round_to(F.col("accuracy"), 6)).withColumn(
        "mean_rank", round_to(F.col("mean_rank"), 6))


@query("st13_topology_republish", "SELECT client_id, kind AS item, count(*) AS n, 'node' AS part FROM resources GROUP BY 1, 2 UNION ALL SELECT client_id, type, count(*), 'edge' FROM edges GROUP BY 1, 2")
def st13(x):
    run = Run(x)
    build = lambda: topology.snapshot_totals(x.resources, x.edges)
    run.batches(event_stream(x), jobs.every_n_messages(100, build, run.out))
    versions = x.spark.read.parquet(run.out)
    return versions.where(F.col("version") == versions.select(F.max("version")).scalar()).drop("version")
