"""Streaming forms of the operators: the same column logic on unbounded input.

Every stream names its watermark. Late rows (older than the watermark) can be kept in a folder of
their own (:func:`split_late`), from which the link table is repaired (``operators.linktable``).
Sinks are idempotent per batch id, so a restarted batch writes the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causalspark.functions.scalar import MINUTE_US, is_failure
from causalspark.operators.causality import best_causes_stream
from causalspark.operators.incidents import alert_fingerprint
from causalspark.operators.timejoin import slice_of

LINK_WINDOW = "15 minutes"


def run_available(query_df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there into Parquet files and stop."""
    q = (query_df.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                mode: str = "append") -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# --- stateless sinks ------------------------------------------------------------------------

def dispatch(handlers: dict[str, Callable[[DataFrame, int], None]]):
    """foreachBatch function that gives each topic's rows to its handler."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for topic, handler in handlers.items():
                handler(batch.where(F.col("topic") == topic), batch_id)
        finally:
            batch.unpersist()
    return run


def to_folder(path: str):
    """Write a batch to its own folder; a retried batch overwrites itself."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return run


def split_dead_letters(normalize, ok_path: str, dead_path: str):
    """Normalize a batch once and write good and bad rows to two folders."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            ok, dead = normalize(batch)
            to_folder(ok_path)(ok, batch_id)
            to_folder(dead_path)(dead, batch_id)
        finally:
            batch.unpersist()
    return run


def split_late(path: str, delay_us: int, on_time: Callable[[DataFrame, int], None]):
    """Hand rows on unless they are older than the watermark, which go to ``path``/late_events.

    The watermark of a batch is the newest time of the batches before it less the delay, as Spark's own. Newest times
    lie in the sink, one per batch id, so a restart goes on from there, and a repeated batch draws the same line.
    """
    clock = f"{path}/clock"

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.agg(F.max("t").alias("newest")).write.mode("overwrite").parquet(f"{clock}/batch={batch_id}")
            newest = batch.sparkSession.read.schema("newest long, batch long").parquet(clock).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
            late = F.lit(False) if newest is None else F.coalesce(F.col("t") < newest - delay_us, F.lit(False))
            to_folder(f"{path}/late_events")(batch.where(late), batch_id)
            on_time(batch.where(~late), batch_id)
        finally:
            batch.unpersist()
    return run


def read_late(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that came too late."""
    return spark.read.schema(schema).parquet(f"{path}/late_events")


def every_n_messages(n: int, build: Callable[[], DataFrame], path: str):
    """Republish a table each time ``n`` more messages have arrived.

    The counts lie in the sink, one per batch id, so a restart goes on counting and a repeated
    batch replaces its own count.
    """
    counts = f"{path}_counts"

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{counts}/batch={batch_id}")
        seen = batch.sparkSession.read.parquet(counts).where(F.col("batch") <= batch_id).agg(
            F.sum("n").alias("after"), F.sum(F.when(F.col("batch") < batch_id, F.col("n"))).alias("before")).first()
        version = (seen["after"] or 0) // n
        if version > (seen["before"] or 0) // n:
            build().write.mode("overwrite").parquet(f"{path}/version={version}")
    return run


# --- windows ----------------------------------------------------------------------------------

def deduplicated(events: DataFrame, delay: str = LINK_WINDOW) -> DataFrame:
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["client_id", "eid"])


def rate_windows(events: DataFrame, width: str = "5 minutes", delay: str = LINK_WINDOW) -> DataFrame:
    """Failures per window, severity and reason."""
    fail = events.where(is_failure(F.col("severity"))).withWatermark("event_time", delay)
    g = fail.groupBy(F.window("event_time", width), "client_id", "severity", "reason").agg(F.count("*").alias("n"))
    return g.select("client_id", "severity", "reason", "n", F.unix_micros("window.start").alias("window_start"))


def incident_sessions(events: DataFrame, gap: str = LINK_WINDOW, min_events: int = 3,
                      delay: str = LINK_WINDOW) -> DataFrame:
    fail = events.where(is_failure(F.col("severity"))).withWatermark("event_time", delay)
    g = fail.groupBy(F.session_window("event_time", gap), "client_id", "rid").agg(
        F.count("*").alias("event_count"), F.max(F.col("severity") == "FATAL").alias("fatal"),
        F.max("t").alias("window_end"))
    return g.where(F.col("event_count") >= min_events).select(
        "client_id", F.col("rid").alias("resource_id"), F.unix_micros("session_window.start").alias("window_start"),
        "window_end", "event_count", F.when(F.col("fatal"), "FATAL").otherwise("ERROR").alias("severity"))


def enriched(alerts: DataFrame, resources: DataFrame) -> DataFrame:
    """Stream-static join with the current resource snapshot."""
    static = resources.select("client_id", "rid", "phase", "node", "owner")
    return alerts.join(static, ["client_id", "rid"], "left")


# --- causal links -----------------------------------------------------------------------------

_LINKED = "client_id string, eid string, rid string, t long, reason string, severity string, message string"


def write_links(path: str, edges: DataFrame, top_m: int = 5, window_min: int = 15, max_hops: int = 3):
    """Link each batch to what came before it, the best ``top_m`` causes of an effect, in whatever order events come.

    A new event is an effect, and a cause of those up to a window later. So the tenant's slices of two windows that it and
    the window after it lie in are linked anew, from the events of all batches so far, and stand under the batch's id;
    others stay. Events lie in the sink too, one folder per batch, so a repeated batch writes the same.
    """
    width = window_min * MINUTE_US

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        to_folder(f"{path}/events")(batch.select(*[c.split()[0] for c in _LINKED.split(", ")]), batch_id)
        came = spark.read.schema(f"{_LINKED}, batch long").parquet(f"{path}/events").where(F.col("batch") <= batch_id)
        reached = F.array_distinct(F.array(slice_of(F.col("t"), 2 * width), slice_of(F.col("t") + width, 2 * width)))
        to_folder(f"{path}/slices")(came.where(F.col("batch") == batch_id).select("client_id", F.explode(reached).alias("slice")).distinct(), batch_id)
        slices = spark.read.schema("client_id string, slice long").parquet(f"{path}/slices/batch={batch_id}")
        first, last = slices.agg(F.min("slice"), F.max("slice")).first()
        if first is None:
            return
        near = came.where((F.col("t") >= first * 2 * width - width) & (F.col("t") < (last + 1) * 2 * width))
        to_folder(f"{path}/links")(best_causes_stream(near, edges, window_min, max_hops, top_m=top_m, slices=slices), batch_id)
    return run


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """The links of each slice as the newest batch that reached it has written them."""
    newest = spark.read.schema("client_id string, slice long, batch long").parquet(f"{path}/slices").groupBy("client_id", "slice").agg(F.max("batch").alias("batch"))
    links = spark.read.parquet(f"{path}/links").withColumn("batch", F.col("batch").cast("long"))
    return links.join(newest, ["client_id", "slice", "batch"]).drop("slice", "batch")


# --- keyed state ------------------------------------------------------------------------------

ORDERED_STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: State keys that the keys of an ordered operator are dealt to.
SHARDS = 128


def to_bytes(pdf: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as rows:
        return rows.read_all().to_pandas()


class InOrder(StatefulProcessor):
    """Hands rows to ``step`` in event-time order, whatever order they arrive in.

    The state is by shard, not by key, so that calls to the state store and timers are few however many keys and minutes
    there are. A shard's rows wait as they came; its one timer stands at the end of its earliest waiting minute. When the
    watermark has passed that, ``step(rows, kept, floor)`` gets all rows whose minute it has passed and the shard's kept
    rows (or None), and gives output rows and the kept rows that times from ``floor`` on may still want.
    """

    def __init__(self, step: Callable, out: list[str], keep_us: int):
        self.step, self.out, self.keep_us = step, out, keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", "newest long, rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def arm(self, at: int | None) -> None:
        """The shard's only timer stands at ``at`` (ms)."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(rows, ignore_index=True)
        self.waiting.appendValue((to_bytes(came),))
        at = minute_end(int(came["t"].min()))
        if not self.timer.exists() or at < self.timer.get()[0]:
            self.arm(at)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        newest, kept = self.kept.get() if self.kept.exists() else (None, None)
        kept = None if kept is None else from_bytes(kept)
        held = [from_bytes(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        out = pd.DataFrame(columns=self.out)
        later = pd.concat(held, ignore_index=True) if held else None
        if later is not None:
            passed = minute_end(later["t"]) <= now
            rows, later = later[passed], later[~passed]
            if len(rows):
                out, kept = self.step(rows, kept, now // 60_000 * MINUTE_US)
                newest = max(int(rows["t"].max()), newest if newest is not None else -(1 << 62))
        self.waiting.clear()
        if later is not None and len(later):
            self.waiting.appendValue((to_bytes(later),))
        if newest is not None and now // 60_000 * MINUTE_US - self.keep_us > newest:
            newest = kept = None  # nothing that comes can want the kept rows
        if newest is None:
            self.kept.clear()
        else:
            self.kept.update((newest, to_bytes(kept)))
        ends = [minute_end(int(later["t"].min()))] if later is not None and len(later) else []
        ends += [minute_end(newest + self.keep_us) + 60_000] if newest is not None else []
        self.timer.clear()  # it has gone by itself
        self.arm(min(ends, default=None))
        yield out

    def close(self) -> None:
        pass


def minute_end(t):
    """End (ms) of the minute of a time or of times (us)."""
    return (t // MINUTE_US + 1) * 60_000


def in_order(rows: DataFrame, keys: list[str], step: Callable, output: str, keep_us: int) -> DataFrame:
    rows.sparkSession.conf.set(ORDERED_STATE, ROCKS)  # the state store that such operators need; read when the stream starts
    names = [c.split()[0] for c in output.split(", ")]
    shard = F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int")
    return rows.withColumn("shard", shard).groupBy("shard").transformWithStateInPandas(InOrder(step, names, keep_us), output, "append", "eventTime")


def numbers(frames: list[pd.DataFrame], keys: list[str]) -> list[np.ndarray]:
    """A number for each key, equal in all frames."""
    every = pd.concat([f[keys] for f in frames], ignore_index=True).groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    return np.split(every, np.cumsum([len(f) for f in frames])[:-1])


def grouped_alerts(alerts: DataFrame, gap_min: int = 5, max_size: int = 100, delay: str = LINK_WINDOW) -> DataFrame:
    """Alert groups: a group ends after a gap or at ``max_size``. Alerts are grouped once the watermark has passed their minute.

    The state is one small row per fingerprint and leaves after the gap. Repeated ids are dropped before (see
    :func:`deduplicated`).
    """
    gap, keys = gap_min * MINUTE_US, ["client_id", "fingerprint"]

    def step(rows, kept, floor):
        kept = pd.DataFrame({**{k: pd.Series(dtype=object) for k in keys}, **{c: pd.Series(dtype="int64") for c in ("last", "first", "count")}}) if kept is None else kept
        rows = rows.sort_values(["t", "eid"], kind="stable")
        mine, old = numbers([rows, kept], keys)
        order = np.argsort(mine, kind="stable")
        rows, mine = rows.iloc[order], mine[order]
        t, new = rows["t"].to_numpy(), np.r_[True, mine[1:] != mine[:-1]]
        place = np.full(max(mine.max(), old.max(initial=0)) + 1, -1)
        place[old] = np.arange(len(old))
        known = np.where(new, place[mine], -1)  # place of the kept row of a key's first row
        held = {c: np.r_[kept[c].to_numpy(), 0][known] for c in ("last", "first", "count")}
        before = np.where(new, held["last"], np.r_[0, t[:-1]])
        begins = (new & (known < 0)) | (t - before > gap)
        cut = begins | new
        at = np.flatnonzero(cut)
        of = np.cumsum(cut) - 1
        position = np.arange(len(t)) - at[of] + np.where(begins, 0, held["count"])[at][of]
        first = np.where(begins, t, held["first"])[at][of]
        out = pd.DataFrame({"client_id": rows["client_id"], "fingerprint": rows["fingerprint"], "eid": rows["eid"], "t": t, "group_start": first,
                            "part": (position // max_size).astype("int32"), "action": np.where(position % max_size == 0, "new", "grouped")})
        end = np.r_[new[1:], True]
        now = pd.DataFrame({**{k: rows[k].to_numpy()[end] for k in keys}, "last": t[end], "first": first[end], "count": position[end] + 1})
        other = kept[~np.isin(old, mine)]
        kept = pd.concat([f for f in (now, other) if len(f)], ignore_index=True)
        return out, kept[floor - gap <= kept["last"]]

    rows = alerts.withWatermark("event_time", delay).withColumn("fingerprint", alert_fingerprint())
    return in_order(rows.select("client_id", "fingerprint", "t", "eid", "event_time"), keys, step,
                    "client_id string, fingerprint string, eid string, t long, group_start long, part int, action string", gap)


def repeats(key: np.ndarray, t: np.ndarray, asked_key: np.ndarray, asked: np.ndarray, width: int) -> np.ndarray:
    """For each asked key and time, how many times of the key lie in ``[asked - width, asked]``."""
    every = np.unique(t)
    by = len(every) + 1
    have = np.sort(key * by + np.searchsorted(every, t))
    below = lambda place: np.searchsorted(have, asked_key * by + place)
    return below(np.searchsorted(every, asked, side="right")) - below(np.searchsorted(every, asked - width))


def escalations(events: DataFrame, window_min: int = 5, threshold: int = 3, delay: str = LINK_WINDOW) -> DataFrame:
    """Repeat counts per resource and reason, once the watermark has passed an event's minute.

    An event counts those at most ``window_min`` older than itself, and the equally old ones. The state holds the times
    of one window.
    """
    width, keys = window_min * MINUTE_US, ["client_id", "rid", "reason"]

    def step(rows, kept, floor):
        times = rows[[*keys, "t"]] if kept is None else pd.concat([kept, rows[[*keys, "t"]]], ignore_index=True)
        have, mine = numbers([times, rows], keys)
        earlier = repeats(have, times["t"].to_numpy(), mine, rows["t"].to_numpy(), width) - 1
        raised = (earlier >= threshold) & rows["severity"].isin(["WARNING", "ERROR"]).to_numpy()
        out = pd.DataFrame({"client_id": rows["client_id"], "eid": rows["eid"],
                            "severity": rows["severity"].where(~raised, rows["severity"].map({"WARNING": "ERROR", "ERROR": "FATAL"})),
                            "escalated": raised, "repeat_count": np.where(raised, earlier, 0)})
        return out, times[times["t"] >= floor - width]

    rows = events.withWatermark("event_time", delay)
    return in_order(rows.select("client_id", "rid", "reason", "t", "eid", "severity", "event_time"), keys, step,
                    "client_id string, eid string, severity string, escalated boolean, repeat_count long", width)


def liveness_changes(heartbeats: DataFrame, stale_min: int = 2, delay: str = "1 minute") -> DataFrame:
    """``active`` when a client first reports or comes back, ``stale`` when it stays silent."""
    silent = stale_min * MINUTE_US

    def step(key, frames, st: GroupState):
        columns = ["client_id", "t", "status"]
        if st.hasTimedOut:
            last, _ = st.get
            st.update((last, "stale"))
            yield pd.DataFrame([(key[0], last + silent, "stale")], columns=columns)
            return
        last, status = st.get if st.exists else (0, "")
        newest = max(int(pdf["t"].max()) for pdf in frames)
        out = [(key[0], newest, "active")] if status != "active" else []
        last = max(last, newest)
        st.update((last, "active"))
        st.setTimeoutTimestamp(max(last // 1000 + silent // 1000, st.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    rows = heartbeats.withWatermark("event_time", delay).select("client_id", "t", "event_time")
    return rows.groupBy("client_id").applyInPandasWithState(
        step, "client_id string, t long, status string", "last long, status string", "append",
        GroupStateTimeout.EventTimeTimeout)
