"""Event streams: decoding, routing, presence, dedup, rates and job state.

All functions take a DataFrame and work on a batch as well as on a stream,
unless they say otherwise. Event time is ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orgweave.operators.jobs import TERMINAL, job_state
from orgweave.operators.writes import upsert_latest
from orgweave.partitioning import range_buckets, running

WATERMARK = "10 minutes"

# The event types a message may carry.
EVENT_TYPES = [
    "job_started", "job_progress", "job_completed", "job_failed", "company_updated", "company_locked",
    "company_unlocked", "notification", "user_activity", "campaign_updated", "email_draft_updated",
]
MESSAGE = "struct<event:string,data:string,user_id:string,team_id:string,timestamp:timestamp>"


def read_events(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet",
                files_per_batch: int | None = 1) -> DataFrame:
    """A Parquet folder as a stream; with ``files_per_batch`` None, all that has arrived is one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def decode_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Message columns out of JSON text; undecodable rows are dropped."""
    parsed = F.when(F.try_parse_json(F.col(column)).isNotNull(), F.from_json(F.col(column), MESSAGE))
    return raw.select(parsed.alias("m")).where(F.col("m.event").isNotNull()).select("m.*")


def route_channels(messages: DataFrame) -> DataFrame:
    """One copy per channel: the user's, the team's, or the global one when neither is set."""
    user, team = F.col("user_id").cast("string"), F.col("team_id").cast("string")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    channels = F.filter(F.array(
        F.when(has(user), F.concat(F.lit("events:user:"), user)),
        F.when(has(team), F.concat(F.lit("events:team:"), team)),
        F.when(~has(user) & ~has(team), F.lit("events:global"))), lambda c: c.isNotNull())
    return messages.withColumn("channel", F.explode(channels))


def subscribe(routed: DataFrame, channels: list[str]) -> DataFrame:
    return routed.where(F.col("channel").isin(channels))


def presence(connections: DataFrame) -> DataFrame:
    """Open connections per user; users without one are not listed.

    ``connections``: user_id, connection_id, action. On a stream, use update
    mode and read the latest row per user: counts may drop to zero.
    """
    step = F.when(F.col("action") == "connect", 1).when(F.col("action") == "disconnect", -1).otherwise(0)
    return connections.groupBy("user_id").agg(F.sum(step).alias("connections"))


def active_users(counts: DataFrame) -> DataFrame:
    return counts.where("connections > 0")


def dedup_pages_stream(pages: DataFrame, content: str = "content") -> DataFrame:
    """First page per (domain, content hash), across restarts.

    Without a watermark the state keeps every hash ever seen; it is sharded by
    (domain, hash), so a huge domain is spread.
    """
    return pages.withColumn("content_hash", F.sha2(content, 256)).dropDuplicates(["domain", "content_hash"])


def dedup_pages_recent(pages: DataFrame, ts: str = "ts", content: str = "content", within: str = "30 days") -> DataFrame:
    """The same with bounded state: repeats are caught within the watermark."""
    hashed = pages.withColumn("content_hash", F.sha2(content, 256)).withWatermark(ts, within)
    return hashed.dropDuplicatesWithinWatermark(["domain", "content_hash"])


def rate_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", limit: int = 60,
                 watermark: str = WATERMARK) -> DataFrame:
    """Events per key and minute with a flag above the limit."""
    counted = events.withWatermark(ts, watermark).groupBy(F.window(ts, "1 minute"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("minute"), key, "n", (F.col("n") > limit).alias("over_limit"))


def recent_contact_guard(sends: DataFrame, history: DataFrame, days: int = 30) -> DataFrame:
    """Planned sends with ``suppressed`` true when their domain got one in the ``days`` before (batch form).

    Both tables are laid on one time line per domain, one entry per point in time, cut into
    ranges of (domain, time) that a task takes, and the last send before each point is
    carried forward; no pairs are built, and a busy domain or second is spread.
    """
    points = sends.select("domain", F.col("sent_at").alias("_at"), F.lit(None).cast("timestamp").alias("_sent")).unionByName(
        history.select("domain", F.col("sent_at").alias("_at"), F.col("sent_at").alias("_sent")))
    dealt = range_buckets(points.groupBy("domain", "_at").agg(F.max("_sent").alias("_sent")), ["domain", "_at"], "_range")
    line = running(dealt, ["domain"], ["_at"], {"_prev": ("max", F.col("_sent"))}, bucket=F.col("_range"), inclusive=False)
    line = line.select(F.col("domain").alias("_domain"), "_at", "_prev")
    found = sends.join(line, F.col("domain").eqNullSafe(F.col("_domain")) & F.col("sent_at").eqNullSafe(F.col("_at")))
    cutoff = F.col("sent_at") - F.make_dt_interval(F.lit(days))
    return found.select("message_id", "domain", "sent_at", F.coalesce(F.col("_prev") >= cutoff, F.lit(False)).alias("suppressed"))


SLOT_DAYS = 3  # days of sends that share a piece of a domain's state


def suppressed_sends_stream(planned: DataFrame, history: DataFrame, days: int = 30, watermark: str = WATERMARK,
                            slot_days: int = SLOT_DAYS) -> DataFrame:
    """Stream form: planned sends with an earlier send of the domain within the interval, each once.

    State is kept per (domain, slot of some days), so a busy domain lies over many state
    partitions. A planned send looks at the slots its interval touches; a message that finds sends in several of
    them comes out once. Both sides keep state only as long as the interval and the watermark need it.
    """
    day = lambda at: F.unix_date(F.to_date(at))
    slot = lambda number: F.floor(number / F.lit(slot_days)).cast("long")
    first, last = slot(day(F.col("sent_at") - F.make_dt_interval(F.lit(days)))), slot(day(F.col("sent_at")))
    p = planned.withWatermark("sent_at", watermark).withColumn("_slot", F.explode(F.sequence(first, last)))
    h = history.select(F.col("domain").alias("h_domain"), F.col("sent_at").alias("h_sent_at"),
                       slot(day(F.col("sent_at"))).alias("h_slot")).withWatermark("h_sent_at", watermark)
    on = ((F.col("domain") == F.col("h_domain")) & (F.col("_slot") == F.col("h_slot"))
          & (F.col("h_sent_at") < F.col("sent_at")) & (F.col("h_sent_at") >= F.col("sent_at") - F.expr(f"interval {days} days")))
    return p.join(h, on, "left_semi").drop("_slot").dropDuplicatesWithinWatermark(["message_id", "domain", "sent_at"])


def job_state_stream(events: DataFrame) -> DataFrame:
    """Stream form of the job fold (update mode): the changed jobs of each micro-batch.

    The fold is made of mergeable aggregates, so state stays in the JVM and late
    events count by their own time.
    """
    return job_state(events)


STALE_BUCKETS = 1 << 14  # jobs are watched by bucket of their id: a call of Python per job would cost more than its rows
STALE_STATE = "ids binary, started binary, timers binary, closed binary"
STALE_OUTPUT = "id long, started_at timestamp, stale_at timestamp"
NEVER = 2 ** 63 - 1


def stale_jobs_stream(events: DataFrame, hours: int = 24, watermark: str = WATERMARK, buckets: int = STALE_BUCKETS) -> DataFrame:
    """Jobs (id, ts, status) that are still running ``hours`` after their start, once the watermark says so.

    The state of a bucket holds, per job, its first start in microseconds, the time in milliseconds its limit is up at,
    and whether it has ended or was reported. A job without a limit to wait for has the time ``NEVER``.
    """
    limit_ms = hours * 3_600_000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kinds = (np.int64, np.int64, np.int64, np.bool_)
        ids, started, timers, closed = (np.frombuffer(v, kind).copy() for v, kind in zip(
            state.get if state.exists else [b""] * 4, kinds, strict=True))
        # what was due before this batch; a job that the batch names waits for a later one
        due = timers < now
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            new, at = np.unique(rows["id"].to_numpy(), return_inverse=True)
            kind, us = rows["kind"].to_numpy(), rows["us"].to_numpy()
            known = np.union1d(ids, new)
            here, there = np.searchsorted(known, ids), np.searchsorted(known, new)

            def wider(old: np.ndarray, blank: int) -> np.ndarray:
                out = np.full(len(known), blank, old.dtype)
                out[here] = old
                return out

            ids, started, timers, closed, due = known, wider(started, NEVER), wider(timers, NEVER), wider(closed, 0), wider(due, 0)
            np.minimum.at(started, there[at[kind == 1]], us[kind == 1])
            closed[there[at[kind == 2]]] = True
            due[there] = False
            open_ = (started[there] < NEVER) & ~closed[there]
            limits = np.maximum(started[there] // 1000 + limit_ms, now + 1, where=open_, out=np.full(len(there), NEVER))
            timers[there] = limits
        closed |= due
        timers[due] = NEVER
        state.update(tuple(v.tobytes() for v in (ids, started, timers, closed)))
        if len(timers) and timers.min() < NEVER:
            state.setTimeoutTimestamp(max(int(timers.min()), now + 1))
        if due.any():
            since = pd.Series(pd.to_datetime(started[due], unit="us", utc=True))
            named = pd.array(ids[due] if key[0] >= 0 else [None], dtype="Int64")
            yield pd.DataFrame({"id": named, "started_at": since, "stale_at": since + pd.Timedelta(hours=hours)})

    status = F.col("status")
    bucket = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets))).cast("int")
    rows = events.select("id", "ts", "status").withWatermark("ts", watermark).select(
        bucket.alias("bucket"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), "ts",
        F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("us"),
        F.coalesce(F.when(status == "running", 1).when(status.isin(TERMINAL), 2), F.lit(0)).cast("byte").alias("kind"))
    return rows.groupBy("bucket").applyInPandasWithState(
        watch, STALE_OUTPUT, STALE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append",
          each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run a stream over everything that has arrived, into Parquet or a batch function."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", sink)
    query = writer.start()
    query.awaitTermination()
    return query


def keep_changes(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for update mode: every change is appended with its batch number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id:010d}")
    return write


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last change per key that ``keep_changes`` wrote."""
    changes = spark.read.option("basePath", path).parquet(path)
    return upsert_latest(changes, None, keys, "batch_id").drop("batch_id")
