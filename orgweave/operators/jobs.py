"""Job state folded from job events, and the messages built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ["completed", "failed", "cancelled"]


def job_state(events: DataFrame) -> DataFrame:
    """State per job out of its events (id, ts, seq, status, progress).

    Events count in event-time order. A terminal status, once reached, is kept:
    the first terminal event fixes status and completion time. Progress is the
    last one given, 100 for a completed job.
    """
    status, when = F.col("status"), F.struct("ts", "seq")
    ended = status.isin(TERMINAL)
    # max_by / min_by skip rows whose ordering is null
    folded = events.groupBy("id").agg(
        F.min_by("status", F.when(ended, when)).alias("_end"), F.max_by("status", when).alias("_last"),
        F.max_by("progress", F.when(F.col("progress").isNotNull(), when)).alias("_progress"),
        F.min(F.when(status == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(ended, F.col("ts"))).alias("completed_at"), F.max("ts").alias("updated_at"))
    final = F.coalesce("_end", "_last")
    return folded.select("id", final.alias("status"), F.when(final == "completed", F.lit(100)).otherwise(
        F.coalesce("_progress", F.lit(0))).alias("progress"), "started_at", "completed_at", "updated_at")


def running_jobs(state: DataFrame) -> DataFrame:
    return state.where("status = 'running'")


def stale_jobs(state: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs running for more than ``hours``."""
    return state.where((F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(
        hours=F.lit(hours))))


def lifecycle_messages(changes: DataFrame) -> DataFrame:
    """job_started / job_progress / job_completed / job_failed messages.

    ``changes``: id, user_id, job_type, status, progress, result, error, ts.
    """
    status = F.col("status")
    event = (F.when(status == "completed", "job_completed").when(status == "failed", "job_failed")
             .when((status == "running") & (F.coalesce("progress", F.lit(0)) > 0), "job_progress")
             .when(status == "running", "job_started"))
    data = (F.when(event == "job_completed", F.to_json(F.struct(F.col("id").alias("job_id"), "job_type", "result")))
            .when(event == "job_failed", F.to_json(F.struct(F.col("id").alias("job_id"), "job_type", "error")))
            .when(event == "job_progress", F.to_json(F.struct(F.col("id").alias("job_id"), "progress")))
            .otherwise(F.to_json(F.struct(F.col("id").alias("job_id"), "job_type"))))
    return changes.withColumn("event", event).where(F.col("event").isNotNull()).select(
        "event", data.alias("data"), "user_id", F.col("ts").alias("timestamp"))
