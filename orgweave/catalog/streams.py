"""Event streams, in batch form and as streaming queries."""

import math

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.operators import jobs
from orgweave.session import tune, work_path
from orgweave.streaming import events as S

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def table_stream(spark, d, name, schema):
    """A table as a stream, be it one file or a folder of them (a stream takes a single file only by a pattern).

    It arrives as one micro-batch, so first rows and watermarks don't depend on how it lies in files.
    """
    return S.read_events(spark, f"{d}/{{{name}}}.parquet", schema, files_per_batch=None)


def event_stream(spark, d):
    tune(spark)
    raw = table_stream(spark, d, "events", EVENT_SCHEMA)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_changes(spark, stream, keys, name):
    """Drain an update-mode stream into the shared folder and read the last row per key."""
    path = work_path(spark, name)
    S.drain(stream, path, path + "-checkpoint", "update", S.keep_changes(path))
    return S.latest_rows(spark, path, keys)


def run_rows(spark, stream, name):
    path = work_path(spark, name)
    S.drain(stream, path, path + "-checkpoint")
    return spark.read.parquet(path)


MSG = """msg as (select event_id, event_type as event, case when event_type in ('click', 'view', 'purchase') then
  user_id::varchar end as user_id, case when event_type in ('view', 'signup') then 't' || json_extract_string(props, '$.k')
  end as team_id, ts from events)"""
ROUTED = f"""{MSG}, routed as (select event_id, event, unnest(list_filter([case when user_id is not null then 'events:user:'
  || user_id end, case when team_id is not null then 'events:team:' || team_id end, case when user_id is null and team_id is
  null then 'events:global' end], lambda c: c is not null)) as channel from msg)"""


def messages(ev):
    kind = F.col("event_type")
    return ev.select(
        "event_id", kind.alias("event"), F.when(kind.isin("click", "view", "purchase"), F.col("user_id").cast("string"))
        .alias("user_id"), F.when(kind.isin("view", "signup"), F.concat(F.lit("t"), F.get_json_object("props", "$.k")))
        .alias("team_id"), "ts")


def json_messages(ev):
    bad = F.col("event_type") == "error"
    return ev.select("event_id", F.when(bad, F.concat(F.lit("{"), "props")).otherwise(F.to_json(F.struct(
        F.col("event_type").alias("event"), F.col("props").alias("data"), F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("timestamp")))).alias("value"))


@query("s12_stream_event_source", """select event_type as event, user_id::varchar as user_id, props as data, count(*) as n
from events where event_type <> 'error' group by 1, 2, 3""")
def s12(spark, d):
    decoded = S.decode_messages(json_messages(event_stream(spark, d)))
    rows = run_rows(spark, decoded, "messages")
    return rows.groupBy("event", "user_id", "data").agg(F.count("*").alias("n"))


@query("t1_route_channels", f"with {ROUTED} select event_id, event, channel from routed")
def t1(spark, d):
    return S.route_channels(messages(table(spark, d, "events"))).select("event_id", "event", "channel")


@query("t1_route_channels_stream", f"with {ROUTED} select event_id, event, channel from routed")
def t1_stream(spark, d):
    routed = S.route_channels(messages(event_stream(spark, d))).select("event_id", "event", "channel")
    return run_rows(spark, routed, "routed")


@query("t2_channel_subscribe", f"""with {ROUTED} select event_id, channel from routed where channel in ('events:user:7',
  'events:team:t3', 'events:global')""")
def t2(spark, d):
    routed = S.route_channels(messages(event_stream(spark, d)))
    wanted = S.subscribe(routed, ["events:user:7", "events:team:t3", "events:global"]).select("event_id", "channel")
    return run_rows(spark, wanted, "subscribed")


JOB_EVENTS = """je as (select user_id * 1000 + json_extract(props, '$.k')::bigint // 10 as id, event_id as seq, ts, case event_type
  when 'signup' then 'queued' when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status,
  case when event_type = 'click' then least(floor(value), 99)::int end as progress from events),
js as (select id, coalesce(arg_min(status, seq) filter (where status in ('completed', 'failed')), arg_max(status, seq))
  as status, arg_max(progress, seq) filter (where progress is not null) as progress,
  min(ts) filter (where status = 'running') as started_at,
  min(ts) filter (where status in ('completed', 'failed')) as completed_at, max(ts) as updated_at from je group by id),
st as (select id, status, case when status = 'completed' then 100 else coalesce(progress, 0) end as progress, started_at,
  completed_at, updated_at from js)"""
STATE_SQL = f"""with {JOB_EVENTS} select id, status, progress, epoch_us(started_at) as started_us, epoch_us(completed_at) as
  completed_us, epoch_us(updated_at) as updated_us from st"""


def job_events(ev):
    kind = F.col("event_type")
    return ev.select(
        (F.col("user_id") * 1000 + F.floor(F.get_json_object("props", "$.k").cast("long") / 10)).alias("id"),
        F.col("event_id").alias("seq"), "ts",
        F.when(kind == "signup", "queued").when(kind == "purchase", "completed").when(kind == "error", "failed")
        .otherwise("running").alias("status"),
        F.when(kind == "click", F.least(F.floor("value"), F.lit(99)).cast("int")).alias("progress"))


def shown_state(state):
    return state.select("id", "status", "progress", F.unix_micros("started_at").alias("started_us"),
                        F.unix_micros("completed_at").alias("completed_us"), F.unix_micros("updated_at").alias("updated_us"))


@query("t3_job_state", STATE_SQL)
def t3(spark, d):
    return shown_state(jobs.job_state(job_events(table(spark, d, "events"))))


@query("t3_job_state_stream", STATE_SQL)
def t3_stream(spark, d):
    changes = S.job_state_stream(job_events(event_stream(spark, d)))
    return shown_state(run_changes(spark, changes, ["id"], "jobs"))


@query("t4_stale_jobs", f"""with {JOB_EVENTS} select id from st where status = 'running' and started_at <
  timestamp '2024-01-31 00:00:00' - interval 24 hour""")
def t4(spark, d):
    state = jobs.job_state(job_events(table(spark, d, "events")))
    return jobs.stale_jobs(state, F.lit(st.NOW).cast("timestamp")).select("id")


@query("t5_running_jobs", f"with {JOB_EVENTS} select id, progress from st where status = 'running'")
def t5(spark, d):
    return jobs.running_jobs(jobs.job_state(job_events(table(spark, d, "events")))).select("id", "progress")


PRESENCE = """select user_id, (count(*) filter (where event_type in ('view', 'signup')) - count(*) filter (where event_type in
  ('click', 'error')))::bigint as connections from events group by 1"""


def connections(ev):
    kind = F.col("event_type")
    return ev.select("user_id", F.when(kind.isin("view", "signup"), "connect").when(
        kind.isin("click", "error"), "disconnect").otherwise("ping").alias("action"))


@query("t6_presence", f"select * from ({PRESENCE}) where connections > 0")
def t6(spark, d):
    return S.active_users(S.presence(connections(table(spark, d, "events"))))


@query("t6_presence_stream", f"select * from ({PRESENCE}) where connections > 0")
def t6_stream(spark, d):
    counts = S.presence(connections(event_stream(spark, d)))
    return S.active_users(run_changes(spark, counts, ["user_id"], "presence"))


@query("t7_stream_page_dedup", "select distinct source as domain, sha256(text) as content_hash from documents")
def t7(spark, d):
    tune(spark)
    docs = table_stream(spark, d, "documents", DOCUMENTS)
    pages = docs.select("doc_id", F.col("source").alias("domain"), F.col("text").alias("content"))
    unique = S.dedup_pages_stream(pages).select("domain", "content_hash")
    return run_rows(spark, unique, "unique")


def twice(spark, d, run):
    """``run`` a stream of the first half of the documents, then once more with the rest landed, each in two micro-batches."""
    folder, before = work_path(spark, "halves"), 0
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    for half in (0, 1):
        rows = docs.where(F.pmod("doc_id", F.lit(2)) == half)
        # a large table lands as it lies, in a file per task
        rows = rows if rows.rdd.getNumPartitions() > 1 else rows.repartition(2)
        rows.write.mode("append").parquet(folder)
        files = len(spark.read.schema(DOCUMENTS).parquet(folder).inputFiles())
        run(S.read_events(spark, folder, DOCUMENTS, files_per_batch=max(1, math.ceil((files - before) / 2))))
        before = files


@query("t7_stream_page_dedup_restart", "select distinct source as domain, sha256(text) as content_hash from documents")
def t7_restart(spark, d):
    path = work_path(spark, "unique")
    twice(spark, d, lambda docs: S.drain(S.dedup_pages_stream(docs.select(
        F.col("source").alias("domain"), F.col("text").alias("content"))).select("domain", "content_hash"), path,
        path + "-checkpoint"))
    return spark.read.parquet(path)


@query("t7_stream_page_dedup_recent", "select distinct user_id as domain, sha256(props) as content_hash from events")
def t7_recent(spark, d):
    pages = event_stream(spark, d).select(F.col("user_id").alias("domain"), F.col("props").alias("content"), "ts")
    return run_rows(spark, S.dedup_pages_recent(pages).select("domain", "content_hash"), "recent")


@query("t4_stale_jobs_stream", f"""with {JOB_EVENTS}, ends as (select max(ts) - interval 10 minute as mark from events),
j as (select id, min(ts) filter (where status = 'running') as started, bool_or(status in ('completed', 'failed')) as ended
  from je group by id)
select id, epoch_us(started) as started_us from j, ends where not ended and started + interval 24 hour <= mark""")
def t4_stream(spark, d):
    stale = run_rows(spark, S.stale_jobs_stream(job_events(event_stream(spark, d))), "stale")
    return stale.select("id", F.unix_micros("started_at").alias("started_us"))


@query("t8_incremental_embed_restart", """select source as domain, sha256(text) as content_hash, count(*) as n from (
  select distinct source, text from documents) group by 1, 2""")
def t8_restart(spark, d):
    from orgweave.plans.incremental import embed_stream, read_stored
    path = work_path(spark, "embeddings")
    twice(spark, d, lambda docs: embed_stream(docs.select(
        F.concat_ws("-", "source", "doc_id").alias("chunk_id"), F.col("source").alias("domain"),
        F.col("text").alias("content"), F.col("doc_id").alias("seq")), path, path + "-checkpoint"))
    return read_stored(spark, path).groupBy("domain", "content_hash").agg(F.count("*").alias("n"))


@query("t8_incremental_embed", """select chunk_id, sha256(text) as content_hash, 64 as dim from (select source || '-' || doc_id
  as chunk_id, text, source, row_number() over (partition by source, sha256(text) order by doc_id) as rn from documents)
where rn = 1""")
def t8(spark, d):
    from orgweave.plans.incremental import embed_stream, read_stored
    tune(spark)
    docs = table_stream(spark, d, "documents", DOCUMENTS)
    chunks = docs.select(F.concat_ws("-", "source", "doc_id").alias("chunk_id"), F.col("source").alias("domain"),
                         F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    path = work_path(spark, "embeddings")
    embed_stream(chunks, path, path + "-checkpoint")
    return read_stored(spark, path).select("chunk_id", "content_hash", F.size("embedding").alias("dim"))


@query("t9_recent_contact_guard", f"""with {st.SENDS}, p as (select message_id, domain, sent_at from sends where status =
  'queued'), h as (select domain, sent_at from sends where status = 'sent')
select message_id, domain, exists (select 1 from h where h.domain = p.domain and h.sent_at < p.sent_at
  and h.sent_at >= p.sent_at - interval 30 day) as suppressed from p""")
def t9(spark, d):
    sends = st.sends(spark, d)
    return S.recent_contact_guard(sends.where("status = 'queued'"), sends.where("status = 'sent'")).select(
        "message_id", "domain", "suppressed")


@query("t9_recent_contact_guard_stream", f"""with {st.SENDS}, p as (select message_id, domain, sent_at from sends where
  status = 'queued'), h as (select domain, sent_at from sends where status = 'sent')
select distinct message_id, domain from p where exists (select 1 from h where h.domain = p.domain and h.sent_at < p.sent_at
  and h.sent_at >= p.sent_at - interval 30 day)""")
def t9_stream(spark, d):
    def sends(ev):
        kind = F.col("event_type")
        return ev.select(F.col("event_id").alias("message_id"), F.concat(F.lit("d"), "user_id", F.lit(".com")).alias("domain"),
                         F.when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("sent").alias("status"),
                         F.col("ts").alias("sent_at"))
    planned = sends(event_stream(spark, d)).where("status = 'queued'").drop("status")
    history = sends(event_stream(spark, d)).where("status = 'sent'").select("domain", "sent_at")
    hits = run_rows(spark, S.suppressed_sends_stream(planned, history), "guard")
    return hits.select("message_id", "domain")


RATES = """select epoch_us(date_trunc('hour', ts)) as hour_us, event_type, count(*) as n, count(*) > 3 as over_limit from events
  group by 1, 2"""


@query("t10_rate_window", "select epoch_us(date_trunc('minute', ts)) as minute_us, user_id, count(*) as n, count(*) > 60 as "
                          "over_limit from events group by 1, 2")
def t10(spark, d):
    rates = S.rate_windows(table(spark, d, "events"))
    return rates.select(F.unix_micros("minute").alias("minute_us"), "user_id", "n", "over_limit")


@query("t10_rate_window_stream", "select epoch_us(date_trunc('minute', ts)) as minute_us, user_id, count(*) as n, count(*) > "
                                 "60 as over_limit from events group by 1, 2")
def t10_stream(spark, d):
    rates = run_changes(spark, S.rate_windows(event_stream(spark, d)), ["minute", "user_id"], "rates")
    return rates.select(F.unix_micros("minute").alias("minute_us"), "user_id", "n", "over_limit")


@query("t11_job_lifecycle_events", f"""with {JOB_EVENTS} select case status when 'completed' then 'job_completed' when 'failed'
  then 'job_failed' else case when coalesce(progress, 0) > 0 then 'job_progress' else 'job_started' end end as event,
  case status when 'completed' then '{{"job_id":' || id || ',"job_type":"crawl","result":"ok"}}' when 'failed' then
    '{{"job_id":' || id || ',"job_type":"crawl","error":"boom"}}' else case when coalesce(progress, 0) > 0 then
    '{{"job_id":' || id || ',"progress":' || progress || '}}' else '{{"job_id":' || id || ',"job_type":"crawl"}}' end end as data,
  (id // 1000)::varchar as user_id from je where status <> 'queued'""")
def t11(spark, d):
    ev = job_events(table(spark, d, "events")).select(
        "*", F.floor(F.col("id") / 1000).cast("string").alias("user_id"), F.lit("crawl").alias("job_type"),
        F.lit("ok").alias("result"), F.lit("boom").alias("error"))
    return jobs.lifecycle_messages(ev).select("event", "data", "user_id")
