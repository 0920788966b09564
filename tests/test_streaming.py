import datetime as dt

from pyspark.sql import functions as F

from orgweave.operators import jobs
from orgweave.streaming import events as S

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def land(spark, folder, rows, schema, n):
    """Rows as one more file of a landing folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


JOB = "id long, ts timestamp, seq long, status string, progress int"


def test_job_state_example(spark):
    df = spark.createDataFrame([(1, at(0), 1, "queued", None), (1, at(1), 2, "running", 5), (1, at(2), 3, "running", 40),
                                (1, at(3), 4, "completed", None), (2, at(0), 5, "running", None), (3, at(4), 6, "running", 9),
                                (3, at(2), 7, "failed", None)], JOB)
    got = {r["id"]: r for r in jobs.job_state(df).collect()}
    assert (got[1]["status"], got[1]["progress"], got[1]["started_at"], got[1]["completed_at"]) == ("completed", 100, at(1), at(3))
    assert got[2]["status"] == "running" and got[2]["completed_at"] is None and got[2]["progress"] == 0
    assert got[3]["status"] == "failed" and got[3]["progress"] == 9
    assert [r["id"] for r in jobs.stale_jobs(jobs.job_state(df), F.lit(at(1441)).cast("timestamp")).collect()] == [2]


def test_job_state_stream_equals_batch_across_restarts(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    waves = [[(1, at(0), 1, "running", 5), (2, at(0), 2, "queued", None)], [(1, at(9), 3, "completed", None), (2, at(3), 4, "running", 1)],
             [(1, at(5), 5, "running", 50), (2, at(1), 6, "running", 7), (3, at(50), 7, "failed", None)]]
    for n, wave in enumerate(waves):
        land(spark, src, wave, JOB, n)
        stream = S.job_state_stream(S.read_events(spark, src, JOB))
        S.drain(stream, sink, cp, "update", S.keep_changes(sink))  # a new query each time: state comes from the checkpoint
    got = rows_of(S.latest_rows(spark, sink, ["id"]))
    assert got == rows_of(jobs.job_state(spark.read.schema(JOB).parquet(src)))


def test_stale_jobs_stream(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id long, ts timestamp, status string"
    waves = [[(1, at(0), "running"), (2, at(0), "running")], [(2, at(60), "completed"), (3, at(1500), "running")],
             [(4, at(3100), "running")], [(5, at(3200), "queued")]]
    for n, wave in enumerate(waves):
        land(spark, src, wave, schema, n)
        S.drain(S.stale_jobs_stream(S.read_events(spark, src, schema)), sink, cp)
    got = {r["id"]: r["stale_at"] for r in spark.read.parquet(sink).collect()}
    assert got == {1: at(1440), 3: at(2940)}


def test_page_dedup_survives_restart(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "domain string, content string"
    for n, wave in enumerate([[("a", "x"), ("a", "x"), ("b", "x")], [("a", "x"), ("a", "y")], [("b", "x"), ("b", "y")]]):
        land(spark, src, wave, schema, n)
        S.drain(S.dedup_pages_stream(S.read_events(spark, src, schema)), sink, cp)
    assert rows_of(spark.read.parquet(sink).select("domain", "content")) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_bounded_page_dedup(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "domain string, content string, ts timestamp"
    for n, wave in enumerate([[("a", "x", at(0))], [("a", "x", at(30)), ("a", "y", at(30))]]):
        land(spark, src, wave, schema, n)
        S.drain(S.dedup_pages_recent(S.read_events(spark, src, schema)), sink, cp)
    assert spark.read.parquet(sink).count() == 2


def test_rate_windows_flag(spark):
    df = spark.createDataFrame([(1, at(0) + dt.timedelta(seconds=i % 60)) for i in range(61)] + [(2, at(0))], "user_id long, ts timestamp")
    assert {(r["user_id"], r["n"], r["over_limit"]) for r in S.rate_windows(df).collect()} == {(1, 61, True), (2, 1, False)}


def test_rate_windows_drop_late_rows(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "user_id long, ts timestamp"
    for n, wave in enumerate([[(1, at(0)), (1, at(60))], [(1, at(0)), (1, at(59))], [(1, at(200))]]):
        land(spark, src, wave, schema, n)
        S.drain(S.rate_windows(S.read_events(spark, src, schema)), sink, cp, "append")
    got = {r["minute"]: r["n"] for r in spark.read.parquet(sink).collect()}
    assert got == {at(0): 1, at(59): 1, at(60): 1}


def test_routing(spark):
    df = spark.createDataFrame([("u", None), ("u", "t"), (None, None), ("", "")], "user_id string, team_id string")
    got = [r["channel"] for r in S.route_channels(df).collect()]
    assert got == ["events:user:u", "events:user:u", "events:team:t", "events:global", "events:global"]


def test_decode_drops_bad_messages(spark):
    df = spark.createDataFrame([('{"event":"job_started","data":"{}","user_id":"1","timestamp":"2024-01-01T00:00:00Z"}',), ("{oops",),
                                ("[]",), (None,)], "value string")
    assert [r["event"] for r in S.decode_messages(df).collect()] == ["job_started"]


def test_presence_stream(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "user_id string, connection_id string, action string"
    for n, wave in enumerate([[("a", "1", "connect"), ("a", "2", "connect"), ("b", "3", "connect")],
                              [("b", "3", "disconnect"), ("a", "1", "disconnect")]]):
        land(spark, src, wave, schema, n)
        S.drain(S.presence(S.read_events(spark, src, schema)), sink, cp, "update", S.keep_changes(sink))
    assert rows_of(S.active_users(S.latest_rows(spark, sink, ["user_id"]))) == [("a", 1)]


def test_contact_guard(spark):
    days = lambda n: T0 + dt.timedelta(days=n)
    past = spark.createDataFrame([("a", days(0)), ("a", days(5)), ("b", days(0))], "domain string, sent_at timestamp")
    plan = spark.createDataFrame([(1, "a", days(35)), (2, "a", days(36)), (3, "b", days(0)), (4, "c", days(1))],
                                 "message_id int, domain string, sent_at timestamp")
    got = {r["message_id"]: r["suppressed"] for r in S.recent_contact_guard(plan, past).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_incremental_embedding_replays_safely(spark, tmp_path):
    from orgweave.plans.incremental import embed_stream, read_stored
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "chunk_id string, domain string, content string, seq long"
    for n, wave in enumerate([[("1", "d", "a", 1), ("2", "d", "a", 2)], [("3", "d", "a", 3), ("4", "d", "b", 4), ("5", "e", "a", 5)]]):
        land(spark, src, wave, schema, n)
        embed_stream(S.read_events(spark, src, schema), sink, cp)
    assert rows_of(read_stored(spark, sink).select("chunk_id", "batch_id")) == [("1", 0), ("4", 1), ("5", 1)]


def test_lifecycle_messages(spark):
    df = spark.createDataFrame([(1, "u", "crawl", s, p, "r", "e", at(0)) for s, p in (("queued", 0), ("running", 0), ("running", 5),
                                                                                      ("completed", 100), ("failed", 3))],
                               "id long, user_id string, job_type string, status string, progress int, result string, error string, "
                               "ts timestamp")
    assert [r["event"] for r in jobs.lifecycle_messages(df).collect()] == ["job_started", "job_progress", "job_completed", "job_failed"]


def test_stale_jobs_are_watched_by_bucket(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id long, ts timestamp, status string"
    jobs_of = lambda n: None if n == 0 else n
    first = [(jobs_of(n), at(n), "running") for n in range(200)] + [(jobs_of(n), at(n + 5), "running") for n in range(0, 200, 2)]
    second = [(n, at(300), "failed") for n in range(3, 200, 3)] + [(500, at(1600), "queued"), (501, None, "running"), (502, at(1600), None)]
    # job 1 has a row in the wave that makes it due, and is reported all the same
    third = [(1, at(3300), "running"), (600, at(3300), "running"), (4, at(3300), "completed")]
    for n, wave in enumerate([first, second, third, [(601, at(9000), "queued")]]):
        land(spark, src, wave, schema, n)
        query = S.drain(S.stale_jobs_stream(S.read_events(spark, src, schema), buckets=4), sink, cp)
        assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    got = rows_of(spark.read.parquet(sink))
    kept = [n for n in range(200) if n % 3 or n == 0]
    assert got == sorted([(jobs_of(n), at(n), at(n + 1440)) for n in kept] + [(600, at(3300), at(4740))], key=repr)
