"""Streaming queries over tables that are folders of files."""

from hashlib import sha256

import pytest

from orgweave.catalog import load, streams
from orgweave.catalog.base import QUERIES

load()
FILES = [[(7, "x", "a"), (8, "y", "a")], [(1, "x", "a"), (2, "x", "b")], [(5, "y", "a"), (6, None, "b")], [(3, "z", "c"), (4, "z", "c")]]


def digest(text):
    return None if text is None else sha256(text.encode()).hexdigest()


@pytest.fixture
def tables(spark, tmp_path):
    for part in FILES:
        rows = [(n, text, "en", source, len(text or "")) for n, text, source in part]
        spark.createDataFrame(rows, streams.DOCUMENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def distinct_texts():
    return {(source, digest(text)) for part in FILES for _, text, source in part}


@pytest.mark.parametrize("name", ["t7_stream_page_dedup", "t7_stream_page_dedup_restart"])
def test_page_dedup_of_a_folder(spark, tables, name):
    got = [tuple(r) for r in QUERIES[name](spark, tables).select("domain", "content_hash").collect()]
    assert len(got) == len(set(got)) and set(got) == distinct_texts()


def test_embedding_of_a_folder_takes_the_first_by_id(spark, tables):
    got = {tuple(r) for r in QUERIES["t8_incremental_embed"](spark, tables).collect()}
    firsts = {}
    for n, text, source in sorted((row for part in FILES for row in part), key=lambda r: r[0]):
        firsts.setdefault((source, digest(text)), n)
    assert got == {(f"{source}-{n}", h, 64) for (source, h), n in firsts.items()}


def test_embedding_restarts_on_a_folder(spark, tables):
    got = {(r["domain"], r["content_hash"]): r["n"] for r in QUERIES["t8_incremental_embed_restart"](spark, tables).collect()}
    assert got == {key: 1 for key in distinct_texts()}


def test_halves_land_in_the_files_of_their_tasks(spark, tables, tmp_path):
    wide = str(tmp_path / "wide")
    spark.range(4000).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'s' as source", "1L as n_chars").write.parquet(
        f"{wide}/documents.parquet")
    batches = []

    def run(docs):
        path = str(tmp_path / f"out{len(batches)}")
        query = streams.S.drain(docs, path, path + "-checkpoint")
        filled = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        out = spark.read.parquet(path)
        batches.append((len(out.inputFiles()), filled, out.count()))

    streams.twice(spark, wide, run)
    assert [n for _, _, n in batches] == [2000, 4000]
    # before, two tasks wrote a half whatever its size
    assert batches[0][0] > 2 and len(batches[0][1]) == 2


def test_events_of_a_folder(spark, tmp_path):
    spark.range(40).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id % 3 as user_id", "'view' as event_type", "1.0D as value",
        """'{"k": 1}' as props""").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["t1_route_channels_stream"](spark, str(tmp_path)).count() == 80
