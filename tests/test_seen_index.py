"""The index of stored contents: filters, levels, bytes read per batch, restarts."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from orgweave.plans import seen as S
from orgweave.plans.incremental import embed_stream, read_stored, seen_index
from orgweave.session import delete_path
from orgweave.streaming import events as E
from tests.test_streaming import land

SCHEMA = "chunk_id string, domain string, content string, seq long"


def test_filters_hold_their_keys_and_little_else():
    rng = random.Random(1)
    keys, others = ([rng.randbytes(16) for _ in range(5000)] for _ in range(2))
    bits = S.bloom(keys)
    assert S.may_hold(bits, keys).all() and S.may_hold(bits, others).mean() < 0.03
    assert len(bits) * 8 <= 5000 * S.BITS_PER_KEY + 64
    assert not S.may_hold(S.bloom([]), others).any() and S.may_hold(bits, []).tolist() == []


def test_live_runs_cover_all_batches_and_stay_few():
    for n in range(300):
        runs = S.live_runs(n, 4)
        assert [b for _, a, e in runs for b in range(a, e)] == list(range(n))
        assert len(runs) <= 3 * 5 and all(e - a == 4 ** k for k, a, e in runs)


def size_of(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_what_a_batch_reads_grows_with_the_batch_not_with_the_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    make = lambda n: [rng.bytes(16) for _ in range(n)]
    frame = lambda keys: spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    index = S.SeenIndex(spark, str(tmp_path / "seen"), None, fan=4, part_keys=64)
    held, read = [], []
    for batch in range(20):
        keys = make(200)
        repeats = [held[i] for i in rng.choice(len(held), min(3, len(held)), replace=False)]
        asked = keys[:17] + repeats
        if batch:
            index.clean(batch)
            got, parts = index.seen(frame(asked), batch)
            assert {bytes(r.key) for r in got.collect()} == set(repeats)
            read.append(sum(size_of(f"{index._path('keys')}/run={run}/part={p}") for run, ps in parts.items() for p in ps))
        index.add(batch, frame(keys))
        held += keys
    # 4,000 keys lie in runs of 64 keys a part; 20 keys a batch, 3 of them repeats, read a few parts each time
    assert max(read[-6:]) <= 2 * max(read[3:9]) and max(read) < size_of(index._path("keys")) / 4
    live = {S.run_name(r) for r in S.live_runs(20, 4)}
    index.clean(20)
    assert {n.removeprefix("run=") for n in os.listdir(index._path("keys")) if n.startswith("run=")} >= live
    assert sum(n for n, _ in index._sizes().values()) == 4000


def test_a_batch_run_again_and_a_store_without_an_index(spark, tmp_path):
    keys = [bytes([i]) * 16 for i in range(60)]
    frame = lambda some: spark.createDataFrame([(bytearray(k),) for k in some], "key binary")
    stored = lambda a, e: frame(keys[10 * a:10 * e])
    index = S.SeenIndex(spark, str(tmp_path / "seen"), stored, fan=2, part_keys=4)
    for batch in (0, 1, 1, 2, 3, 3):  # batches 1 and 3 merge, and are run again
        index.clean(batch)
        index.add(batch, stored(batch, batch + 1))
    got, _ = index.seen(frame(keys), 4)
    assert {bytes(r.key) for r in got.collect()} == set(keys[:40])
    other = S.SeenIndex(spark, str(tmp_path / "other"), stored, fan=2, part_keys=4)
    assert other.seen(frame(keys[15:45]), 3)[0].count() == 15
    other.add(3, frame([]))
    assert other.seen(frame(keys[15:45]), 4)[0].count() == 15


def test_embedding_over_many_batches_and_without_its_index(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    waves = [[(f"{n}-{i}", "d" if i % 3 else None, f"text {n * 3 + i}", n * 10 + i) for i in range(8)]
             for n in range(6)]
    for n, wave in enumerate(waves):
        land(spark, src, wave, SCHEMA, n)
        embed_stream(E.read_events(spark, src, SCHEMA), sink, cp, fan=2, part_keys=4)
        if n == 3:  # the index is lost: the next batch makes it anew
            delete_path(spark, seen_index(spark, sink).root)
    want = {(d, c) for wave in waves for _, d, c, _ in wave}
    got = [(r.domain, r.content) for r in read_stored(spark, sink).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert read_stored(spark, sink).agg(F.max("batch_id")).scalar is not None
