import random
import zlib
from collections import Counter, defaultdict

from orgweave.llm import sharding as S
from tests.llm.conftest import DOCS, words


def check(rows, texts, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
    assert len(rows) == texts and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(0 <= s < n for s in by)
    return by


def test_sizes_are_near_equal_and_groups_stay(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", "s", 1) for i in range(3000)]
    copy = words(rng, 30)
    rows += [(5000 + i, copy, "en", "s", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    got = S.shard_by_bytes(docs, 24).collect()
    check(got, len(rows), 24)
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    assert len({r.shard for r in got if r.text == copy}) == 1


def test_a_text_with_a_third_of_all_rows_is_split(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 20), "en", "s", 1) for i in range(2000)] + [(9000 + i, "same " * 20, "en", "s", 1) for i in range(1000)]
    got = S.shard_by_bytes(spark.createDataFrame(rows, DOCS), 24).collect()
    check(got, len(rows), 24)
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert max(size.values()) < 1.15 * sum(size.values()) / 24
    # contiguous: copies fill shards next to each other
    held = sorted({r.shard for r in got if r.doc_id >= 9000})
    assert held == list(range(held[0], held[-1] + 1))


def test_odd_input(odd, empty, crowded, tmp_path, spark):
    check(S.shard_by_bytes(odd, 24).collect(), odd.count(), 24)
    crowd = S.shard_by_bytes(crowded, 3)
    assert crowd.count() == odd.count() and dict(crowd.dtypes)["shard"] == "int" and "x" in crowd.columns
    assert S.shard_by_bytes(empty).count() == 0
    S.write_shards(odd, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


def test_no_python_in_the_plan(odd):
    plan = S.shard_by_bytes(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
