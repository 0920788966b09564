import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.operators import folds
from orgweave.partitioning import first_n_per_key, nest_pages, position, running, since_last


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; ids have gaps."""
    rng = random.Random(1)
    ids = rng.sample(range(2000), 600)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(0, 50)) for i in ids]
    return data, spark.createDataFrame(data, "k string, id long, v long").repartition(5).cache()


@pytest.mark.parametrize("width", [7, 64, 100_000])
def test_running_equals_plain_loop(skewed, width):
    data, df = skewed
    want = []
    for key, group in itertools.groupby(sorted(data), key=lambda r: r[0]):
        total, top = 0, None
        for k, i, v in group:
            total, top = total + v, v if top is None else max(top, v)
            want.append((k, i, v, total, top))
    got = running(df, ["k"], "id", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, width)
    assert rows_of(got) == sorted(want)


def test_position_without_keys(skewed):
    data, df = skewed
    got = {r["id"]: r["position"] for r in position(df, [], "id", width=50).collect()}
    assert got == {i: n for n, i in enumerate(sorted(d[1] for d in data), 1)}


def test_first_n_is_cut_before_the_exchange(skewed):
    data, df = skewed
    top = first_n_per_key(df, ["k"], [F.col("v").desc(), "id"], 3)
    want = []
    for _, group in itertools.groupby(sorted(data), key=lambda r: r[0]):
        want += sorted(group, key=lambda r: (-r[2], r[1]))[:3]
    assert rows_of(top) == sorted(want)
    assert top._jdf.queryExecution().executedPlan().toString().count("Partial") >= 1


def test_nest_pages_keeps_every_row_in_order(skewed):
    data, df = skewed
    pages = nest_pages(df, ["k"], "id", ["id"], page_size=40).collect()
    assert max(len(p["items"]) for p in pages) == 40
    for key in {d[0] for d in data}:
        mine = sorted((p for p in pages if p["k"] == key), key=lambda p: p["page"])
        assert [i["id"] for p in mine for i in p["items"]] == sorted(d[1] for d in data if d[0] == key)


def test_char_budget_is_a_prefix(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([300, 150, 100, 10])], "domain string, seq long, n long")
    assert [r["seq"] for r in folds.char_budget_prefix(df, F.col("n"), "seq", 500).orderBy("seq").collect()] == [0, 1]


def naive_pack(lengths, limit):
    out, chunk, acc, any_ = [], 1, 0, False
    for n in lengths:
        if any_ and acc + n > limit:
            chunk, acc = chunk + 1, 0
        out.append(chunk)
        acc, any_ = acc + n, True
    return out


def test_greedy_pack_example(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([10, 10, 10, 40])], "domain string, seq long, n long")
    got = [r["chunk_no"] for r in folds.greedy_pack(df, F.col("n"), "seq", 25).orderBy("seq").collect()]
    assert got == [1, 1, 2, 3]


@pytest.mark.parametrize("width", [1, 3, 16, 10_000])
def test_greedy_pack_equals_loop_for_any_bucket_width(spark, width):
    rng = random.Random(width)
    data = {"hot": [rng.choice([0, 1, 5, 9, 30, 60]) for _ in range(400)], "one": [70], "zero": [0, 0, 0],
            "big": [60, 0, 60, 1, 0, 60]}
    rows = [(d, 3 * i + 1, n) for d, ns in data.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "domain string, seq long, n long").repartition(4)
    got = folds.greedy_pack(df, F.col("n"), "seq", 50, width=width).orderBy("seq").collect()
    for domain, lengths in data.items():
        assert [r["chunk_no"] for r in got if r["domain"] == domain] == naive_pack(lengths, 50), domain


def test_a_bucket_as_a_function_equals_walking_its_pages():
    rng = random.Random(12)
    for _ in range(400):
        limit = rng.choice([1, 5, 40])
        lengths = np.array([rng.choice([0, 0, 1, 2, 7, limit, limit + 3]) for _ in range(rng.randrange(1, 60))])
        end, count, fill = folds._bucket_function(lengths, limit)
        assert len(end) <= limit + 2 and (np.diff(end) > 0).all()
        for carried in [*range(limit + 1), limit + 9]:
            chunks, full = 0, carried
            for n in lengths:
                if full + n > limit:
                    chunks, full = chunks + 1, n
                else:
                    full += n
            at = np.searchsorted(end, limit - carried, side="right")
            got = (count[at], fill[at]) if at < len(end) else (0, carried + lengths.sum())
            assert got == (chunks, full), (lengths, limit, carried)


def test_greedy_pack_of_a_domain_of_empty_pages(spark):
    # a row per bucket, however many empty pages it holds: ten million of them need no more
    end, _, _ = folds._bucket_function(np.zeros(262_144, dtype="int64"), 25_000)
    assert len(end) == 1
    df = spark.range(30_000).select(F.lit("d").alias("domain"), F.col("id").alias("seq"),
                                    F.when(F.col("id") % 10_000 == 9_999, "xxxx").otherwise("").alias("content"))
    got = folds.greedy_pack(df, F.length("content"), "seq", 6, width=1000)
    chunks = {r["chunk_no"]: r["n"] for r in got.groupBy("chunk_no").agg(F.count("*").alias("n")).collect()}
    assert chunks == {1: 19_999, 2: 10_000, 3: 1}


def test_greedy_pack_with_priority_pages_first(spark):
    from orgweave.operators.filters import priority_rank
    rows = [("d", 1, 20, False), ("d", 2, 20, True), ("d", 3, 20, False), ("d", 4, 20, True)]
    df = spark.createDataFrame(rows, "domain string, seq long, n long, first boolean")
    got = folds.greedy_pack(df, F.col("n"), "seq", 45, rank=priority_rank(F.col("first"), "seq")).orderBy("page_no").collect()
    assert [(r["seq"], r["chunk_no"]) for r in got] == [(2, 1), (4, 1), (1, 2), (3, 2)]


def test_merge_products(spark):
    rows = [("d", 1, "A", "$1", None), ("d", 2, "a ", "$1", None), ("d", 3, "A", None, "u"), ("d", 4, None, "$1", None)]
    df = spark.createDataFrame(rows, "domain string, seq long, name string, price string, url string")
    got = folds.merge_products(df).orderBy("seq").collect()
    assert [(r["seq"], r["product_id"]) for r in got] == [(1, "d_product_1"), (3, "d_product_2")]


def test_chat_window(spark):
    df = spark.createDataFrame([(1, t) for t in range(9)], "conv_id long, turn long")
    parts = {r["turn"]: r["part"] for r in folds.chat_window(df).collect()}
    assert sorted(t for t, p in parts.items() if p == "to_summarise") == [0, 1, 2]
    assert sorted(t for t, p in parts.items() if p == "active") == [3, 4, 5, 6, 7, 8]


def test_consecutive_failures(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate("SFFFSF")], "src string, seq long, r string")
    got = folds.consecutive_failures(df, "src", F.col("r") == "S", "seq").orderBy("seq").collect()
    assert [r["healthy"] for r in got] == [True, True, True, False, True, True]


@pytest.mark.parametrize("width", [5, 64, 100_000])
def test_since_last_equals_plain_loop_for_a_hot_key(spark, width):
    rng = random.Random(width)
    ids = rng.sample(range(-2 ** 61, 2 ** 61), 900) + rng.sample(range(3000), 900)
    rows = [(i, [None, "hot", "hot", f"d{k % 40}"][k % 4], rng.choice([True, False, False, False, None]), f"w{k}")
            for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "seq long, domain string, ok boolean, extra string").repartition(5)
    got = since_last(df, ["domain"], "seq", F.col("ok"), "since", width)
    assert got.columns == [*df.columns, "since"]
    found, since = {r.seq: r.since for r in got.collect()}, {}
    for i, d, ok, _ in sorted(rows):
        since[d] = 0 if ok else since.get(d, 0) + 1
        assert found[i] == since[d], (i, d)


def test_since_last_moves_the_rows_once(spark):
    df = spark.range(1000).select(F.lit("a").alias("k"), "id", F.lit("wide").alias("wide"))
    plan = since_last(df, ["k"], "id", F.col("id") % 7 == 0, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 1 and plan.count("wide AS wide") == 1


def test_family_cap_is_seeded(spark):
    df = spark.createDataFrame([(f, f"q{i}") for f in "ab" for i in range(30)], "family string, query string")
    a, b = rows_of(folds.family_cap(df, 5)), rows_of(folds.family_cap(df.repartition(7), 5))
    assert a == b and len(a) == 10 and rows_of(folds.family_cap(df, 5, seed=7)) != a


def test_merge_profiles(spark):
    from orgweave.operators.profiles import merge_profiles
    rows = [("d", 1, "Acme", "short", ["n1", "n2", ""], (["a@x"], [], [], ""), {"twitter": ""}),
            ("d", 2, "Acme Ltd", "longer text", ["n2", "n3"], (["b@x", "a@x"], ["1"], [], "/c"), {"twitter": "t2", "zz": "q"}),
            ("d", 3, "Acme Inc", "x", None, None, {"twitter": "t3"})]
    df = spark.createDataFrame(rows, "domain string, seq int, company string, description string, notes array<string>, "
                                     "main_contacts struct<email:array<string>,phone:array<string>,address:array<string>,"
                                     "contact_page:string>, social_media map<string,string>")
    out = merge_profiles(df)
    p = out["profile"].head()
    assert (p["company"], p["description"], p["contact_page"]) == ("Acme Ltd", "longer text", "/c")
    lists = {f: [r["value"] for r in out["values"].where(F.col("field") == f).orderBy("first_at").collect()]
             for f in ("notes", "email", "phone")}
    assert lists == {"notes": ["n1", "n2", "n3"], "email": ["a@x", "b@x"], "phone": ["1"]}
    assert rows_of(out["socials"]) == [("d", "twitter", "t2")]


def test_running_over_sparse_ids_and_a_hot_key(spark):
    rng = random.Random(31)
    ids = rng.sample(range(-2 ** 61, 2 ** 61), 3000)
    rows = [(i, "hot" if k % 3 == 0 else f"d{k % 50}", k % 7) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "seq long, domain string, n int")
    got = {r["seq"]: (r["total"], r["pos"]) for r in running(df, ["domain"], "seq", {
        "total": ("sum", F.col("n")), "pos": ("sum", F.lit(1))}).collect()}
    seen = {}
    for i, d, n in sorted(rows):
        total, pos = seen.get(d, (0, 0))
        seen[d] = (total + n, pos + 1)
        assert got[i] == seen[d]
