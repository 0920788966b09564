import datetime as dt

from pyspark.sql import functions as F

from orgweave.operators import filters, joins, ordering, reports, writes


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_latest_changes_win_ties(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, "new")], "k string, at int, v string")
    assert rows_of(writes.upsert_latest(base, new, ["k"], "at")) == [("a", 1, "new"), ("b", 5, "old"), ("c", 1, "new")]


def test_upsert_moves_only_changed_rows_of_the_base(spark, tmp_path):
    spark.range(200_000).selectExpr("cast(id as string) k", "id at", "'old' v").write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    new = spark.createDataFrame([("5", 9, "new"), ("7", 1, "late"), ("x", 1, "new"), (None, 1, "new")], "k string, at long, v string")
    out = writes.upsert_latest(base, new, ["k"], "at")
    kept = {r.k: r.v for r in out.where("k in ('5', '7', 'x') or k is null").collect()}
    assert kept == {"5": "new", "7": "old", "x": "new", None: "new"} and out.count() == 200_002
    out.collect()
    # no exchange stands right over the base's scan
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [i for i, line in enumerate(plan.split("\n")) if "FileScan parquet" in line]
    lines = plan.split("\n")
    assert scans and all("BroadcastHashJoin" in "".join(lines[max(i - 6, 0):i]) for i in scans)


def test_partial_update_touches_only_set_fields(spark):
    base = spark.createDataFrame([(1, "x", 1, 0), (2, "y", 2, 0)], "id int, a string, b int, updated_at int")
    patch = spark.createDataFrame([(1, None, 9)], "id int, a string, b int")
    assert rows_of(writes.partial_update(base, patch, ["id"], ["a", "b"], F.lit(7))) == [(1, "x", 9, 7), (2, "y", 2, 0)]


def test_merge_crawl_state(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    state = spark.createDataFrame([("a", ["u"], ["h"], False, 3, None, None)],
                                  "domain string, visited_urls array<string>, visited_hashes array<string>, is_complete "
                                  "boolean, pages_crawled int, started_at timestamp, completed_at timestamp")
    upd = spark.createDataFrame([("a", None, None, True, None), ("b", ["v"], None, None, 5)],
                                "domain string, visited_urls array<string>, visited_hashes array<string>, is_complete "
                                "boolean, pages_crawled int")
    got = {r["domain"]: r for r in writes.merge_crawl_state(state, upd, now).collect()}
    assert got["a"]["visited_urls"] == ["u"] and got["a"]["is_complete"] and got["a"]["pages_crawled"] == 3
    assert got["a"]["completed_at"] is not None and got["b"]["completed_at"] is None
    assert got["b"]["pages_crawled"] == 0 and not got["b"]["is_complete"] and got["b"]["started_at"] is not None


def test_guarded_transition(spark):
    df = spark.createDataFrame([(1, "queued", 1), (2, "completed", 1), (3, "running", 2)], "id int, status string, p int")
    only = spark.createDataFrame([(1,)], "p int")
    got = writes.guarded_transition(df, ["queued", "running"], "cancelled", only, ["p"])
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "cancelled", 2: "completed", 3: "running"}


def test_crawl_status_defaults(spark):
    domains = spark.createDataFrame([("a",), ("b",)], "domain string")
    states = spark.createDataFrame([("a", False, 4, 9, None, None)], "domain string, is_complete boolean, pages_crawled int, "
                                   "n_visited int, started_at timestamp, completed_at timestamp")
    got = {r["domain"]: r for r in joins.crawl_status_batch(domains, states).collect()}
    assert got["a"]["in_progress"] and not got["b"]["in_progress"]
    assert not got["b"]["fully_crawled"] and got["b"]["pages"] == 0 and got["b"]["visited_urls"] == 0


def test_ttl_lookup_uses_the_latest_entry_only(spark):
    now = dt.datetime(2024, 1, 31)
    ago = lambda h: now - dt.timedelta(hours=h)
    cache = spark.createDataFrame([("a", ago(167), 1), ("a", ago(400), 2), ("b", ago(169), 3), ("b", ago(500), 4),
                                   ("c", now + dt.timedelta(hours=1), 5), ("d", ago(168), 6)],
                                  "email string, verified_at timestamp, v int")
    asks = spark.createDataFrame([(i, e, now) for i, e in enumerate("abcde")], "request_id int, email string, at timestamp")
    got = {r["email"]: r["v"] for r in joins.ttl_lookup(asks, cache, "email", "at", "verified_at", ["v"]).collect()}
    assert got == {"a": 1, "b": None, "c": None, "d": 6, "e": None}


def test_social_map_last_link_wins(value):
    link = lambda p, u: F.struct(F.lit(p).alias("platform"), F.lit(u).alias("url"))
    assert value(joins.social_map(F.array(link("x", "1"), link("y", "2"), link("x", "3")))) == {"x": "3", "y": "2"}


def test_backlink(spark):
    rows = [("acme.com", '<a href="https://l.ig.com/?u=http%253A%252F%252Fwww.acme.com">x</a>', True),
            ("acmegloves.de", "<p>visit acmegloves.co.uk today</p>", True), ("tiny.de", "<p>tiny.com</p>", False),
            ("acme.com", '<link rel="canonical" href="https://acme.org">', False),
            ("acme.com", '<a href="/x">Acme.com</a>', True)]
    df = spark.createDataFrame(rows, "domain string, html string, want boolean")
    assert all(r["want"] == r["got"] for r in joins.verify_backlinks(df, "got").collect())


def test_robots_longest_prefix(spark):
    links = spark.createDataFrame([("https://a.com/x/1",), ("https://a.com/x/pub/1",), ("https://a.com",), ("https://b.com/x/1",)],
                                  "url string")
    rules = spark.createDataFrame([("a.com", "*", "disallow", "/x"), ("a.com", "*", "allow", "/x/pub"),
                                   ("a.com", "bot", "disallow", "/"), ("a.com", "*", "disallow", "")],
                                  "host string, agent string, rule string, prefix string")
    got = {r["url"] for r in filters.robots_filter(links, rules).collect()}
    assert got == {"https://a.com/x/pub/1", "https://a.com", "https://b.com/x/1"}


def test_contact_plan_and_cards(spark):
    d = spark.createDataFrame([("a.com",)], "domain string")
    assert [r["url"] for r in filters.contact_page_plan(d).orderBy("position").collect()] == [
        "https://a.com", "https://a.com/contact", "https://a.com/kontakt", "https://a.com/contacto"]
    assert filters.contact_page_plan(d, "aggressive").count() == 7
    assert filters.contact_page_plan(d, "aggressive", 5).count() == 5


def test_topk_is_a_prefix_of_the_full_sort(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(300, 8)).round(3)
    vecs[5] = vecs[9]
    vecs[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)],
                               "vec_id long, embedding array<float>").repartition(6)
    queries = [vecs[9].tolist(), vecs[50].tolist()]
    got = ordering.topk_cosine(df, queries, 20).collect()
    unit = vecs.astype("float32").astype("float64")
    norm = np.linalg.norm(unit, axis=1)
    for q, vec in enumerate(queries):
        sims = unit @ np.asarray(vec) / np.where(norm == 0, 1, norm) / np.linalg.norm(vec)
        want = sorted(range(300), key=lambda i: (-round(sims[i], 12), i))[:20]
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: (-round(r["similarity"], 12), r["vec_id"]))
        assert [r["vec_id"] for r in mine] == want
    assert ordering.topk_cosine(df, queries[:1], 300, min_similarity=0.5).count() == sum(
        unit @ np.asarray(queries[0]) / np.where(norm == 0, 1, norm) / np.linalg.norm(queries[0]) >= 0.5)


def test_page_arithmetic():
    assert ordering.page_to_skip(3, 50) == 100 and ordering.skip_to_page(100, 50) == 3
    assert ordering.clamp_limit(500) == 100 and ordering.clamp_limit(-3) == 1


def test_empty_reports(spark):
    empty = spark.createDataFrame([], "domain string, status string, sent_at timestamp")
    assert reports.send_stats(empty).head()["total_sent"] == 0
    none = spark.createDataFrame([], "is_valid boolean, reason string, seconds double")
    assert reports.verification_summary(none).head()["valid_pct"] is None


def test_backlink_texts_are_made_once_per_page(spark):
    rows = [(1, "longname.com", '<a href="https://l.x.com/?u=https%3A%2F%2Flongname.com%2F">x</a>'), (2, "longname.zz", "see longname.io"),
            (3, "other-name.dev", '<a href="https://longname.com">x</a>'), (4, "abc.zz", "see abc.io"), (5, None, "x.com"), (6, "x.com", None)]
    found = joins.verify_backlinks(spark.createDataFrame(rows, "n int, domain string, html string"))
    assert {r["n"]: r["verified"] for r in found.collect()} == {1: True, 2: True, 3: False, 4: False, 5: None, 6: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # one search over all patterns: the texts were made anew for each of two lists, and for each pattern in them
    assert plan.lower().count("exists(") == 2
