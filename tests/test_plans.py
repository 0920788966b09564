import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from orgweave.functions.scores import pattern_score
from orgweave.operators.similarity import fuzzy_domain_join, name_parts
from orgweave.plans import chunks as ch
from orgweave.plans import crawl, discovery, retrieval, vetting
from orgweave.plans.duplicates import duplicate_check


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_blocked_join_equals_nested_loop(spark):
    rng = random.Random(3)
    stems = ["acme", "acmo", "a", "ab", "", "gk-pro", "gkpro", "shop", "bestacme", "acmeshop", "ac-me", "acmestore", "x"]
    stems += ["".join(rng.choice("abc-") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    domains = sorted({f"{s}.{t}" for s in stems for t in ("com", "us")})
    new = spark.createDataFrame([(d,) for d in domains[::2]], "domain string")
    old = spark.createDataFrame([(d,) for d in domains[1::2]] + [(domains[0],)], "domain string")
    a, b = name_parts(new), name_parts(old)
    b = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns])
    every = a.join(b, F.col("domain") != F.col("o_domain")).select("domain", "o_domain", pattern_score(
        F.col("brand"), F.col("stem"), F.col("tld"), F.col("o_brand"), F.col("o_stem"), F.col("o_tld")).alias("s"))
    for threshold in (0.20, 0.30, 0.40):
        assert rows_of(fuzzy_domain_join(new, old, threshold)) == rows_of(every.where(F.col("s") >= threshold))


FEATURES = "struct<company_name:string,title:string,description:string,emails:array<string>,social:map<string,string>>"


def test_duplicate_check_decisions(spark):
    page = lambda name, mail: (name, "", "", [mail] if mail else [], {})
    new = spark.createDataFrame([("acmo.com", page("Acme", "x@acme.com")), ("zzzzzzz.com", page("Z", "")), ("acmi.com", None),
                                 ("acma.com", page("Other words", ""))], f"domain string, features {FEATURES}")
    old = spark.createDataFrame([("acme.com", 1, page("Acme", "y@acme.com")), ("acme.net", 2, page("Acme", "y@acme.com")),
                                 ("acmee.org", 3, None)], f"domain string, seq int, features {FEATURES}")
    got = {r["domain"]: r for r in duplicate_check(new, old).collect()}
    dup = got["acmo.com"]
    assert dup["status"] == "DUPLICATE" and dup["primary_domain"] == "acme.com" and dup["action"] == "skip"
    assert dup["total_score"] == pytest.approx(0.75)
    assert got["zzzzzzz.com"]["reason"] == "No pattern matches found"
    assert got["acmi.com"]["reason"] == "Could not fetch homepage for comparison"
    assert got["acma.com"]["status"] == "UNIQUE" and got["acma.com"]["reason"] is None
    first = duplicate_check(new, old.limit(0)).collect()
    assert {r["reason"] for r in first} == {"First domain to be crawled"}


@pytest.mark.parametrize("x,text", [(0.245, "0.24"), (0.125, "0.12"), (0.375, "0.38"), (0.3, "0.30"), (1.0, "1.00"), (0.0, "0.00"),
                                    (0.996, "1.00"), (0.235, "0.23"), (0.615, "0.61"), (0.985, "0.98")])
def test_fixed2_is_exact(value, x, text):
    assert f"{x:.2f}" == text
    assert value(vetting.fixed2(F.lit(x))) == text


def test_vetting(spark):
    domains = spark.createDataFrame([("gk-keeper.com",), ("a.com",), ("b.com",), ("c.com",)], "domain string")
    home = spark.createDataFrame([("a.com", "<p>buy keeper gloves. gloves</p>"), ("b.com", "<p>keeper gloves</p>"),
                                  ("c.com", "<p>shop</p>")], "domain string, html string")
    got = {r["domain"]: r for r in vetting.vet_domains(domains, home, ["keeper", "gloves"]).collect()}
    assert got["gk-keeper.com"]["status"] == "approved" and got["gk-keeper.com"]["ecommerce_terms"] == ["domain-name-match"]
    assert got["a.com"]["relevance_score"] == 0.72 and got["a.com"]["status"] == "approved"
    assert got["b.com"]["reason"] == "No e-commerce indicators found (need 1, found 0)"
    assert got["c.com"]["reason"].startswith("Low keyword relevance (content: 0.00, domain: 0.00")


def queue_walk(seed, edges, max_depth, max_pages, before=()):
    seen, todo, out = set(before), deque([(seed, 0)]), []
    while todo and len(seen) < max_pages:
        url, depth = todo.popleft()
        if url in seen or url.endswith(".pdf"):
            continue
        seen.add(url)
        out.append((url, depth))
        if depth < max_depth:
            todo.extend((nxt, depth + 1) for nxt in edges.get(url, []) if nxt not in seen)
    return out


@pytest.mark.parametrize("max_pages", [1, 7, 23, 500])
def test_walk_equals_a_queue(spark, max_pages):
    rng = random.Random(max_pages)
    edges = {}
    for host in ("a.com", "b.com"):
        urls = [f"https://{host}/{i}" + (".pdf" if i % 9 == 8 else "") for i in range(60)]
        for u in urls:
            edges[u] = rng.sample(urls, 4)
    rows = [(u, v, i) for u, vs in edges.items() for i, v in enumerate(vs)]
    e = spark.createDataFrame(rows, "from_url string, url string, pos int")
    seeds = spark.createDataFrame([("a.com", "https://a.com/0/"), ("b.com", "https://b.com/1#x")], "domain string, url string")
    visited = spark.createDataFrame([("b.com", "https://b.com/2"), ("b.com", "https://b.com/3")], "domain string, url string")
    got = crawl.link_bfs(seeds, e, 3, max_pages, visited).orderBy("domain", "position").collect()
    for domain, seed, before in (("a.com", "https://a.com/0", ()), ("b.com", "https://b.com/1",
                                                                   ("https://b.com/2", "https://b.com/3"))):
        mine = [(r["url"], r["depth"]) for r in got if r["domain"] == domain]
        assert mine == queue_walk(seed, edges, 3, max_pages, before)


def test_link_edges(spark):
    pages = spark.createDataFrame([("https://a.com/x/", ["/b#1", "b", "//a.com/b/", "https://c.com/", ""])],
                                  "url string, hrefs array<string>")
    got = rows_of(crawl.link_edges(pages, F.col("hrefs")))
    assert got == [("https://a.com/x", "https://a.com/b", 0), ("https://a.com/x", "https://a.com/x/b", 1)]


def test_chunks_cover_the_text_and_respect_size():
    rng = random.Random(5)
    text = " ".join(rng.choice(["word", "other", "end."]) for _ in range(5000))
    out = ch.chunk_text(text, size=200, overlap=30, min_tokens=1)
    words = text.split()
    assert len(out) > 10
    assert sum(len(c.split()) for c in out) >= len(words)
    # a chunk is a 30 token overlap plus units that fit
    longest = max(len(s.split()) for s in text.replace(". ", ".\n").split("\n"))
    assert all(len(c.split()) <= 200 + longest for c in out)
    for a, b in zip(out, out[1:]):
        assert b.split()[:30] == a.split()[-30:]
    joined = out[0].split() + [w for c in out[1:] for w in c.split()[30:]]
    assert joined == words


def test_chunks_follow_headers_and_paragraphs():
    text = "# One\n" + "a " * 30 + "\n# Two\n" + "b " * 30
    assert ch.chunk_text(text, size=40, overlap=0, min_tokens=1) == ["# One\n" + "a " * 30, "# Two\n" + "b " * 30]
    assert ch.chunk_text("p one\n\np two\n\n\n", size=2, overlap=0, min_tokens=1) == ["p one", "p two"]
    assert ch.chunk_text("short", min_tokens=2) == [] and ch.chunk_text(None) == []


def test_record_chunks(spark):
    from orgweave.plans.chunks import company_chunks
    df = spark.createDataFrame([("a.com", "Acme", None, ["n"], [("email", "x@a.com"), ("fax", "1")])],
                               "domain string, company_name string, description string, notes array<string>, "
                               "contacts array<struct<type:string,value:string>>")
    row = company_chunks(df).head()
    assert row["content"] == "Company: Acme\nKey Insights:\n- n\nContact Information:\nEmail: x@a.com"
    assert row["chunk_id"] == "a.com_company" and row["tokens"] == 10


def test_embed_domain_is_incremental(spark):
    shared = "chunk_id string, domain string, collection_name string, content string, content_hash string, tokens int"
    make = lambda rows: spark.createDataFrame([(i, "d", "raw_pages", c, c, 1) for i, c in rows], shared)
    none = retrieval.embed_batches(make([("x", "x")])).limit(0)
    one = retrieval.embed_domain([make([("1", "a"), ("2", "b")])], none)
    stored = one["embeddings"].cache()
    assert stored.count() == 2
    two = retrieval.embed_domain([make([("1", "a"), ("2", "changed"), ("3", "c")])], stored)
    assert [tuple(r) for r in two["stats"].collect()] == [("d", "raw_pages", 2, 1)]
    assert {(r["chunk_id"], r["content"]) for r in two["embeddings"].collect()} == {("1", "a"), ("2", "changed"), ("3", "c")}


def test_embedder_sees_bounded_batches(spark):
    def strict(texts):
        assert len(texts) <= 100
        return [[float(len(t))] for t in texts]
    df = spark.range(450).select(F.col("id").cast("string").alias("content")).coalesce(1)
    assert retrieval.embed_batches(df, strict).where("embedding[0] = length(content)").count() == 450


def test_query_expansion_keeps_base_and_limits(spark):
    v = spark.createDataFrame([("gk", 0), ("glove", 1)], "variant string, pos long")
    q = [r["query"] for r in discovery.expand_queries(v, ["Glove buy", "base kw"], negatives=(), max_queries=20).collect()]
    assert "base kw" in q and len(q) in (21, 22) and len({x.lower() for x in q}) == len(q)
    full = {r["query"] for r in discovery.expand_queries(v, [], negatives=["-x"], per_family_cap=None, max_queries=None).collect()}
    assert {"gk buy -x", "buy gk -x", "glove price site:.de -x", "gk sale us -x", "gk inurl:/shop -x"} <= full
    assert len(full) == 2 * (13 + 8 + 5 + 15 + 15)


def test_save_discovery(spark):
    results = spark.createDataFrame([(1, "new.com", "New", "s", "bing"), (2, "shop.acme.us", "A", None, None),
                                     (3, "acme.com", "A", "s", "g"), (4, "bad.com", "B", "s", "g"), (5, "unvetted.com", "", "", "")],
                                    "seq long, domain string, title string, snippet string, source string")
    vetted = spark.createDataFrame([("new.com", "approved", 0.5), ("shop.acme.us", "approved", 0.4), ("acme.com", "approved", 0.9),
                                    ("bad.com", "rejected", 0.0)], "domain string, status string, relevance_score double")
    companies = spark.createDataFrame([(7, "me", "acme.com"), (9, "me", "acme.org"), (8, "you", "new.de")],
                                      "id int, owner string, domain string")
    found = spark.createDataFrame([("new.com", "google")], "domain string, engine string")
    out = discovery.save_discovery(results, vetted, found, companies, "me")
    assert [r["domain"] for r in out["companies"].collect()] == ["new.com"]
    assert [(r["primary_domain"], r["alias_domain"]) for r in out["aliases"].collect()] == [("acme.com", "shop.acme.us")]
    assert tuple(out["counts"].head()) == (5, 4, 3, 1, 1)
    assert rows_of(out["discovered"]) == [("acme.com", "g"), ("bad.com", "g"), ("new.com", "google"), ("shop.acme.us", "unknown")]


def test_extraction(spark):
    from orgweave.plans.extraction import extract_profiles
    pages = spark.createDataFrame(
        [("d", 1, "https://d.com/x", "X", "hello jo@d.com"), ("d", 2, "https://d.com/about", "About us here", "we twitter.com/acme"),
         ("d", 3, "https://d.com/z", None, "z" * 90)],
        "domain string, page_id long, url string, title string, content string")
    out = extract_profiles(pages, F.col("url").contains("about"), chunk_chars=120)
    chunks = [r["chunk"] for r in out["chunks"].orderBy("chunk_no").collect()]
    assert chunks[0].startswith("# About us here\nURL: https://d.com/about") and "# Page" in chunks[-1]
    assert out["profile"].head()["company"] == "About us here"
    assert [r["value"] for r in out["values"].where("field = 'email'").collect()] == ["jo@d.com"]
    assert out["socials"].head()["url"] == "https://twitter.com/acme"


def test_embed_domain_hands_over_few_rows_at_a_time(spark):
    from orgweave.plans.retrieval import TEXT_ROWS, embed_domain
    from orgweave.session import arrow_rows

    @F.pandas_udf("int")
    def rows_at_once(col):
        return col * 0 + len(col)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    chunks = spark.range(0, 3 * TEXT_ROWS, 1, 1).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("d").alias("domain"), F.lit("raw_pages").alias("collection_name"),
        F.concat(F.lit("text "), "id").alias("content"), F.col("id").cast("string").alias("content_hash"),
        rows_at_once("id").alias("tokens"))
    stored = chunks.withColumn("embedding", F.array().cast("array<float>")).where("false")
    out = embed_domain([chunks], stored)
    assert out["embeddings"].agg(F.max("tokens"), F.count("embedding")).head() == (TEXT_ROWS, 3 * TEXT_ROWS)
    assert spark.conf.get(key) == before
    with arrow_rows(spark, 10 ** 9):
        assert spark.conf.get(key) == before
