"""Similarity queries over whole pages and over all words, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from orgweave.catalog import similarity as S
from orgweave.functions.scores import homepage_score, pattern_score
from orgweave.operators import name_pairs
from orgweave.operators import similarity as op
from orgweave.plans.duplicates import best_matches, duplicate_check
from scripts.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def alike(a, b):
    if not a or not b:
        return 0.0
    a, b = a.lower().strip(" "), b.lower().strip(" ")
    return 1.0 if a == b else max(0.0, 1 - edits(a, b) / max(len(a), len(b)))


def words(text):
    return set(re.findall(r"[^ \t\r\n]+", (text or "").lower()))


def brute_score(a, b):
    hosts = [{e.split("@")[1].lower() for e in x["emails"] or []} for x in (a, b)]
    union = words(a["description"]) | words(b["description"])
    both = words(a["description"]) & words(b["description"]) if a["description"] and b["description"] else set()
    social = [dict(x["social"] or {}) if isinstance(x["social"], dict) else x["social"].asDict() for x in (a, b)]
    same = sum(bool(v) and social[1].get(k) == v for k, v in social[0].items())
    return (0.25 * alike(a["company_name"], b["company_name"]) + 0.15 * bool(hosts[0] & hosts[1])
            + 0.10 * (len(both) / len(union) if both else 0.0) + 0.05 * alike(a["title"], b["title"])
            + 0.05 * min(same / 3, 1))


@pytest.mark.parametrize("name", ["Привет мир", "你好公司", "Été à la plage"])
def test_names_in_other_scripts_are_compared(spark, tmp_path, monkeypatch, name):
    page = f"<html><head><title>{name} - home</title></head><body>{name}</body></html>"
    rows = spark.createDataFrame([(1, "a.com", page), (2, "b.com", page.replace(name, name[::-1]))],
                                 "page_id long, site string, html string")
    monkeypatch.setattr(S.st, "rich_pages", lambda spark, d: rows)
    found = {r.domain: r.features for r in S.site_features(spark, str(tmp_path)).collect()}
    assert found["a.com"]["company_name"] == name and found["b.com"]["company_name"] == name[::-1]
    assert brute_score(found["a.com"], found["a.com"]) >= 0.3 > brute_score(found["a.com"], found["b.com"])


def test_whole_pages_equal_brute_force(spark):
    known = S.site_features(spark, SF)
    old = {r.domain: r.features for r in known.collect()}
    new = {r.domain: r.features for r in S.new_features(spark, SF, known).where("features is not null").collect()}
    assert any(not f["title"].isascii() or not (f["description"] or "").isascii() for f in old.values())
    got = S.f46(spark, SF).collect()
    assert got and all(abs(r.score - brute_score(new[r.domain], old[r.candidate])) < 2e-6 for r in got)
    totals = {(r.domain, r.candidate): r for r in S.scored_pairs(spark, SF).collect()}
    best = {}
    for (d, c), r in totals.items():
        key = (-(r.pattern_score + r.homepage_score), r.seq)
        best[d] = min(best.get(d, (key, c)), (key, c))
    assert {r.domain: r.candidate for r in S.w6(spark, SF).collect()} == {d: c for d, (_, c) in best.items()}
    for r in S.u17(spark, SF).collect():
        total = -best[r.domain][0][0] if r.domain in best else None
        assert r.status == ("DUPLICATE" if total is not None and total >= 0.70 else "UNIQUE")


def test_words_of_all_documents_at_the_default_threshold(spark, tmp_path):
    texts = [("en", "a an Can candle handle x"), ("fr", "été a lé"), ("de", "größe groß ß"), (None, "кот котик"), ("es", None)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    new = spark.createDataFrame([(f"{w}.{lang or 'xx'}",) for lang, t in texts for w in (t or "").lower().split()], "domain string")
    old = new.select(F.concat(F.substring_index("domain", ".", 1), F.lit(".com")).alias("domain"))
    a = op.name_parts(new)
    b = op.name_parts(old).select(*[F.col(c).alias(f"c_{c}") for c in a.columns])
    every = a.crossJoin(b).where("domain <> c_domain").select("domain", F.col("c_domain").alias("candidate"), pattern_score(
        *[F.col(c) for c in ("brand", "stem", "tld", "c_brand", "c_stem", "c_tld")]).alias("pattern_score"))
    want = every.where("pattern_score >= 0.2")
    got = S.j11_words(spark, str(tmp_path))
    both = [rows_of(x.columns, [tuple(r) for r in x.collect()]) for x in (got, want)]
    assert both[0] == both[1] and got.where("pattern_score = 0.25").count() > 0


def test_pairs_of_a_short_brand_are_dealt_out(spark):
    long = spark.createDataFrame([(f"e{i}brand",) for i in range(640)], "a string")
    short = spark.createDataFrame([("e",)], "b string")
    assert op.containment_pairs(long, short).count() == 640
    parts = long.withColumn("b", F.lit("e")).groupBy(op._dealt("b", "a")).count().collect()
    assert len(parts) > 32 and max(r["count"] for r in parts) < 64


@pytest.mark.parametrize("group_rows", [200_000, 50])
def test_containment_of_100000_brands_equals_a_lookup_of_all_substrings(spark, monkeypatch, group_rows):
    monkeypatch.setattr(op, "GROUP_ROWS", group_rows)  # the second deals common beginnings over many groups
    rng = random.Random(group_rows)
    syllables = ["shop", "a", "be", "cor", "é", "日本", "du", "x"]
    n = 100_000 if group_rows > 1000 else 2000
    brands = sorted({"".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) for _ in range(n)} | {
        f"{i:x}brand{i * 7919 % 65536:x}" for i in range(n)})
    old = set(brands[::2]) | {"shop", "sho", "e", "本", ""}
    want = set()
    for x in brands:
        want.update((x, x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if x[i:j] in old)
    got = op.containment_pairs(spark.createDataFrame([(b,) for b in brands], "a string"),
                               spark.createDataFrame([(b,) for b in sorted(old)], "b string")).distinct()
    assert len(brands) >= n and len(want) > len(brands) / 4
    assert {tuple(r) for r in got.collect()} == want


def crowd(rng, n):
    """Domains with short, equal, near and nested brands, and pages of which some are missing or alike."""
    labels = ["a", "e", "ab", "abc", "acme", "acmee", "acne", "acmeshop", "my-acme", "best", "bestacme", "shop", "zzz"]
    out = {}
    for _ in range(n):
        label = rng.choice(labels) + rng.choice(["", "", "x", "1", "co"])
        page = None if rng.random() < 0.2 else {
            "company_name": rng.choice(["", "Acme", "ACME inc", "Été", "Bést", "Zed"]), "title": rng.choice(["", "Home", "Acme home"]),
            "description": rng.choice([None, "", "we sell shoes", "we sell red shoes", "other"]),
            "emails": rng.choice([[], ["a@acme.com"], ["b@ACME.com", "c@x.com"], ["d@y.com"]]),
            "social": rng.choice([{}, {"facebook": "acme"}, {"facebook": "@Acme", "twitter": "acme"}])}
        out[f"{label}.{rng.choice(['com', 'de', 'co', 'shop'])}"] = page
    return sorted(out.items())


def test_the_best_match_equals_the_full_join(spark):
    rng = random.Random(6)
    page = ("features struct<company_name:string,title:string,description:string,emails:array<string>,"
            "social:map<string,string>>")
    new = spark.createDataFrame(crowd(rng, 300) + [("qqqqqq.com", None), ("wwwwwwww.de", dict.fromkeys(
        ["company_name", "title", "description"], "w") | {"emails": [], "social": {}})], f"domain string, {page}")
    old = spark.createDataFrame([(d, i * 7 % 50, f) for i, (d, f) in enumerate(crowd(rng, 300))],
                                f"domain string, seq long, {page}")
    pairs = op.fuzzy_domain_join(new, old)
    olds = old.select(F.col("domain").alias("candidate"), "seq", F.col("features").alias("old"))
    full = pairs.join(new, "domain").join(olds, "candidate").where("features is not null and old is not null").withColumn(
        "homepage_score", homepage_score(F.col("features"), F.col("old")))
    want = {}
    for r in full.collect():
        key = (r.pattern_score + r.homepage_score, -r.seq)
        want[r.domain] = max(want.get(r.domain, key), key)
    matched = {r.domain for r in pairs.collect()}
    seqs = {r.domain: r.seq for r in old.collect()}
    got = best_matches(new, old).collect()
    assert len(got) == new.count() and {r.domain for r in got if r.matched} == matched
    assert {r.domain: (r.best.total_score, -seqs[r.best.candidate]) for r in got if r.best} == want
    status = {r.domain: r.reason for r in duplicate_check(new, old).collect()}
    assert status["qqqqqq.com"] == "No pattern matches found" == status["wwwwwwww.de"]
    assert all(status[r.domain] == "Could not fetch homepage for comparison" for r in new.where("features is null").collect()
               if r.domain in matched)


@pytest.mark.parametrize("threshold", [0.20, 0.30])
def test_fuzzy_join_gives_each_pair_once_without_a_shuffle_of_names(spark, threshold):
    rng = random.Random(5)
    piece = lambda: "".join(rng.choice(["a", "b", "c", "-", "gk", "store", "shop", "best"]) for _ in range(rng.randint(1, 4)))
    names = lambda: [(f"{piece()}.{rng.choice(['com', 'de', 'co.uk', 'b.io'])}",) for _ in range(150)]
    new, old = (spark.createDataFrame(names(), "domain string") for _ in range(2))
    found = op.fuzzy_domain_join(new, old, threshold)
    got = sorted(tuple(r) for r in found.collect())
    b = op.name_parts(old).select(*[F.col(c).alias(f"c_{c}") for c in ("domain", "brand", "stem", "tld")])
    score = pattern_score(*[F.col(c) for c in ("brand", "stem", "tld", "c_brand", "c_stem", "c_tld")])
    nested = op.name_parts(new).crossJoin(b).where("domain <> c_domain").select("domain", "c_domain", score.alias("s"))
    assert got == sorted(tuple(r) for r in nested.where(F.col("s") >= threshold).collect()) and got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "c_stem" in line]


def nested_loop(new, old, threshold):
    b = op.name_parts(old).select(*[F.col(c).alias(f"c_{c}") for c in ("domain", "brand", "stem", "tld")])
    score = pattern_score(*[F.col(c) for c in ("brand", "stem", "tld", "c_brand", "c_stem", "c_tld")])
    pairs = op.name_parts(new).crossJoin(b).where("domain <> c_domain").select("domain", "c_domain", score.alias("s"))
    return sorted(tuple(r) for r in pairs.where(F.col("s") >= threshold).collect())


@pytest.mark.parametrize("threshold", [0.20, 0.35])
@pytest.mark.parametrize("size", [None, 40])
def test_pairs_of_names_in_blocks_equal_the_nested_loop(spark, monkeypatch, size, threshold):
    if size:  # brands of one length in many blocks, common beginnings in many groups, short brands in many parts
        for name in ("GROUP_ROWS", "BLOCK_KEYS", "PAST_ROWS", "SHORT_ROWS"):
            monkeypatch.setattr(name_pairs, name, size)
    rng = random.Random(8)
    piece = lambda: "".join(rng.choice(["a", "b", "ab", "é", "日", "𝒳", "gk", "-", "shop", "Best", " "]) for _ in range(rng.randint(0, 6)))
    odd = ["", "a", "aa", "a" * 30, "a" * 29 + "b", "a" * 31, "ab" * 20, "ba" * 20, "\0a", "=a", "!a", "a\nb", "official", "my-shop", "myshop"]
    names = lambda: [(f"{x}.{rng.choice(['com', 'de', 'co.uk'])}",) for x in [*(piece() for _ in range(150)), *odd]] + [(None,)]
    new, old = (spark.createDataFrame(names(), "domain string") for _ in range(2))
    found = sorted(tuple(r) for r in op.fuzzy_domain_join(new, old, threshold).collect())
    assert found == nested_loop(new, old, threshold) and found


def test_a_brand_of_thousands_of_domains_is_on_many_cards(spark):
    new = spark.createDataFrame([(f"acme.t{i}",) for i in range(2500)] + [("other.com",)], "domain string")
    old = spark.createDataFrame([("acme.t7",), ("acme.x",), ("acm.de",), ("bestacme.de",)], "domain string")
    cards = name_pairs.cards(op.name_parts(new), op.name_parts(old)).collect()
    assert sorted(r.a for r in cards if r.a and r.brand == "acme") == sorted(f"=.t{i}" for i in range(2500))
    assert sorted(r.b for r in cards if r.b) == ["=.de", "=.de", "=.t7", "=.x"]
    found = sorted(tuple(r) for r in op.fuzzy_domain_join(new, old).collect())
    assert found == nested_loop(new, old, 0.20) and len(found) == 4 * 2500 - 1


def test_pairs_of_names_are_not_shuffled_or_joined_again(spark):
    names = spark.createDataFrame([(f"{x}{y}.{t}",) for x in "abcde" for y in ["", "x", "yy", "zzz"] for t in ("com", "de")], "domain string")
    found = op.fuzzy_domain_join(names, names)

    def above_pairs(plan, above=()):
        if plan.nodeName() == "MapInArrow":
            yield set(above)
        for i in range(plan.children().size()):
            yield from above_pairs(plan.children().apply(i), (*above, plan.nodeName()))

    seen = list(above_pairs(found._jdf.queryExecution().optimizedPlan()))
    assert len(seen) >= 3 and set().union(*seen) <= {"Union", "Project", "Filter"}
