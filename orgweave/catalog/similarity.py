"""Name and page similarity; L2, U12-U14: vectors."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.catalog.scalars_page import EMAILS_SQL, TITLE_SQL
from orgweave.catalog.scalars_url import BRAND_SQL
from orgweave.functions import html as H
from orgweave.functions import scores, urls
from orgweave.operators import ordering
from orgweave.operators.similarity import best_duplicate, fuzzy_domain_join
from orgweave.partitioning import first_n_per_key
from orgweave.plans import retrieval
from orgweave.plans.duplicates import duplicate_check
from orgweave.session import cut_lineage, stored

SCORE_SQL = """(case when a.brand = b.brand and a.tld <> b.tld then 0.40::double when a.stem = b.stem then 0.35::double
  when levenshtein(a.brand, b.brand) = 1 then 0.35::double when levenshtein(a.brand, b.brand) = 2 then 0.30::double
  when a.brand <> '' and b.brand <> '' and (contains(a.brand, b.brand) or contains(b.brand, a.brand)) then 0.25::double
  else 0.0::double end)"""
PARTS_SQL = rf"""select domain, {BRAND_SQL.format('domain')} as brand, regexp_replace(lower(string_split(domain, '.')[1]),
  '[-_]', '', 'g') as stem, regexp_extract(domain, '([^.]+)$', 1) as tld"""
REG_SQL = rf"""{st.SITES}, reg as (select distinct regexp_extract(site, '([^.]+\.[^.]+)$', 1) as domain from sites)"""
NEW_SQL = rf"""{REG_SQL}, fresh as (select regexp_replace(domain, '\.[a-z]+$', '.co') as domain from reg
  union select regexp_replace(domain, '^([^.]+)', '\1-shop') from reg union select substr(domain, 2) from reg
  union select regexp_replace(domain, '^([^.]+)', 'best\1') from reg)"""


def registered(spark, d):
    sites = st.sites(spark, d)
    return urls.registrable_domain(sites, "site", st.suffix_rules(spark), "domain")


def fresh_domains(spark, d):
    domain = F.col("domain")
    return registered(spark, d).select(F.explode(F.array(
        F.regexp_replace(domain, r"\.[a-z]+$", ".co"), F.regexp_replace(domain, r"^([^.]+)", "$1-shop"),
        F.expr("substring(domain, 2)"), F.regexp_replace(domain, r"^([^.]+)", "best$1"))).alias("domain")).distinct()


@query("f45_pattern_score", rf"""with {REG_SQL}, pr as (select domain as x, regexp_replace(domain, '\.[a-z]+$', '.co') as y
  from reg union select domain, regexp_replace(domain, '^([^.]+)', '\1-shop') from reg union select domain, substr(domain, 2)
  from reg union select domain, regexp_replace(domain, '^([^.]+)', 'best\1') from reg
  union select domain, substr(domain, 3, 1) || substr(domain, 4) from reg),
names as (select x as domain from pr union select y from pr), p as ({PARTS_SQL} from names)
select x as domain, y as other, {SCORE_SQL} as score from pr join p a on a.domain = x join p b on b.domain = y""")
def f45(spark, d):
    from orgweave.operators.similarity import name_parts
    domain = F.col("domain")
    pairs = registered(spark, d).select("domain", F.explode(F.array(
        F.regexp_replace(domain, r"\.[a-z]+$", ".co"), F.regexp_replace(domain, r"^([^.]+)", "$1-shop"),
        F.expr("substring(domain, 2)"), F.regexp_replace(domain, r"^([^.]+)", "best$1"),
        F.expr("substring(domain, 3)"))).alias("other")).distinct()
    parts = name_parts(pairs.select("domain").union(pairs.select("other")))
    b = parts.select(*[F.col(c).alias(f"o_{c}") for c in parts.columns])
    j = pairs.join(parts, "domain").join(b, F.col("other") == F.col("o_domain"))
    return j.select("domain", "other", scores.pattern_score(
        F.col("brand"), F.col("stem"), F.col("tld"), F.col("o_brand"), F.col("o_stem"), F.col("o_tld")).alias("score"))


@query("j11_fuzzy_domain_join", f"""with {NEW_SQL}, a as ({PARTS_SQL} from fresh), b as ({PARTS_SQL} from reg)
select a.domain, b.domain as candidate, {SCORE_SQL} as pattern_score from a, b
where a.domain <> b.domain and {SCORE_SQL} >= 0.2""")
def j11(spark, d):
    return fuzzy_domain_join(fresh_domains(spark, d), registered(spark, d))


# every word of the documents as a one-label domain, of any length and language: no all-pairs SQL
@query("j11_fuzzy_domain_join_words")
def j11_words(spark, d):
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))))
    words = stored(table(spark, d, "documents").select(word.alias("w"), F.coalesce("lang", F.lit("xx")).alias("lang")).distinct(), "words")
    new = words.select(F.concat_ws(".", "w", "lang").alias("domain"))
    old = words.select(F.concat("w", F.lit(".com")).alias("domain"))
    return fuzzy_domain_join(new, old)


RICH_FEATURES = f"""{st.RICH}, firsts as (select min(page_id) as page_id from rich group by site), feat as (
  select page_id, regexp_extract(site, '([^.]+\\.[^.]+)$', 1) as domain, html
  from rich where page_id in (select page_id from firsts)),
one as (select * from feat where page_id in (select min(page_id) from feat group by domain)),
ff as (select domain, page_id as seq, {TITLE_SQL} as title,
  regexp_extract(html, '(?is)<meta[^>]*\\bcontent="([^"]*)"[^>]*\\bproperty="og:site_name"', 1) as og,
  regexp_extract(html, '(?is)<meta[^>]*\\bname="description"[^>]*\\bcontent="([^"]*)"', 1) as descr,
  list_distinct(list_filter({EMAILS_SQL.format('html')}, lambda e: not regexp_matches(lower(e),
    'example\\.com|sentry\\.io|google|facebook\\.com'))) as emails,
  regexp_extract(html, 'facebook\\.com/([a-zA-Z0-9_.]+)', 1) as fb,
  regexp_extract(html, 'twitter\\.com/([a-zA-Z0-9_]+)', 1) as tw from one),
fe as (select domain, seq, title, descr, emails, fb, tw, case when og <> '' then og when contains(title, ' - ') then
  trim(string_split(title, ' - ')[1]) when contains(title, ' | ') then trim(string_split(title, ' | ')[1])
  else title end as name from ff)"""


# DuckDB's levenshtein counts bytes: the characters of both sides are renamed to one byte each first
ONE_BYTE = "".join(chr(i) for i in range(1, 128) if chr(i) != "'")


def edits_sql(a: str, b: str) -> str:
    used = f"array_to_string(list_distinct(string_split({a} || {b}, '')), '')"
    renamed = lambda x: f"translate({x}, {used}, substr('{ONE_BYTE}', 1, length({used})))"
    return f"levenshtein({renamed(a)}, {renamed(b)})"


def sim_sql(x: str, y: str) -> str:
    a, b = f"trim(lower({x}))", f"trim(lower({y}))"
    return (f"(case when {x} = '' or {y} = '' then 0.0::double when {a} = {b} then 1.0::double else greatest(0.0::double, "
            f"1.0::double - {edits_sql(a, b)}::double / greatest(length({a}), length({b}))) end)")


WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[^ \\t\\r\\n]+'))"
HOME_SQL = f"""(0.25::double * {sim_sql('x.name', 'y.name')}
  + (case when len(list_intersect(list_transform(x.emails, lambda e: lower(string_split(e, '@')[2])),
      list_transform(y.emails, lambda e: lower(string_split(e, '@')[2])))) > 0 then 0.15::double else 0.0::double end)
  + 0.10::double * (case when x.descr = '' or y.descr = '' then 0.0::double else
      len(list_intersect({WORDS('x.descr')}, {WORDS('y.descr')}))::double
      / len(list_distinct(list_concat({WORDS('x.descr')}, {WORDS('y.descr')}))) end)
  + 0.05::double * {sim_sql('x.title', 'y.title')}
  + 0.05::double * least(((x.fb = y.fb)::int + (x.tw = y.tw)::int) / 3.0::double, 1.0::double))"""


def site_features(spark, d):
    """One feature struct per registrable domain, from its first page, as a stored table."""
    rich = urls.registrable_domain(st.rich_pages(spark, d), "site", st.suffix_rules(spark), "domain")
    return cut_lineage(first_n_per_key(rich, ["domain"], ["page_id"]).select(
        "domain", F.col("page_id").alias("seq"), H.homepage_features(F.col("html")).alias("features")))


def new_features(spark, d, known):
    """Fresh domains; those with the .co suffix and the -shop label carry the page of their original."""
    fresh = fresh_domains(spark, d)
    co = known.select(F.regexp_replace("domain", r"\.[a-z]+$", ".co").alias("domain"), "features", "seq")
    shop = known.select(F.regexp_replace("domain", r"^([^.]+)", "$1-shop").alias("domain"), "features", "seq")
    pages = first_n_per_key(co.unionByName(shop), ["domain"], ["seq"]).drop("seq")
    return fresh.join(pages, "domain", "left")


PAIRS_SQL = f"""{NEW_SQL}, {RICH_FEATURES.replace(st.PG + ', ', '', 1)}, a as ({PARTS_SQL} from fresh), b as ({PARTS_SQL} from reg),
pairs as (select a.domain, b.domain as candidate, {SCORE_SQL} as pattern_score from a, b where a.domain <> b.domain
  and {SCORE_SQL} >= 0.2),
np as (select regexp_replace(domain, '\\.[a-z]+$', '.co') as domain, * exclude (domain) from fe union all
  select regexp_replace(domain, '^([^.]+)', '\\1-shop'), * exclude (domain) from fe),
nf as (select * from np qualify row_number() over (partition by domain order by seq) = 1),
scored as (select p.domain, p.candidate, p.pattern_score, y.seq, {HOME_SQL} as homepage_score from pairs p
  join nf x on x.domain = p.domain join fe y on y.domain = p.candidate)"""


F46_SQL = f"""with {PAIRS_SQL} select domain, candidate, round(homepage_score, 6) as score from scored"""


@query("f46_homepage_score", F46_SQL)
@query("f46_homepage_score_whole", F46_SQL)
def f46(spark, d):
    return scored_pairs(spark, d).select("domain", "candidate", F.round("homepage_score", 6).alias("score"))


def scored_pairs(spark, d):
    pairs = fuzzy_domain_join(fresh_domains(spark, d), registered(spark, d))
    known = site_features(spark, d)
    old = known.select(F.col("domain").alias("candidate"), "seq", F.col("features").alias("old"))
    new = new_features(spark, d, known).where("features is not null")
    return pairs.join(new, "domain").join(old, "candidate").withColumn(
        "homepage_score", scores.homepage_score(F.col("features"), F.col("old"))).drop("features", "old")


W6_SQL = f"""with {PAIRS_SQL} select domain, candidate, round(pattern_score + homepage_score, 6) as total
from scored qualify row_number() over (partition by domain order by pattern_score + homepage_score desc, seq) = 1"""


@query("w6_best_duplicate", W6_SQL)
@query("w6_best_duplicate_whole", W6_SQL)
def w6(spark, d):
    return best_duplicate(scored_pairs(spark, d)).select("domain", "candidate", F.round("total_score", 6).alias("total"))


U17_SQL = f"""with {PAIRS_SQL}, best as (select * from scored
  qualify row_number() over (partition by domain order by pattern_score + homepage_score desc, seq) = 1)
select f.domain, case when pattern_score + homepage_score >= 0.70 then 'DUPLICATE' else 'UNIQUE' end as status,
  case when pattern_score + homepage_score >= 0.70 then candidate end as primary_domain,
  case when f.domain not in (select domain from pairs) then 'No pattern matches found'
    when f.domain not in (select domain from nf) then 'Could not fetch homepage for comparison' end as reason,
  round(pattern_score + homepage_score, 6) as total
from fresh f left join best on best.domain = f.domain"""


@query("u17_duplicate_check", U17_SQL)
@query("u17_duplicate_check_whole", U17_SQL)
def u17(spark, d):
    known = site_features(spark, d)
    return duplicate_check(cut_lineage(new_features(spark, d, known)), known).select(
        "domain", "status", "primary_domain", "reason", F.round("total_score", 6).alias("total"))


@query("f47_cosine", """select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)
  as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def f47(spark, d):
    emb = table(spark, d, "embeddings")
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return emb.join(nxt, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 6)
                                          .alias("similarity"))


def query_vectors(spark, d, n):
    """The first vectors of the table as query vectors."""
    rows = table(spark, d, "embeddings").where(F.col("vec_id") < n).orderBy("vec_id").limit(n).collect()
    return [list(r["embedding"]) for r in rows]


COS_SQL = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query("l2_topk_cosine", f"""select e.vec_id, e.label, round({COS_SQL}, 6) as similarity from embeddings e,
  (select embedding from embeddings where vec_id = 0) q where e.label < 5 and {COS_SQL} >= 0.0
order by {COS_SQL} desc, e.vec_id limit 10""")
def l2(spark, d):
    emb = table(spark, d, "embeddings").where("label < 5")
    return ordering.topk_cosine(emb, query_vectors(spark, d, 1), 10, min_similarity=0.0).select(
        "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("l2_topk_cosine_batch", f"""select q.vec_id::int as query, e.vec_id, round({COS_SQL}, 6) as similarity
from embeddings e, (select * from embeddings where vec_id < 25) q
qualify row_number() over (partition by q.vec_id order by round({COS_SQL}, 12) desc, e.vec_id) <= 5""")
def l2_batch(spark, d):
    return ordering.topk_cosine(table(spark, d, "embeddings"), query_vectors(spark, d, 25), 5).select(
        "query", "vec_id", F.round("similarity", 6).alias("similarity"))


def stored_vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.format_string("chunk_%06d", "vec_id").alias("chunk_id"), F.concat(F.lit("site"), F.col("label"), F.lit(".com"))
        .alias("domain"), F.when(F.col("label") < 7, "raw_pages").otherwise("companies").alias("collection_name"),
        F.concat(F.lit("text of "), F.col("vec_id")).alias("content"),
        F.when(F.col("label") > 2, F.concat(F.lit("https://x/"), F.col("vec_id"))).alias("url"),
        F.create_map(
            F.lit("brand"), F.concat(F.lit("b"), F.col("label")), F.lit("company"), F.concat(F.lit("c"), F.col("label") % 4))
        .alias("metadata"), "embedding")


STORED = """sv as (select printf('chunk_%06d', vec_id) as chunk_id, 'site' || label || '.com' as domain, case when label < 7
  then 'raw_pages' else 'companies' end as collection_name, 'text of ' || vec_id as content, case when label > 2 then
  'https://x/' || vec_id end as url, label, embedding from embeddings),
sc as (select *, list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 3)::double[])
  as s from sv)"""


@query("u12_retrieve", f"""with {STORED} select chunk_id, domain, collection_name, round(s, 6) as similarity,
  round(1.0::double - s, 6) as distance from sc where collection_name = 'raw_pages' and label = 5 and s >= 0.0
order by s desc, chunk_id limit 7""")
def u12(spark, d):
    q = query_vectors(spark, d, 4)[3]
    hits = retrieval.retrieve(stored_vectors(spark, d), q, 7, ["raw_pages"], {"brand": "b5"})
    return hits.select("chunk_id", "domain", "collection_name", F.round("similarity", 6).alias("similarity"),
                       F.round("distance", 6).alias("distance"))


@query("u13_competitors", f"""with {STORED}, t as (select * from sc where s >= 0.0 and collection_name = 'companies'
  and domain <> 'site3.com' and domain <> 'site8.com' order by s desc, chunk_id limit 15)
select domain, 'c' || (label % 4) as company, round(max(s), 6) as similarity, round(min(1.0::double - s), 6) as distance
from t group by all""")
def u13(spark, d):
    stored = stored_vectors(spark, d).where("domain <> 'site3.com'")
    hits = retrieval.competitors(stored, query_vectors(spark, d, 4)[3], "site8.com", 15)
    return hits.select("domain", "company", F.round("similarity", 6).alias("similarity"),
                       F.round("distance", 6).alias("distance"))


@query("u14_context_block", f"""with {STORED}, t as (select *, row_number() over (order by s desc, chunk_id) as n from sc
  where s >= 0.0 qualify n <= 5)
select string_agg('[Source ' || n || ': ' || collection_name || '] Domain: ' || domain || case when url is not null then
  ' URL: ' || url else '' end || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n) as context,
  string_agg('[' || collection_name || '] ' || content, chr(10) || chr(10) order by n) as plain from t""")
def u14(spark, d):
    hits = retrieval.retrieve(stored_vectors(spark, d), query_vectors(spark, d, 4)[3], 5).drop("metadata")
    plain = retrieval.context_block(hits, numbered=False).withColumnRenamed("context", "plain")
    return retrieval.context_block(hits).select("context", plain.scalar().alias("plain"))
