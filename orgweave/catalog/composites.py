"""Composite plans."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.catalog.scalars_contact import spans_sql, whatsapp_sql
from orgweave.catalog.scalars_page import visible_sql
from orgweave.catalog.scalars_text import STOP_SQL
from orgweave.catalog.scalars_url import NAME_KEY_SQL, TRIM_SQL
from orgweave.functions import html as H
from orgweave.functions import urls
from orgweave.functions.contacts import PHONE_PATTERNS
from orgweave.operators import filters, setops
from orgweave.partitioning import first_n_per_key, position
from orgweave.plans import chunks, crawl, discovery, enrichment, extraction, retrieval, vetting


def doc_pages(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat("source", F.lit(".com")).alias("domain"),
        F.concat(F.lit("https://"), "source", F.lit(".com/"), F.when(F.col("lang") == "en", "about/").otherwise("p/"),
                 "doc_id").alias("url"), F.col("lang").alias("title"), F.col("text").alias("content"),
        F.lit(1).alias("depth"))


@query("u1_semantic_chunks")
def u1(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.posexplode(chunks.semantic_chunks(F.col("text"), min_tokens=20)).alias("at", "chunk"))
    return docs.select("doc_id", "at", F.length("chunk").alias("n"), F.sha2("chunk", 256).alias("hash"))


@query("u2_page_chunks")
def u2(spark, d):
    return chunks.page_chunks(doc_pages(spark, d), min_tokens=20).drop("content")


@query("u3_product_chunks", r"""with p as (select p_partkey, lower(p_type) || '.com' as domain, case when p_size > 45 then
  'ext-' || p_partkey end as ext, row_number() over (partition by p_type order by p_partkey) - 1 as n,
  'Brand: ' || p_brand || chr(10) || 'Name: ' || p_name || chr(10) || 'Category: ' || p_type || chr(10)
  || 'Specifications: {"size": "' || p_size || '"}' || chr(10) || 'Price: $' || p_retailprice || chr(10)
  || 'Reviews: good | bad' as content from part)
select coalesce(ext, domain || '_product_' || n) as chunk_id, domain, sha256(content) as content_hash,
  len(regexp_extract_all(content, '[^ \t\r\n]+'))::int as tokens from p""")
def u3(spark, d):
    products = st.products(spark, d).select(
        "domain", "seq", F.when(F.col("p_size") > 45, F.concat(F.lit("ext-"), "seq")).alias("external_id"), "name", "brand",
        "category", F.lit(None).cast("string").alias("description"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("specs"), "price",
        F.array(F.lit("good"), F.lit("bad")).alias("reviews"), F.lit("").alias("url"))
    return chunks.product_chunks(products).select("chunk_id", "domain", "content_hash", "tokens")


@query("u4_company_chunks", r"""with c as (select 's' || s_suppkey || '.com' as domain, 'Company: ' || s_name
  || case when s_acctbal > 0 then chr(10) || 'Description: in nation ' || s_nationkey else '' end
  || case when s_nationkey > 9 then chr(10) || 'Key Insights:' || chr(10) || '- n' || s_nationkey || chr(10) || '- old'
    else '' end || chr(10) || 'Contact Information:' || chr(10) || 'Email: a@x.com, b@x.com' || chr(10)
  || 'Phone: +1' || s_suppkey || chr(10) || 'Address: here | there' as content from supplier)
select domain || '_company' as chunk_id, sha256(content) as content_hash,
  len(regexp_extract_all(content, '[^ \t\r\n]+'))::int as tokens from c""")
def u4(spark, d):
    nation = F.col("s_nationkey").cast("string")
    c = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    companies = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey", F.lit(".com")).alias("domain"), F.col("s_name").alias("company_name"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("in nation "), nation)).alias("description"),
        F.when(F.col("s_nationkey") > 9, F.array(F.concat(F.lit("n"), nation), F.lit("old"))).alias("notes"),
        F.array(c("email", F.lit("a@x.com")), c("phone", F.concat(F.lit("+1"), "s_suppkey")), c("address", F.lit("here")),
                c("email", F.lit("b@x.com")), c("address", F.lit("there"))).alias("contacts"))
    return chunks.company_chunks(companies).select("chunk_id", "content_hash", "tokens")


def _list(words):
    return "(values " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(words)) + ")"


NEG = " ".join(discovery.NEGATIVES)


@query("u5_expand_queries", f"""with v as (select lower(p_name) as v, min(p_partkey) as pos from part group by 1),
i(n, w) as {_list(discovery.INTENTS)}, h(n, w) as {_list(discovery.PLATFORM_HINTS)}, t(n, w) as {_list(discovery.GEO_TLDS)},
r(n, w) as {_list(discovery.REGIONS)},
q as (select v || ' ' || w || ' {NEG}' as query, [0, pos, n, 0] as seq from v, i
  union all select v || ' ' || w || ' {NEG}', [1, pos, n, 0] from v, h
  union all select w || ' ' || v || ' {NEG}', [2, pos, n, 0] from v, i where n < 5
  union all select v || ' ' || i.w || ' site:' || t.w || ' {NEG}', [3, pos, i.n, t.n] from v, i, t where i.n < 3
  union all select v || ' ' || i.w || ' ' || r.w || ' {NEG}', [4, pos, i.n, r.n] from v, i, r where i.n < 3)
select query from (select query, row_number() over (partition by lower(query) order by seq) as k from q) where k = 1
union all select 'red bolt' union all select 'gk gloves'""")
def u5(spark, d):
    variants = table(spark, d, "part").groupBy(F.lower("p_name").alias("variant")).agg(F.min("p_partkey").alias("pos"))
    return discovery.expand_queries(variants, ["red bolt", "gk gloves"], per_family_cap=None, max_queries=None)


@query("u5_expand_queries_capped", f"""with v as (select lower(p_name) as v, min(p_partkey) as pos from part group by 1),
i(n, w) as {_list(discovery.INTENTS)}, h(n, w) as {_list(discovery.PLATFORM_HINTS)}, t(n, w) as {_list(discovery.GEO_TLDS)},
r(n, w) as {_list(discovery.REGIONS)},
q as (select v || ' ' || w || ' {NEG}' as query, [0, pos, n, 0] as seq from v, i
  union all select v || ' ' || w || ' {NEG}', [1, pos, n, 0] from v, h
  union all select w || ' ' || v || ' {NEG}', [2, pos, n, 0] from v, i where n < 5
  union all select v || ' ' || i.w || ' site:' || t.w || ' {NEG}', [3, pos, i.n, t.n] from v, i, t where i.n < 3
  union all select v || ' ' || i.w || ' ' || r.w || ' {NEG}', [4, pos, i.n, r.n] from v, i, r where i.n < 3),
k as (select *, row_number() over (partition by seq[1] order by md5('42:' || query), query) as k from q),
u as (select query, row_number() over (partition by lower(query) order by seq) as k from k where k <= 50),
m as (select query from u where k = 1 order by md5('42:' || query), query limit 400)
select query from m union all select 'red bolt' where 'red bolt' not in (select lower(query) from m)""")
def u5_capped(spark, d):
    variants = table(spark, d, "part").groupBy(F.lower("p_name").alias("variant")).agg(F.min("p_partkey").alias("pos"))
    return discovery.expand_queries(variants, ["red bolt"], per_family_cap=50, max_queries=400)


@query("u6_contact_queries", f"""with {st.SITES}, c as (select site, upper({st.LABEL_SQL}) as n from sites)
select site as domain, unnest(['phone', 'whatsapp', 'linkedin', 'phone', 'phone', 'whatsapp', 'whatsapp', 'linkedin',
    'linkedin']) as kind, unnest(['"' || n || '" phone number contact', '"' || n || '" whatsapp',
    '"' || n || '" linkedin company', 'site:' || site || ' phone', 'site:' || site || ' tel', 'site:' || site || ' wa.me',
    '"' || n || '" whatsapp business', 'site:linkedin.com/company ' || n, 'site:linkedin.com/in ' || n]) as query from c
union all select site, unnest(['linkedin', 'linkedin', 'instagram', 'facebook', 'twitter', 'twitter']), 'site:'
  || unnest(['linkedin.com', 'linkedin.com', 'instagram.com', 'facebook.com', 'twitter.com', 'x.com'])
  || ' (intext:"' || n || '" OR intext:"the ' || n || '")' from c""")
def u6(spark, d):
    name = F.upper(st.label(F.col("site")))
    companies = st.sites(spark, d).select(F.col("site").alias("domain"), name.alias("company"),
                                          F.array(name, F.concat(F.lit("the "), name)).alias("variants"))
    return discovery.contact_queries(companies, "aggressive").withColumnRenamed("query_type", "kind").unionByName(
        discovery.platform_queries(companies).withColumnRenamed("platform", "kind"))


EDGES = r"""hp as (select page_id, host, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as url, html,
  regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root, row_number() over (partition by host order by page_id) as n from pg),
e as (select url as src, root || unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"'']+)["'']', 1)) as dst, host
    from hp
  union select a.url, b.url, a.host from hp a join hp b on a.host = b.host and b.n in (a.n + 1, a.n + 2)),
edges as (select distinct src, regexp_replace(regexp_replace(dst, '#.*$', ''), '/+$', '') as dst from e),
seeds as (select host, url from hp where n = 1)"""
WALK = """walk as (select host, url, 0 as depth from seeds union select w.host, d.dst, w.depth + 1 from walk w join edges d
  on d.src = w.url where w.depth < {0}),
best as (select host as domain, url, min(depth) as depth from walk group by 1, 2)"""


def crawl_inputs(spark, d):
    """Real links plus, per page, links to the next two pages of its host."""
    pages = st.pages(spark, d)
    canon = pages.select("host", "page_id", urls.canonical_url(F.col("url")).alias("url"))
    numbered = position(canon, ["host"], "page_id", "n")
    later = lambda k: numbered.select("host", F.col("url").alias("from_url"), (F.col("n") + k).alias("n")).join(
        numbered.select("host", "n", "url"), ["host", "n"]).select("from_url", "url", F.lit(1000 + k).alias("pos"))
    real = crawl.link_edges(pages, H.page_hrefs(F.col("html")))
    edges = real.unionByName(later(1)).unionByName(later(2)).groupBy("from_url", "url").agg(F.min("pos").alias("pos"))
    seeds = numbered.where("n = 1").select(F.col("host").alias("domain"), "url")
    return pages, seeds, edges


@query("u7_link_bfs", f"""with recursive {st.PG}, {EDGES}, {WALK.format(3)} select domain, url, depth from best""")
def u7(spark, d):
    _, seeds, edges = crawl_inputs(spark, d)
    return crawl.link_bfs(seeds, edges, max_depth=3).select("domain", "url", "depth")


@query("u8_crawl_all", f"""with recursive {st.PG}, {EDGES}, {WALK.format(2)},
landed as (select regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as url, sha256(html) as h from pg)
select b.domain, count(distinct b.url) as urls_visited, count(distinct h) as pages_crawled
from best b left join landed l on l.url = b.url where not starts_with(domain, 'm.') group by 1""")
def u8(spark, d):
    pages, seeds, edges = crawl_inputs(spark, d)
    states = seeds.select("domain", F.col("domain").startswith("m.").alias("is_complete"))
    landed = pages.select("url", F.sha2("html", 256).alias("content_hash"))
    return crawl.crawl_all(seeds, edges, landed, states, max_depth=2)["results"]


@query("x3_frontier_minus_visited", f"""with {st.PG}, {EDGES}, r as (select distinct regexp_replace(regexp_replace(root ||
  unnest(regexp_extract_all(html, '(?i)<a\\s+[^>]*href=["'']([^"'']+)["'']', 1)), '#.*$', ''), '/+$', '') as url from hp)
select url from r where url not in (select url from hp)""")
def x3(spark, d):
    pages = st.pages(spark, d)
    links = crawl.link_edges(pages, H.page_hrefs(F.col("html")))
    return setops.new_frontier(links, pages.select(urls.canonical_url(F.col("url")).alias("url")))


@query("u9_embed_batches")
def u9(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return retrieval.embed_batches(pages).select("doc_id", F.size("embedding").alias("dim"), F.round(
        F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 3).alias("total"))


@query("u10_model_extract")
def u10(spark, d):
    pages = doc_pages(spark, d)
    out = extraction.extract_profiles(pages, filters.profile_page(F.col("url"), F.col("depth")))
    mails = out["values"].where("field = 'email'").groupBy("domain").agg(F.count("*").alias("mails"))
    n = out["chunks"].groupBy("domain").agg(F.count("*").alias("chunks"))
    return out["profile"].join(n, "domain").join(mails, "domain", "left")


@query("u11_keyword_variants", rf"""with k as (select p_partkey as id, p_name as a, upper(p_type) || ' of ' || p_brand as b
  from part), c as (select lower(p_name || ' ' || upper(p_type) || ' of ' || p_brand) as key from part where p_size > 40),
t as (select id, a, b, lower(a || ' ' || b) in (select key from c) as cached, list_distinct(list_concat([lower(a), lower(b)],
  list_filter(list_concat(regexp_extract_all(lower(a), '[a-z0-9]+'), regexp_extract_all(lower(b), '[a-z0-9]+')),
    lambda x: length(x) > 2 and x not in ({STOP_SQL})))) as made from k)
select id, case when cached then 'cached' else array_to_string(list_sort(made), '|') end as variants, cached as from_cache
from t""")
def u11(spark, d):
    part = table(spark, d, "part")
    words = F.array(F.col("p_name"), F.concat(F.upper("p_type"), F.lit(" of "), F.col("p_brand")))
    keywords = part.select(F.col("p_partkey").alias("id"), words.alias("words"))
    cache = part.where("p_size > 40").select(F.lower(F.array_join(words, " ")).alias("keyword")).distinct().withColumn(
        "variants", F.array(F.lit("cached")))
    return discovery.keyword_variants(keywords, cache).select(
        "id", F.array_join(F.array_sort("variants"), "|").alias("variants"), "from_cache")


VARIANTS = ["The", "ble", "er the", "on"]
COUNTS = ", ".join(
    r"len(regexp_extract_all(p, '[^\p{L}\p{N}_]" + k.replace(" ", "  ") + r"[^\p{L}\p{N}_]')) as k" + str(i)
    for i, k in enumerate(v.lower() if v != "The" else "NEVER" for v in VARIANTS))
VET_SQL = rf"""{st.PG}, home as (select site as domain, {st.SHOP_HTML_SQL} as html from pg where page_id in
  (select min(page_id) from pg group by site)),
dm as (select domain from home union all select regexp_replace(domain, '\.[a-z]+$', '.zz') from home),
tx as (select dm.domain, html, {visible_sql('html', ['script', 'style', 'nav', 'footer'], [])} as t from dm
  left join home on home.domain = dm.domain),
pd as (select domain, html, ' ' || regexp_replace(lower(t), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ' as p from tx),
ct as (select *, {COUNTS} from pd),
sc as (select domain, html is null as missing, (k0 > 0)::int + (k1 > 0)::int + (k2 > 0)::int + (k3 > 0)::int as found,
  k0 + k1 + k2 + k3 as total, contains(domain, 'the')::int + contains(domain, 'ble')::int + contains(domain, 'er the')::int
  + contains(domain, 'on')::int as hits, list_filter(['product', 'cart', 'checkout', 'shop', 'store', 'buy', 'price',
  'add to cart'], lambda x: contains(lower(html), x)) as terms from ct),
s2 as (select *, case hits when 0 then 0.0::double when 1 then 0.3::double when 2 then 0.5::double else 0.7::double end as ns,
  round(least(found / 4.0::double, 1.0) * 0.6::double + least(total / 10.0::double, 1.0) * 0.4::double, 3) as content from sc),
s3 as (select *, case when missing then ns else greatest(content, ns) end as score from s2),
s4 as (select *, case when missing then score >= @MIN else len(terms) >= 1 and score >= @MIN end as ok from s3)"""
REASON_SQL = """case when missing and score >= {0} then 'Approved by domain name relevance (score: ' || format('{{:.2f}}', ns)
    || ') - fetch failed but domain name highly relevant'
  when missing then 'Could not fetch homepage (tried homepage, /products, /shop, /about) and domain name not relevant enough '
    || '(score: ' || format('{{:.2f}}', ns) || ')'
  when len(terms) < 1 then 'No e-commerce indicators found (need 1, found ' || len(terms) || ')'
  when score < {0} then 'Low keyword relevance (content: ' || format('{{:.2f}}', content) || ', domain: '
    || format('{{:.2f}}', ns) || ', combined: ' || format('{{:.2f}}', score) || ', need >= {0})'
  else 'Approved: Has e-commerce (' || len(terms) || ' keywords) and relevant content (score: ' || format('{{:.2f}}', score)
    || case when ns > content then ' (domain name boost)' else '' end || ')' end"""


def vet_inputs(spark, d):
    first = first_n_per_key(st.pages(spark, d), ["site"], ["page_id"])
    home = first.select(F.col("site").alias("domain"), st.shop_html(F.col("html"), F.col("url")).alias("html"))
    domains = home.select("domain").unionByName(home.select(F.regexp_replace("domain", r"\.[a-z]+$", ".zz").alias("domain")))
    return domains, home


@query("u15_vet_domains", f"""with {VET_SQL.replace('@MIN', '0.45')} select domain, case when ok then 'approved' else 'rejected' end
  as status, {REASON_SQL.format(0.45)} as reason, score as relevance_score, case when missing and ok then 'domain-name-match'
  else array_to_string(case when missing then [] else terms end, '|') end as terms from s4""")
def u15(spark, d):
    domains, home = vet_inputs(spark, d)
    out = vetting.vet_domains(domains, home, VARIANTS, min_score=0.45)
    return out.select("domain", "status", "reason", "relevance_score", F.array_join("ecommerce_terms", "|").alias("terms"))


@query("u16_rule_vet", rf"""with {st.PG}, home as (select site as domain, {st.SHOP_HTML_SQL} as html from pg where page_id in
  (select min(page_id) from pg group by site)),
dm as (select domain from home union all select regexp_replace(domain, '\.[a-z]+$', '.zz') from home)
select dm.domain, case when length(dm.domain) = 10 then 'yes' when html is null then 'no'
  when regexp_matches(lower(html), 'cdn\.shopify\.com|woocommerce|/wp-json/wc/|bigcommerce|"@type":"product"') then 'yes'
  when not regexp_matches(lower(html), 'product|cart|checkout|shop|store') then 'no' else 'unclear' end as verdict
from dm left join home on home.domain = dm.domain""")
def u16(spark, d):
    domains, home = vet_inputs(spark, d)
    cache = domains.select("domain", (F.length("domain") == 10).alias("has_cart"), F.lit(False).alias("has_product_schema"),
                           F.lit(False).alias("has_platform_fp"))
    return vetting.rule_vet(domains, cache, home)


@query("u18_enrich_profile")
def u18(spark, d):
    docs = table(spark, d, "documents")
    source = F.col("source")
    # a profile per document: its text is the description
    profiles = docs.select(
        F.concat(source, F.lit("-"), "doc_id").alias("domain"), F.col("text").alias("description"),
        F.array(F.concat(F.lit("whatsapp +49 30 5550 "), "doc_id"), F.col("lang")).alias("notes"),
        F.create_map(F.lit("linkedin"), F.when(F.col("lang") == "en", F.concat(F.lit("https://linkedin.com/company/"), source))
                     .otherwise(F.lit(" ")), F.lit("twitter"), F.concat(F.lit("https://x.com/"), source)).alias("social"),
        F.create_map(F.lit("a@x.com"), F.struct((F.col("n_chars") > 500).alias("is_valid"))).alias("verification"))
    return enrichment.enrich_profile(profiles)["summary"]


@query("u19_site_contacts")
def u19(spark, d):
    pages = st.rich_pages(spark, d).select(
        F.col("site").alias("domain"), "page_id", "url",
        F.when(F.col("url").contains(".html"), "contact").when(F.col("url").endswith("#top"), "about").otherwise("homepage")
        .alias("page_type"), F.concat("html", F.lit("<p>call +1 (555) 555-0"), F.col("page_id") + 100, F.lit("</p>"))
        .alias("html"))
    return enrichment.site_contacts(pages)


PHONE_SCORE_SQL = """case when regexp_matches(lower(context), 'phone|tel|call|contact') then 0.9::double
    when regexp_matches(lower(context), 'fax|mobile|office') then 0.8 else 0.5 end"""


@query("u20_profile_scrape_contacts", f"""with {st.RICH}, pp as (select page_id as key, site as domain, case when contains(url, '.html')
  then 'instagram' when ends_with(url, '#top') then 'x' else 'youtube' end as platform, html || '<p>tel: 555-555-0' || (page_id + 100)
  || ' wa.me/4912345' || page_id || '</p>' as html from rich), kn as (select * from pp where platform in ('instagram', 'x')),
t as (select key, 'text' as part, {visible_sql('html', ['script', 'style'], ['meta', 'link'])} as text from kn
  union all select key, 'html', html from kn), tx as (select * from t where part = 'text'),
{spans_sql('tel', 'tx', PHONE_PATTERNS, 100)}, {whatsapp_sql('t')},
found as (select key, 'phone' as type, value, {PHONE_SCORE_SQL} as confidence, context from tel
  where length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 qualify row_number() over (partition by key, value order by p, i) = 1
  union all select key, 'whatsapp', value, confidence, context from wa)
select domain, platform, type, value, confidence, context, 'social_' || platform as source from found join kn using (key)""")
def u20(spark, d):
    pages = st.rich_pages(spark, d).select(
        F.col("site").alias("domain"), F.when(F.col("url").contains(".html"), "instagram").when(
            F.col("url").endswith("#top"), "x").otherwise("youtube").alias("platform"),
        F.concat("html", F.lit("<p>tel: 555-555-0"), F.col("page_id") + 100, F.lit(" wa.me/4912345"), "page_id", F.lit("</p>"))
        .alias("html"))
    return enrichment.profile_page_contacts(pages)


SAVE_SQL = f"""{VET_SQL.replace('@MIN', '0.45')},
rs as (select site as domain, min(page_id) as seq from pg group by site),
co as (select seq as id, case when length(domain) < 11 then domain else regexp_replace(domain, '\\.[a-z]+$', '.co.uk') end as domain
  from rs where length(domain) < 13),
ck as (select id, domain, string_split({TRIM_SQL.format('domain')}, '.') as l from co), cn as (select id, domain,
  {NAME_KEY_SQL} as k from ck), cf as (select k, arg_min(domain, id) as primary_domain from cn group by k),
ap as (select rs.domain, rs.seq, s4.score, string_split({TRIM_SQL.format('rs.domain')}, '.') as l from rs join s4
  on s4.domain = rs.domain where ok and rs.domain not in (select domain from co)),
ak as (select domain, seq, score, {NAME_KEY_SQL} as k from ap)"""


def save_inputs(spark, d):
    _, home = vet_inputs(spark, d)
    vetted = vetting.vet_domains(home.select("domain"), home, VARIANTS, min_score=0.45)
    results = st.sites(spark, d).select(F.col("site").alias("domain"), "seq", F.upper("site").alias("title"),
                                        F.lit("snip").alias("snippet"), F.lit("bing").alias("source"))
    companies = results.where("length(domain) < 13").select(
        F.col("seq").alias("id"), F.lit("me").alias("owner"), F.when(F.length("domain") < 11, F.col("domain")).otherwise(
            F.regexp_replace("domain", r"\.[a-z]+$", ".co.uk")).alias("domain"))
    return results, vetted, companies


@query("u21_save_discovery", f"""with {SAVE_SQL}
select 'company' as kind, domain, upper(domain) as other, score from ak where k not in (select k from cf)
union all select 'alias', domain, primary_domain, 0.9 from ak join cf on cf.k = ak.k
union all select 'total', '', '', count(*) from rs
union all select 'approved', '', '', count(*) from s4 where ok and domain in (select domain from rs)
union all select 'saved', '', '', count(*) from ak where k not in (select k from cf)
union all select 'discovered', '', '', count(*) from rs""")
def u21(spark, d):
    results, vetted, companies = save_inputs(spark, d)
    found = results.where("length(domain) < 11").select("domain", F.lit("google").alias("engine"))
    out = discovery.save_discovery(results, vetted, found, companies, "me")
    empty = F.lit("")
    count = lambda kind, df, col: df.select(F.lit(kind).alias("kind"), empty.alias("domain"), empty.alias("other"),
                                            F.col(col).cast("double").alias("score"))
    rows = out["companies"].select(F.lit("company").alias("kind"), "domain", F.col("company_name").alias("other"),
                                   F.col("vetting_score").alias("score"))
    rows = rows.unionByName(out["aliases"].select(F.lit("alias").alias("kind"), F.col("alias_domain").alias("domain"),
                                                  F.col("primary_domain").alias("other"), F.col("confidence").alias("score")))
    for kind in ("total", "approved", "saved"):
        rows = rows.unionByName(count(kind, out["counts"], kind))
    return rows.unionByName(count("discovered", out["discovered"].agg(F.count("*").alias("n")), "n"))


@query("u22_revet", f"""with {VET_SQL.replace('@MIN', '0.3')}, co as (select domain from home where length(domain) < 11)
select domain, 'company' as kind from co union all select domain, 'new' from s4 where ok and domain not in
  (select domain from co)""")
def u22(spark, d):
    domains, home = vet_inputs(spark, d)
    companies = home.where("length(domain) < 11").select("domain", F.lit("old").alias("owner"))
    out = vetting.revet(domains, home, VARIANTS, companies, "new", 1, 0.3)
    return out["companies"].select("domain", F.when(F.col("owner") == "old", "company").otherwise("new").alias("kind"))


@query("u23_embed_domain")
def u23(spark, d):
    pages = chunks.page_chunks(doc_pages(spark, d), min_tokens=20)
    products = st.products(spark, d).select(
        "domain", "seq", F.lit("").alias("external_id"), "name", "brand", "category", F.lit("").alias("description"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("specs"), "price",
        F.array().cast("array<string>").alias("reviews"), F.lit("").alias("url"))
    shared = ["chunk_id", "domain", "collection_name", "content", "content_hash", "tokens"]
    stored = retrieval.embed_batches(chunks.product_chunks(products).where(F.col("domain") == "promo.com").select(*shared))
    return retrieval.embed_domain([pages, chunks.product_chunks(products)], stored)["stats"]
