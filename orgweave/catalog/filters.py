"""P1-P22 (but P8 and P9): filters, lookups and projections."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.functions import urls
from orgweave.operators import filters as ops


@query("p1_filter_companies", f"""with {st.COMPANIES} select id, domain from companies
where relevance_status is distinct from 'irrelevant' and embedded_at is not null and crawl_status = 'completed'""")
def p1(spark, d):
    return ops.filter_companies(st.companies(spark, d), exclude_irrelevant=True, only_embedded=True,
                                crawled_only=True).select("id", "domain")


@query("p2_search_companies_regex", """select s_suppkey, s_name from supplier
where regexp_matches(s_name, '(?i)supplier#0+[1-5]') or regexp_matches(s_nationkey::varchar, '(?i)supplier#0+[1-5]')""")
def p2(spark, d):
    df = table(spark, d, "supplier").withColumn("nation", F.col("s_nationkey").cast("string"))
    return ops.search_regex(df, "supplier#0+[1-5]", ["s_name", "nation"]).select("s_suppkey", "s_name")


@query("p3_search_companies_like", """select c_custkey, c_name from customer where c_name ilike '%r#0000001%'
  or c_mktsegment ilike '%r#0000001%' or c_mktsegment ilike '%R#0000001%'""")
def p3(spark, d):
    return ops.search_like(table(spark, d, "customer"), "R#0000001", ["c_name", "c_mktsegment"]).select(
        "c_custkey", "c_name")


@query("p4_search_products", f"""with {st.PRODUCTS} select seq, name from products where domain = 'promo.com'
  and (regexp_matches(name, '(?i)^RED|#1$') or regexp_matches(brand, '(?i)^RED|#1$')
  or regexp_matches(category, '(?i)^RED|#1$'))""")
def p4(spark, d):
    df = st.products(spark, d).where("domain = 'promo.com'")
    return ops.search_regex(df, "^RED|#1$", ["name", "brand", "category"]).select("seq", "name")


@query("p5_domain_prefix_match", rf"""with {st.SITES} select site, regexp_matches(site, '(?i)^(?:blog\.tionsh)(\.|$)')
  as blog, regexp_matches(site, '(?i)^(?:thth)(\.|$)') as partial, regexp_matches(site, '(?i)^(?:thther)(\.|$)') as name
from sites""")
def p5(spark, d):
    site = F.col("site")
    return st.sites(spark, d).select("site", urls.prefix_match(site, "BLOG.tionsh").alias("blog"),
                                     urls.prefix_match(site, "thth").alias("partial"),
                                     urls.prefix_match(site, "thther").alias("name"))


@query("p6_filter_jobs", f"""with {st.JOBS} select id, user_id, job_type, status from jobs
where job_type = '2-HIGH' and status = 'running'""")
def p6(spark, d):
    return ops.filter_jobs(st.jobs(spark, d), job_type="2-HIGH", status="running").select(
        "id", "user_id", "job_type", "status")


@query("p7_filter_sends", f"""with {st.SENDS} select message_id, domain, campaign_id from sends
where campaign_id = 'c7' and sent_at >= timestamp '2024-01-10 00:00:00'""")
def p7(spark, d):
    since = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return ops.filter_sends(st.sends(spark, d), campaign="c7", since=since).select("message_id", "domain", "campaign_id")


BLACK_SQL = "|".join(w.replace(".", "\\.") for w in urls.URL_BLACKLIST)


@query("p10_url_blacklist", f"""with u as (select page_id, case when url like '%.html' then replace(url, '://',
  '://www.daraz.') when url like '%#top' then substr(url, 3) else url end as link from pages)
select page_id, link from u where starts_with(link, 'http') and not regexp_matches(link, '{BLACK_SQL}')""")
def p10(spark, d):
    url = F.col("url")
    link = (F.when(url.endswith(".html"), F.replace(url, F.lit("://"), F.lit("://www.daraz.")))
            .when(url.endswith("#top"), F.expr("substring(url, 3)")).otherwise(url))
    return table(spark, d, "pages").select("page_id", link.alias("link")).where(urls.allowed_url(F.col("link")))


@query("p11_skip_extensions", r"""with u as (select page_id, case when url like '%.html' then replace(url, '.html',
  '.PNG?v=1') when url like '%?page%' then replace(url, '?page', '.tar.gz?page') else url end as link from pages)
select page_id, link from u where not regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)),
  '[^/.][^/]*\.(jpg|jpeg|png|gif|bmp|webp|tiff|svg|ico|zip|rar|7z|tar|gz|pdf)$')""")
def p11(spark, d):
    url = F.col("url")
    link = (F.when(url.endswith(".html"), F.replace(url, F.lit(".html"), F.lit(".PNG?v=1")))
            .when(url.contains("?page"), F.replace(url, F.lit("?page"), F.lit(".tar.gz?page"))).otherwise(url))
    return table(spark, d, "pages").select("page_id", link.alias("link")).where(urls.has_page_extension(F.col("link")))


@query("p12_robots_filter", f"""with {st.PG}, p as (select *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path
  from pg)
select page_id, url from p where not (starts_with(path, '/fr/') and not starts_with(path, '/fr/1'))
  and not starts_with(path, '/en/7')""")
def p12(spark, d):
    pages = st.pages(spark, d)
    rules = pages.select("host").distinct().select("host", F.inline(F.array(*[
        F.struct(F.lit(agent).alias("agent"), F.lit(rule).alias("rule"), F.lit(prefix).alias("prefix"))
        for agent, rule, prefix in (("*", "disallow", "/fr/"), ("*", "allow", "/fr/1"), ("bot", "disallow", "/"),
                                    ("*", "disallow", "/en/7"), ("*", "disallow", ""))])))
    return ops.robots_filter(pages, rules).select("page_id", "url")


@query("p13_owned_rows", """select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem where l_orderkey in
  (select o_orderkey from orders where o_custkey = 77)""")
def p13(spark, d):
    return ops.owned_rows(table(spark, d, "lineitem"), st.companies(spark, d), "l_orderkey", 77).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("p14_recent_crawls", f"""with {st.COMPANIES} select id, domain from companies where crawl_status = 'completed'
  and embedded_at is not null order by embedded_at desc, id limit 100""")
def p14(spark, d):
    return ops.recent_crawls(st.companies(spark, d), 500, when="embedded_at").select("id", "domain")


@query("p15_page_category", r"""with u as (select page_id, case when url like '%.html' then replace(url, '.html',
  '/About') when url like '%#top' then replace(url, '#top', '/Collections') else url end as link from pages)
select page_id, regexp_matches(lower(link), '/about|/contact|/team|/company|/who-we-are') as profile,
  regexp_matches(lower(link), '/product|/shop|/collection|/catalog|/store|/glove') as product from u""")
def p15(spark, d):
    url = F.col("url")
    link = (F.when(url.endswith(".html"), F.replace(url, F.lit(".html"), F.lit("/About")))
            .when(url.endswith("#top"), F.replace(url, F.lit("#top"), F.lit("/Collections"))).otherwise(url))
    return table(spark, d, "pages").select("page_id", ops.profile_page(link).alias("profile"),
                                           ops.product_page(link).alias("product"))


@query("p16_contact_page_plan", f"""with {st.SITES}, plan(position, path, page_type) as (values (0, '', 'homepage'),
  (1, '/contact', 'contact'), (2, '/kontakt', 'contact'), (3, '/contacto', 'contact'),
  (4, '/about', 'about'), (5, '/about-us', 'about'), (6, '/social', 'social'))
select site as domain, position, 'https://' || site || path as url, page_type from sites, plan""")
def p16(spark, d):
    return ops.contact_page_plan(st.sites(spark, d).select(F.col("site").alias("domain")), "aggressive")


@query("p17_serp_for_platform", f"""with {st.SITES}, l as (select site, seq, {st.LABEL_SQL} as label from sites),
r as (select site, seq, label, case when length(site) > 11 then 'https://www.Instagram.com/' || label
  else 'https://x.com/' || label end as url from l)
select site, url from r where contains(lower(url), 'instagram.com') and
  (contains(lower(url), label) or contains(lower(url), 'never'))""")
def p17(spark, d):
    label = st.label(F.col("site"))
    r = st.sites(spark, d).select(
        "site", F.when(F.length("site") > 11, F.concat(F.lit("https://www.Instagram.com/"), label)).otherwise(
            F.concat(F.lit("https://x.com/"), label)).alias("url"), F.lit("t").alias("title"), F.lit("s").alias("snippet"),
        F.array(F.upper(label), F.lit("never")).alias("variants"))
    return ops.serp_for_platform(r, "instagram.com").select("site", "url")


@query("p18_tool_projection", """select doc_id as seq, source as domain, lang as name, 'p' || n_chars as price,
  source as category, case when text = '' then '' else substr(text, 1, 200) || '...' end as description from documents""")
def p18(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("domain"), F.col("lang").alias("name"),
        F.concat(F.lit("p"), F.col("n_chars")).alias("price"), F.col("source").alias("category"),
        F.col("text").alias("description"))
    return ops.product_cards(docs)


@query("p19_point_lookup", """select c_custkey, c_name from customer where c_custkey = 42 or c_custkey in
  (select o_custkey from orders where o_totalprice > 490000)""")
def p19(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    keys = table(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return ops.point_lookup(customers, "c_custkey", 42).unionByName(ops.lookup_many(customers, keys, "c_custkey")).distinct()


@query("p20_children_of", """select l_orderkey, l_linenumber, l_shipdate::date::varchar as shipped, l_extendedprice
from lineitem where l_suppkey = 7 order by l_extendedprice desc, l_orderkey, l_linenumber limit 25 offset 10""")
def p20(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
                                            F.col("l_shipdate").cast("date").cast("string").alias("shipped"))
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]
    return ops.children_of(li, "l_suppkey", 7, order, skip=10, limit=25).drop("l_suppkey")


@query("p21_state_sets", """select distinct 'd' || user_id as domain, unnest([event_type, 'k' || (value > 50)::int])
  as member from events""")
def p21(spark, d):
    states = table(spark, d, "events").select(
        F.concat(F.lit("d"), F.col("user_id")).alias("domain"),
        F.array("event_type", F.concat(F.lit("k"), (F.col("value") > 50).cast("int"))).alias("visited_urls"))
    return ops.state_sets(states, "visited_urls")


@query("p22_active_crawls", f"with {st.COMPANIES} select id, domain from companies where crawl_status = 'crawling'")
def p22(spark, d):
    return ops.active_crawls(st.companies(spark, d)).select("id", "domain")
