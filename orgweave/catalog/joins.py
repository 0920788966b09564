"""Joins."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.catalog.scalars_contact import CONTACT_ARRAY_SQL, order_contacts
from orgweave.catalog.scalars_url import NAME_KEY_SQL, TRIM_SQL
from orgweave.operators import joins as ops

STATES = """states as (select 'site' || l_orderkey || '.com' as domain, bool_and(l_linestatus = 'F') as is_complete,
  (count(*) filter (where l_returnflag <> 'N'))::bigint as pages, count(distinct l_partkey) as n_visited,
  min(l_shipdate) as started_at, case when bool_and(l_linestatus = 'F') then max(l_shipdate) end as completed_at
  from lineitem group by l_orderkey)"""


def states(spark, d):
    done = F.bool_and(F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        done.alias("is_complete"), F.count_if(F.col("l_returnflag") != "N").alias("pages_crawled"),
        F.countDistinct("l_partkey").alias("n_visited"), F.min("l_shipdate").alias("started_at"),
        F.when(done, F.max("l_shipdate")).alias("completed_at")).withColumn(
        "domain", F.concat(F.lit("site"), F.col("l_orderkey"), F.lit(".com"))).drop("l_orderkey")


@query("j1_crawl_status_batch", f"""with {st.COMPANIES}, {STATES}
select c.domain, coalesce(is_complete, false) as fully_crawled, coalesce(pages, 0) as pages,
  coalesce(n_visited, 0) as visited_urls, not coalesce(is_complete, false) and coalesce(pages, 0) > 0 as in_progress,
  epoch_us(started_at) as started_us, epoch_us(completed_at) as completed_us
from companies c left join states s on c.domain = s.domain""")
def j1(spark, d):
    return ops.crawl_status_batch(st.companies(spark, d).select("domain"), states(spark, d)).select(
        "domain", "fully_crawled", "pages", "visited_urls", "in_progress", F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("completed_at").alias("completed_us"))


@query("j2_company_list_status", f"""with {st.COMPANIES}, {STATES}
select c.domain, case when is_complete then 'completed' when coalesce(pages, 0) > 0 then 'crawling'
  else 'not_crawled' end as crawl_status, coalesce(pages, 0) as pages
from companies c left join states s on c.domain = s.domain""")
def j2(spark, d):
    return ops.company_list_status(st.companies(spark, d).select("domain"), states(spark, d)).select(
        "domain", "crawl_status", "pages")


@query("j3_company_detail_status", f"""with {st.COMPANIES}, {STATES}
select c.domain, case when is_complete then 'completed' when pages > 0 then 'crawling' else 'not_crawled' end
  as crawl_status, epoch_us(coalesce(completed_at, started_at)) as crawled_us
from companies c left join states s on c.domain = s.domain""")
def j3(spark, d):
    return ops.company_detail_status(st.companies(spark, d).select("domain"), states(spark, d)).select(
        "domain", "crawl_status", F.unix_micros("crawled_at").alias("crawled_us"))


@query("j4_company_bundle", f"""with {st.PRODUCTS}, n as (select *, (row_number() over (partition by domain order by seq) - 1)
  // 100 as page from products),
g as (select domain, page::int as page, string_agg(brand || '/' || name, '|' order by seq) as items from n group by 1, 2),
t as (select domain, count(*) as products_extracted from products group by 1),
c as (select distinct domain from products union all select 'empty.com')
select c.domain, coalesce(page, 0) as page, coalesce(items, '') as products, coalesce(products_extracted, 0)
  as products_extracted, 'facebook=u2|x=u3' as socials
from c left join g on c.domain = g.domain left join t on c.domain = t.domain""")
def j4(spark, d):
    products = st.products(spark, d)
    link = lambda p, u: F.struct(F.lit(p).alias("platform"), F.lit(u).alias("url"))
    companies = products.select("domain").distinct().unionByName(
        products.select(F.lit("empty.com").alias("domain")).distinct()).withColumn(
        "social", ops.social_map(F.array(link("facebook", "u1"), link("x", "u3"), link("facebook", "u2"))))
    out = ops.company_bundle(companies, products, ["brand", "name"], page_size=100)
    items = F.transform("products", lambda p: F.concat_ws("/", p["brand"], p["name"]))
    socials = F.array_sort(F.transform(F.map_entries("social"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return out.select("domain", "page", F.coalesce(F.array_join(items, "|"), F.lit("")).alias("products"),
                      "products_extracted", F.array_join(socials, "|").alias("socials"))


@query("j5_contacts_of_owner", """select l_orderkey as company_id, l_linenumber, l_returnflag from lineitem join orders
  on l_orderkey = o_orderkey where o_custkey = 77""")
def j5(spark, d):
    contacts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("company_id"), "l_linenumber", "l_returnflag")
    return ops.contacts_of_owner(contacts, st.companies(spark, d), 77)


@query("j6_vetting_lookup", """select o_orderkey as id, o_orderkey as domain, s from orders join (select l_orderkey,
  max(l_discount) as s from lineitem group by 1) v on l_orderkey = o_orderkey""")
def j6(spark, d):
    vetting = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("domain")).agg(F.max("l_discount").alias("s"))
    return ops.vetting_lookup(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"),
                                                              F.col("o_orderkey").alias("domain")), vetting)


@query("j7_anti_completed_queries", """with q as (select distinct p_name as query from part),
c as (select distinct p_name as query, case when p_size > 25 then 'google' else 'bing' end as engine from part
  where p_retailprice > 990)
select q.query, e.engine from q, (values ('google'), ('bing'), ('ddg')) e(engine)
where (q.query, e.engine) not in (select (query, engine) from c)""")
def j7(spark, d):
    part = table(spark, d, "part")
    cache = part.select(F.col("p_name").alias("query"), F.when(F.col("p_size") > 25, "google").otherwise("bing")
                        .alias("engine"), F.when(F.col("p_retailprice") > 990, F.lit(st.NOW)).alias("completed_at"))
    return ops.pending_queries(part.select(F.col("p_name").alias("query")).distinct(), ["google", "bing", "ddg"], cache)


@query("j8_anti_crawled_domains", f"""with {st.COMPANIES}, {STATES} select domain from companies where domain not in
  (select domain from states where is_complete)""")
def j8(spark, d):
    return ops.not_crawled(st.companies(spark, d).select("domain"), states(spark, d))


@query("j9_anti_embedded_by_hash", """with c as (select doc_id, source as domain, sha256(text) as content_hash from documents)
select doc_id, domain, content_hash from c where (domain, content_hash) not in
  (select (source, sha256(text)) from documents where lang = 'en')""")
def j9(spark, d):
    docs = table(spark, d, "documents")
    chunk = lambda df: df.select("doc_id", F.col("source").alias("domain"), F.lit("raw_pages").alias("collection_name"),
                                 F.sha2("text", 256).alias("content_hash"))
    return ops.not_embedded_by_hash(chunk(docs), chunk(docs.where("lang = 'en'"))).drop("collection_name")


@query("j10_anti_embedded_by_id", """select source as domain, count(*) filter (where lang <> 'en' or n_chars < 300) as new,
  count(*) filter (where lang = 'en' and n_chars >= 300) as skipped, min(doc_id) filter (where lang <> 'en' or
  n_chars < 300) as first_new from documents group by 1""")
def j10(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("domain"), F.col("doc_id").alias("chunk_id"), "lang",
                                               "n_chars")
    stored = docs.where("lang = 'en' and n_chars >= 300")
    fresh = ops.not_embedded_by_id(docs, stored).groupBy("domain").agg(F.min("chunk_id").alias("first_new"))
    return ops.embed_counts(docs, stored).join(fresh, "domain", "left")


@query("j12_alias_join", f"""with {st.SITES}, c as (select seq as id, site as domain,
  string_split({TRIM_SQL.format('site')}, '.') as l from sites where length(site) < 13),
ck as (select id, domain, {NAME_KEY_SQL} as k from c), f as (select k, arg_min(domain, id) as primary_domain from ck
  group by k),
n as (select 'shop.' || regexp_replace(site, '\\.[a-z]+$', '.co.uk') as domain, string_split(
  {TRIM_SQL.format("'shop.' || regexp_replace(site, '\\.[a-z]+$', '.co.uk')")}, '.') as l from sites),
nk as (select domain, {NAME_KEY_SQL} as k from n)
select 1 as owner, primary_domain, domain as alias_domain, 0.9::double as confidence,
  'discovery_deduplication' as source from nk join f on nk.k = f.k""")
def j12(spark, d):
    sites = st.sites(spark, d)
    companies = sites.where("length(site) < 13").select(F.lit(1).alias("owner"), F.col("seq").alias("id"),
                                               F.col("site").alias("domain"))
    new = sites.select(F.lit(1).alias("owner"), F.concat(F.lit("shop."), F.regexp_replace("site", r"\.[a-z]+$", ".co.uk"))
                       .alias("domain"))
    return ops.alias_join(new, companies)


@query("j14_ttl_asof_lookup", """with c as (select user_id, ts, event_id, value from events where event_type = 'click'),
r as (select event_id as request_id, user_id, ts from events where event_type = 'view'),
m as (select r.*, (select max(c.ts) from c where c.user_id = r.user_id and c.ts <= r.ts) as cached from r)
select request_id, user_id, epoch_us(ts) as at_us, case when cached >= ts - interval 168 hour then epoch_us(cached) end
  as cached_us, case when cached >= ts - interval 168 hour then (select max(c.value) from c where c.user_id = m.user_id
  and c.ts = cached) end as value from m""")
def j14(spark, d):
    ev = table(spark, d, "events")
    cache = ev.where("event_type = 'click'").select("user_id", F.col("ts").alias("verified_at"), "value")
    asks = ev.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("at"))
    return ops.ttl_lookup(asks, cache, "user_id", "at", "verified_at", ["value"]).select(
        "request_id", "user_id", F.unix_micros("at").alias("at_us"), F.unix_micros("cached_at").alias("cached_us"), "value")


@query("j15_query_history_counts", """with q as (select o_orderkey as query_id, o_orderdate from orders
  order by o_orderdate desc, o_orderkey limit 50)
select query_id, epoch_us(o_orderdate) as executed_us, count(l_orderkey) as domain_count from q left join lineitem
  on l_orderkey = query_id group by 1, 2""")
def j15(spark, d):
    queries = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").alias("executed_at"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"))
    return ops.history_with_counts(queries, found, 50).select("query_id", F.unix_micros("executed_at").alias("executed_us"),
                                                          "domain_count")


@query("j17_backlink_verify", f"""with {st.RICH}, c as (select page_id, site, string_split(site, '.')[1] as stem from rich)
select page_id, 'own' as kind, true as verified from c
union all select page_id, 'moved', length(stem) >= 5 from c union all select page_id, 'stranger', false from c""")
def j17(spark, d):
    rich = st.rich_pages(spark, d)
    stem = F.get(F.split("site", r"\."), F.lit(0))
    own = rich.select("page_id", F.lit("own").alias("kind"), F.col("site").alias("domain"), "html")
    # the page only knows the stem under another suffix, behind a redirect
    moved = rich.select("page_id", F.lit("moved").alias("kind"), F.concat(stem, F.lit(".zz")).alias("domain"), F.concat(
        F.lit('<a href="https://l.instagram.com/?u=https%3A%2F%2F'), stem, F.lit('.io%2Fx">x</a>')).alias("html"))
    stranger = rich.select("page_id", F.lit("stranger").alias("kind"), F.lit("unseen-name-7.dev").alias("domain"), "html")
    return ops.verify_backlinks(own.unionByName(moved).unionByName(stranger)).select("page_id", "kind", "verified")


@query("j18_team_fanout", """select e.event_id, m.user_id as recipient from events e
  join (select distinct user_id from events) m on m.user_id // 3 = e.user_id // 3""")
def j18(spark, d):
    ev = table(spark, d, "events")
    team = F.call_function("div", F.col("user_id"), F.lit(3)).alias("team_id")  # users work in threes
    members = ev.select("user_id", team).distinct()
    messages = ev.select("event_id", team)
    return ops.team_fanout(messages, members).drop("team_id")


@query("j19_social_fill_missing", """with x as (select user_id as domain, event_type as platform, max(case when value > 80
  then '' else 'https://e' end) as url from events where event_type <> 'view' group by 1, 2),
f as (select user_id as domain, event_type as platform, arg_min('https://f' || event_id, event_id) as url from events
  where value > 40 group by 1, 2)
select coalesce(x.domain, f.domain) as domain, coalesce(x.platform, f.platform) as platform,
  coalesce(nullif(x.url, ''), f.url) as url from x full join f on x.domain = f.domain and x.platform = f.platform
where coalesce(nullif(x.url, ''), f.url) is not null""")
def j19(spark, d):
    ev = table(spark, d, "events").withColumnsRenamed({"user_id": "domain", "event_type": "platform", "event_id": "seq"})
    existing = ev.where("platform <> 'view'").groupBy("domain", "platform").agg(
        F.max(F.when(F.col("value") > 80, "").otherwise("https://e")).alias("url"))
    found = ev.select("domain", "platform", "seq", F.concat(F.lit("https://f"), F.col("seq")).alias("url"),
                      (F.col("value") > 40).alias("verified"))
    return ops.social_fill_missing(existing, found)


@query("j20_seed_drafts", f"""with {CONTACT_ARRAY_SQL}
select oc.o_orderkey as company_id, 'site' || oc.o_orderkey as domain, 'camp' as campaign_id, 'uninitiated' as status,
  '' as subject, '' as body, list_filter(contacts, lambda c: c.type = 'email')[1].value as to_email
from oc join orders o on o.o_orderkey = oc.o_orderkey where o_custkey = 77 and o_totalprice > 100000""")
def j20(spark, d):
    orders = table(spark, d, "orders")
    companies = orders.join(order_contacts(spark, d), "o_orderkey").select(
        F.col("o_orderkey").alias("company_id"), F.col("o_custkey").alias("owner"),
        F.concat(F.lit("site"), F.col("o_orderkey")).alias("domain"), "contacts")
    chosen = orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("company_id"))
    return ops.seed_drafts(chosen, companies, 77, "camp")
