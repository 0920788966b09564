"""Windows, folds and merges; L1, L3, L5: sorted pages; X1-X2."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.catalog.reports import HEALTH_SQL
from orgweave.catalog.scalars_url import NAME_KEY_SQL, TRIM_SQL
from orgweave.operators import filters, folds, ordering, setops
from orgweave.operators.profiles import merge_profiles


@query("w1_first_per_brand", f"""with {st.PG}, k as (select page_id as seq, site as domain, url,
  string_split({TRIM_SQL.format('site')}, '.') as l from pg)
select seq, domain, url from (select *, row_number() over (partition by {NAME_KEY_SQL} order by seq) as rn from k)
where rn = 1""")
def w1(spark, d):
    results = st.pages(spark, d).select(F.col("page_id").alias("seq"), F.col("site").alias("domain"), "url")
    return folds.first_per_brand(results)


@query("w2_dedup_page_content", """select doc_id, source, content_hash, n_chars from (select doc_id, source, n_chars,
  sha256(text) as content_hash, row_number() over (partition by source, sha256(text) order by doc_id) as rn from documents)
where rn = 1""")
def w2(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.col("source").alias("domain"), "text", "n_chars")
    return folds.dedup_page_content(pages, "text", "doc_id").select(
        "doc_id", F.col("domain").alias("source"), "content_hash", "n_chars")


@query("w3_dedup_queries", r"""with q as (select p_partkey as seq, trim(regexp_replace(case when p_size > 25 then ' '
  || upper(p_name) || '  x' else replace(p_name, ' ', chr(9) || ' ') || ' x ' end, '[ \t\r\n\x0B\f]+', ' ', 'g')) as query
  from part)
select seq, query from (select *, row_number() over (partition by lower(query) order by seq) as rn from q) where rn = 1""")
def w3(spark, d):
    name = F.col("p_name")
    raw = F.when(F.col("p_size") > 25, F.concat(F.lit(" "), F.upper(name), F.lit("  x"))).otherwise(
        F.concat(F.replace(name, F.lit(" "), F.lit("\t ")), F.lit(" x ")))
    return folds.dedup_queries(table(spark, d, "part").select(F.col("p_partkey").alias("seq"), raw.alias("query")))


@query("w4_char_budget_prefix", """select doc_id, source, running_chars::bigint as running_chars from (select doc_id, source,
  sum(length(text)) over (partition by source order by doc_id) as running_chars from documents)
where running_chars <= 20000""")
def w4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return folds.char_budget_prefix(docs, F.col("n"), "doc_id", 20_000, key="source").drop("n")


@query("w5_latest_per_company", """select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey
  order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1""")
def w5(spark, d):
    return folds.latest_per_company(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
                                    "o_orderdate", "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@query("w7_top_profiles", """select event_id as seq, user_id as domain, confidence from (select *, value / 100 as confidence,
  row_number() over (partition by user_id order by value / 100 desc, event_id) as rn from events where value / 100 >= 0.6)
where rn <= 3""")
def w7(spark, d):
    return folds.top_profiles(table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("domain"), (F.col("value") / 100).alias("confidence")))


@query("w8_merge_products", f"""with {st.PRODUCTS}, p as (select seq, domain, case when p_size = 7 then null else name end
  as name, case when p_size < 20 then null when p_size < 40 then brand end as price, case when p_size > 10 then
  'u' || p_size end as url from products),
k as (select *, lower(name) as n, case when price is not null then lower(price) when url is not null then url else
  'no_price' end as s from p where name is not null),
f as (select * from (select *, row_number() over (partition by domain, n, s order by seq) as rn from k) where rn = 1)
select seq, domain, name, price, url, domain || '_product_' || row_number() over (partition by domain order by seq)
  as product_id from f""")
def w8(spark, d):
    size = F.col("p_size")
    p = st.products(spark, d).select(
        "seq", "domain", F.when(size != 7, F.col("name")).alias("name"),
        F.when(size.between(20, 39), F.col("brand")).alias("price"),
        F.when(size > 10, F.concat(F.lit("u"), size)).alias("url"))
    return folds.merge_products(p)


@query("w9_chunk_ordinals", r"""with p as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1
  as page_idx, string_split(text, chr(10)) as l from documents),
c as (select doc_id, source, page_idx, len(l) as total, unnest(l) as content, generate_subscripts(l, 1) - 1 as i from p)
select source || '_page_' || page_idx || '_chunk_' || i as chunk_id, page_idx, i::int as chunk_index, total::int as
  total_chunks, sha256(content) as content_hash from c""")
def w9(spark, d):
    from orgweave.plans.chunks import number_chunks
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("domain"), F.split("text", "\n").alias("chunks"))
    return number_chunks(docs, "doc_id").select(
        "chunk_id", F.col("page_idx"), "chunk_index", "total_chunks", F.sha2("content", 256).alias("content_hash"))


@query("w10_family_cap", """with q as (select p_brand as family, p_name || ' ' || p_partkey as query from part)
select family, query from (select *, row_number() over (partition by family order by md5('42:' || query), query) as k from q)
where k <= 50""")
def w10(spark, d):
    q = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.concat_ws(" ", "p_name", "p_partkey").alias("query"))
    return folds.family_cap(q, 50)


@query("w11_chat_window", """with t as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as p,
  count(*) over (partition by conv_id) as n from conversations)
select conv_id, turn, role, case when p > n - 3 then 'active' else 'to_summarise' end as part from t
where p > n - 3 or p > 1""")
def w11(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lit(1).alias("processed"))
    # conversations here have at most 8 turns, so the window is 3 to exercise both parts
    return folds.chat_window(turns, 3, "processed").drop("processed")


@query("w12_history_desc", "select o_custkey, o_orderkey, o_orderpriority from orders")
def w12(spark, d):
    return folds.history_desc(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_orderpriority")


@query("w13_approved_first", """select event_id as seq, case when value > 40 then 'approved' else 'rejected' end as status
from events""")
def w13(spark, d):
    v = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("value") > 40, "approved").otherwise(
        "rejected").alias("status"))
    return folds.approved_first(v)


@query("w14_greedy_pack", """with recursive n as (select source, row_number() over (partition by source order by doc_id) as p,
  doc_id, length(text) as len from documents),
r as (select source, p, doc_id, len as acc, 1 as chunk_no from n where p = 1
  union all select n.source, n.p, n.doc_id, case when r.acc + n.len > 3000 then n.len else r.acc + n.len end,
    case when r.acc + n.len > 3000 then r.chunk_no + 1 else r.chunk_no end
  from r join n on n.source = r.source and n.p = r.p + 1)
select source, doc_id, chunk_no::bigint as chunk_no from r""")
def w14(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("len"))
    return folds.greedy_pack(docs, F.col("len"), "doc_id", 3000, key="source").select("source", "doc_id", "chunk_no")


@query("w15_consecutive_failures", f"with {HEALTH_SQL} select event_id, user_id, failures, failures < 3 as healthy from r")
def w15(spark, d):
    return folds.consecutive_failures(table(spark, d, "events"), "user_id", F.col("event_type") != "error", "event_id").select(
        "event_id", "user_id", "failures", "healthy")


@query("w16_cap_results", """(select 'all' as scope, user_id as domain, min(event_id) as seq from events group by user_id
  order by seq limit 40)
union all select event_type, user_id, event_id from (select *, row_number() over (partition by event_type order by event_id)
  as rn from events) where rn <= 20""")
def w16(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("domain"),
                                         F.col("event_type").alias("engine"))
    capped = folds.cap_results(r, 40).select(F.lit("all").alias("scope"), "domain", "seq")
    return capped.unionByName(folds.cap_per_engine(r, 20).select(F.col("engine").alias("scope"), "domain", "seq"))


@query("w17_engine_fallback", """with r as (select event_id, user_id as query, event_type as engine, case event_type when 'error'
  then 0 when 'signup' then 1 when 'click' then 2 end as rk from events)
select event_id, query, engine from (select *, min(rk) over (partition by query) as best from r where rk is not null)
where rk = best""")
def w17(spark, d):
    r = table(spark, d, "events").select("event_id", F.col("user_id").alias("query"), F.col("event_type").alias("engine"))
    return folds.engine_fallback(r, ["error", "signup", "click"])


@query("a15_merge_profiles", """with p as (select source as domain, doc_id as seq, case when n_chars > 400 then lang || n_chars
    else '' end as company, lang || ':' || text as description, [lang, substr(md5(text), 1, 1)] as notes,
    [lang || '@x.com', ''] as email, case when n_chars > 1000 then '/contact' || doc_id else '' end as contact_page,
    case when n_chars > 700 then 'https://x.com/' || doc_id else '' end as twitter from documents),
nt as (select domain, note, min(seq * 10 + i) as o from (select domain, seq, unnest(notes) as note,
  generate_subscripts(notes, 1) as i from p) where note <> '' group by 1, 2),
em as (select domain, e, min(seq) as o from (select domain, seq, unnest(email) as e from p) where e <> '' group by 1, 2)
select p.domain, arg_max(company, length(company) * 1000000 - seq) as company,
  arg_max(description, length(description) * 1000000 - seq) as description,
  arg_min(contact_page, seq) filter (where contact_page <> '') as contact_page,
  arg_min(twitter, seq) filter (where twitter <> '') as twitter,
  (select string_agg(note, '|' order by o) from nt where nt.domain = p.domain) as notes,
  (select string_agg(e, '|' order by o) from em where em.domain = p.domain) as emails
from p group by p.domain""")
def a15(spark, d):
    n, lang = F.col("n_chars"), F.col("lang")
    chunks = table(spark, d, "documents").select(
        F.col("source").alias("domain"), F.col("doc_id").alias("seq"),
        F.when(n > 400, F.concat(lang, n)).otherwise("").alias("company"),
        F.concat(lang, F.lit(":"), "text").alias("description"),
        F.array(lang, F.substring(F.md5("text"), 1, 1)).alias("notes"),
        F.struct(F.array(F.concat(lang, F.lit("@x.com")), F.lit("")).alias("email"),
                 F.array().cast("array<string>").alias("phone"), F.array().cast("array<string>").alias("address"),
                 F.when(n > 1000, F.concat(F.lit("/contact"), "doc_id")).otherwise("").alias("contact_page"))
        .alias("main_contacts"),
        F.create_map(F.lit("twitter"), F.when(n > 700, F.concat(F.lit("https://x.com/"), "doc_id")).otherwise(""))
        .alias("social_media"))
    merged = merge_profiles(chunks)
    lists = merged["values"]
    joined = lambda field, name: lists.where(F.col("field") == field).groupBy("domain").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_at", "value"))), lambda s: s["value"]), "|")
        .alias(name))
    twitter = merged["socials"].where("platform = 'twitter'").select("domain", F.col("url").alias("twitter"))
    return (merged["profile"].join(twitter, "domain", "left").join(joined("notes", "notes"), "domain", "left")
            .join(joined("email", "emails"), "domain", "left"))


@query("l1_paginate", """select o_orderkey, total, pages from (select o_orderkey from orders order by o_orderdate desc,
  o_orderkey limit 50 offset 100), (select count(*) as total, ceil(count(*) / 50.0)::bigint as pages from orders)""")
def l1(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    page = ordering.paginate(orders, [F.col("o_orderdate").desc(), "o_orderkey"], ordering.page_to_skip(3, 50), limit=50)
    totals = ordering.page_numbers(orders, 50)
    return page.select("o_orderkey", totals.select("total").scalar().alias("total"),
                       totals.select("total_pages").scalar().alias("pages"))


@query("l3_recent_companies", """select source as domain, lang as name, substr(text, 1, 100) || '...' as description from
  documents order by doc_id desc limit 5""")
def l3(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("name"),
                                               F.col("text").alias("description"), "doc_id")
    return filters.company_cards(ordering.paginate(docs, [F.col("doc_id").desc()], limit=5))


@query("l5_campaigns_and_drafts", """(select 'campaign' as kind, c_custkey as id from customer where c_nationkey = 3
  order by c_acctbal desc, c_custkey limit 20 offset 5)
union all (select 'draft', o_orderkey from orders where o_custkey = 77 order by o_orderdate desc, o_orderkey limit 100)""")
def l5(spark, d):
    campaigns = filters.children_of(table(spark, d, "customer"), "c_nationkey", 3, [F.col("c_acctbal").desc(), "c_custkey"],
                                    skip=5, limit=20).select(F.lit("campaign").alias("kind"), F.col("c_custkey").alias("id"))
    drafts = filters.children_of(table(spark, d, "orders"), "o_custkey", 77, [F.col("o_orderdate").desc(), "o_orderkey"], 100)
    return campaigns.unionByName(drafts.select(F.lit("draft").alias("kind"), F.col("o_orderkey").alias("id")))


@query("x1_union_sources", """select s_suppkey as id, 'bing' as source from supplier union all
select c_custkey, 'google' from customer""")
def x1(spark, d):
    return setops.union_sources({
        "bing": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")),
        "google": table(spark, d, "customer").select(F.col("c_custkey").alias("id"))})


@query("x2_union_vetting", """select domain, seq, status from (select *, row_number() over (partition by domain order by seq
  desc) as rn from (select user_id as domain, event_id as seq, case when value > 40 then 'approved' else 'rejected' end
  as status from events)) where rn = 1""")
def x2(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("domain"), F.col("event_id").alias("seq"), "value")
    return setops.union_vetting(r.where("value > 40").drop("value"), r.where("value <= 40").drop("value"))
