"""Counts, statistics and rollups."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.operators import reports as ops


@query("a1_dashboard_stats", """with n as (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1)
select o_custkey as owner, count(*) as companies, count(*) filter (where coalesce(n, 0) > 0) as with_contacts,
  sum(coalesce(n, 0))::bigint as total_contacts from orders left join n on l_orderkey = o_orderkey group by 1""")
def a1(spark, d):
    contacts = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("n_contacts"))
    return ops.dashboard_stats(st.companies(spark, d), contacts)


@query("a2_companies_with_score", """select s_nationkey as owner, count(*) filter (where s_acctbal > 0) as with_score
from supplier group by 1""")
def a2(spark, d):
    return ops.companies_with_score(table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("owner"), F.col("s_acctbal").alias("contact_score")))


@query("a3_simple_counts", """select 'documents' as tbl, source as key, count(*) as n from documents group by source
union all select 'products', p_brand, count(*) from part group by p_brand
union all select 'embeddings', label::varchar, count(*) from embeddings group by label""")
def a3(spark, d):
    of = lambda t, k: ops.simple_counts(table(spark, d, t).select(F.col(k).cast("string").alias("key")), "key").select(
        F.lit(t).alias("tbl"), "key", "n")
    return of("documents", "source").unionByName(of("part", "p_brand").withColumn("tbl", F.lit("products"))).unionByName(
        of("embeddings", "label"))


@query("a4_collection_stats", f"""with {st.SITES} select 'companies' as name, count(*) as n from supplier
union all select 'products', count(*) from part union all select 'raw_pages', count(*) from pages
union all select 'domains', count(*) from sites""")
def a4(spark, d):
    t = lambda n: table(spark, d, n)
    return ops.collection_stats({"companies": t("supplier"), "products": t("part"), "raw_pages": t("pages")},
                                st.pages(spark, d).select(F.col("site").alias("domain")))


@query("a5_distinct_domains", f"with {st.SITES} select distinct site as domain from sites")
def a5(spark, d):
    return ops.distinct_domains(st.pages(spark, d).select(F.col("site").alias("domain")))


@query("a6_send_stats", f"""with {st.SENDS} select count(*) as total_sent, count(*) filter (where status = 'sent') as
  successful, count(*) filter (where status = 'failed') as failed, count(distinct domain) as unique_domains,
  epoch_us(min(sent_at)) as earliest, epoch_us(max(sent_at)) as latest from sends""")
def a6(spark, d):
    return ops.send_stats(st.sends(spark, d)).withColumn("earliest", F.unix_micros("earliest")).withColumn(
        "latest", F.unix_micros("latest"))


VERIFIED = """v as (select event_id, event_type in ('view', 'click') as is_valid, value as seconds,
  case event_type when 'error' then 'No MX records found' when 'signup' then null else 'Invalid email format' end as reason
  from events)"""


def verified(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        kind.isin("view", "click").alias("is_valid"), F.col("value").alias("seconds"),
        F.when(kind == "error", "No MX records found").when(kind == "signup", F.lit(None)).otherwise(
            "Invalid email format").alias("reason"))


@query("a7_verification_report", f"""with {VERIFIED}
select 'total' as line, count(*) as n, null::double as pct from v
union all select 'valid', count(*) filter (where is_valid), round(count(*) filter (where is_valid) * 100.0::double
  / count(*), 1) from v
union all select 'invalid', count(*) filter (where not is_valid), round(count(*) filter (where not is_valid)
  * 100.0::double / count(*), 1) from v
union all select coalesce(reason, 'Unknown'), count(*), null from v where not is_valid group by 1""")
def a7(spark, d):
    v = verified(spark, d)
    s = ops.verification_summary(v)
    row = lambda line, n, pct: s.select(F.lit(line).alias("line"), F.col(n).alias("n"), pct.cast("double").alias("pct"))
    reasons = ops.failure_reasons(v).select(F.col("reason").alias("line"), "n", F.lit(None).cast("double").alias("pct"))
    return (row("total", "total", F.lit(None)).unionByName(row("valid", "valid", F.col("valid_pct")))
            .unionByName(row("invalid", "invalid", F.col("invalid_pct"))).unionByName(reasons))


@query("a8_pricing_summary", f"""with {st.PRODUCTS}, p as (select domain, try_cast(regexp_replace(case when p_size < 10
  then 'free' else price end, '[^0-9.]', '', 'g') as double) as p from products)
select domain, count(*) as product_count, round(avg(p), 2) as average_price, min(p) as min_price, max(p) as max_price,
  min(p) || ' - ' || max(p) as price_range from p where p > 0 group by domain""")
def a8(spark, d):
    return ops.pricing_summary(st.products(spark, d).withColumn(
        "price", F.when(F.col("p_size") < 10, "free").otherwise(F.col("price"))))


@query("a9_crawl_summary", """select count(*) as total_domains, count(*) filter (where o_orderstatus = 'F') as
  crawled_domains, count(*) filter (where o_orderstatus = 'O') as skipped_domains, count(*) filter (where
  o_orderstatus = 'P') as failed_domains, sum(o_totalprice::bigint)::bigint as total_pages from
  (select o_orderstatus, floor(o_totalprice) as o_totalprice from orders)""")
def a9(spark, d):
    s = F.col("o_orderstatus")
    return ops.crawl_summary(table(spark, d, "orders").select(
        F.when(s == "F", "success").when(s == "O", "skipped").otherwise("failed").alias("outcome"),
        F.floor("o_totalprice").alias("pages_crawled")))


@query("a10_discovery_summary", """select count(*) as total_results, count(distinct user_id) as unique_domains,
  count(*) filter (where event_type <> 'error') as vetted, count(*) filter (where event_type in ('click', 'view')) as
  approved_domains, count(*) filter (where event_type in ('signup', 'purchase')) as rejected_domains,
  count(*) filter (where event_type = 'click') as saved_domains, count(*) as total_queries,
  count(*) filter (where value < 50) as successful_queries, count(*) filter (where value >= 50) as failed_queries,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double as total_duration_seconds from events""")
def a10(spark, d):
    kind = F.col("event_type")
    ev = table(spark, d, "events")
    results = ev.select(F.col("user_id").alias("domain"), F.when(kind.isin("click", "view"), "approved").when(
        kind.isin("signup", "purchase"), "rejected").alias("status"), (kind == "click").alias("saved"))
    runs = ev.select((F.col("value") < 50).alias("success"), F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"))
    totals = ops.execution_summary(runs)
    return ops.discovery_summary(results).withColumns({c: totals.select(c).scalar() for c in totals.columns})


@query("a11_vetting_split", """with v as (select event_id as seq, 'd' || user_id as domain, case when value > 40 then
  'approved' else 'rejected' end as status from events),
n as (select *, (row_number() over (partition by status order by seq) - 1) // 1000 as page from v),
c as (select status, count(*) as n from v group by 1)
select n.status, page::int as page, c.n, string_agg(domain, '|' order by seq) as domains from n join c
  on c.status = n.status group by 1, 2, 3""")
def a11(spark, d):
    v = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("d"), F.col("user_id")).alias("domain"),
        F.when(F.col("value") > 40, "approved").otherwise("rejected").alias("status"))
    return ops.vetting_split(v, page_size=1000).withColumn(
        "domains", F.array_join(F.transform("domains", lambda s: s["domain"]), "|"))


@query("a12_campaign_rollup", """select o_custkey as campaign_id, count(*) filter (where o_orderstatus = 'F') as sent,
  count(*) filter (where o_orderstatus = 'O') as generated, count(*) filter (where o_orderstatus = 'P') as uninitiated
from orders group by 1""")
def a12(spark, d):
    s = F.col("o_orderstatus")
    drafts = table(spark, d, "orders").select(F.col("o_custkey").alias("campaign_id"), F.when(s == "F", "sent").when(
        s == "O", "generated").otherwise("uninitiated").alias("status"))
    return ops.campaign_rollup(drafts, ["sent", "generated", "uninitiated"])


@query("a13_bulk_send_summary", f"""with {st.SENDS} select message_id, row_number() over (order by message_id) as batch_index,
  count(*) over () as batch_total, count(*) filter (where status = 'sent') over () as success_count,
  count(*) filter (where status <> 'sent') over () as fail_count from sends where status <> 'queued'""")
def a13(spark, d):
    sends = st.sends(spark, d).where("status <> 'queued'").select("message_id", "status")
    s = ops.bulk_send_summary(sends, F.col("status") == "sent")
    return ops.with_batch_position(sends, "message_id").drop("status").withColumns(
        {c: s.select(c).scalar() for c in ("success_count", "fail_count")})


HEALTH_SQL = """a as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by event_id) as g
  from events), r as (select *, (count(*) filter (where event_type = 'error') over (partition by user_id, g order by
  event_id))::bigint as failures from a)"""


@query("a20_source_health", f"""with {HEALTH_SQL}, l as (select user_id, arg_max(failures, event_id) as f from r group by 1)
select count(*) as total, count(*) filter (where f < 2) as healthy, count(*) filter (where f >= 2) as unhealthy from l""")
def a20(spark, d):
    from orgweave.operators.folds import consecutive_failures
    from orgweave.partitioning import first_n_per_key
    # two failures in a row are already rare in the given events
    rows = consecutive_failures(table(spark, d, "events"), "user_id", F.col("event_type") != "error", "event_id", limit=2)
    last = first_n_per_key(rows, ["user_id"], [F.col("event_id").desc()])
    return last.agg(F.count("*").alias("total"), F.count_if("healthy").alias("healthy"),
                    F.count_if(~F.col("healthy")).alias("unhealthy"))


@query("a20_source_health_default", f"""with {HEALTH_SQL}, l as (select user_id, arg_max(failures, event_id) as f from r
  group by 1)
select count(*) as total, count(*) filter (where f < 3) as healthy, count(*) filter (where f >= 3) as unhealthy from l""")
def a20_default(spark, d):
    return ops.source_health(table(spark, d, "events"), "user_id", F.col("event_type") != "error", "event_id")


@query("a21_product_categories", """select l_partkey as domain, count(*) as products_extracted, epoch_us(max(l_shipdate)) as
  extraction_us from lineitem group by 1""")
def a21(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("domain"), "l_shipdate")
    return ops.product_rollup(rows, "l_shipdate").select("domain", "products_extracted",
                                                         F.unix_micros("extraction_date").alias("extraction_us"))


@query("a22_domain_relevance", """select o_orderkey as domain, case when o_orderkey in (select l_orderkey from lineitem)
  then 'relevant' else 'irrelevant' end as relevance_status, case when o_orderkey not in (select l_orderkey from lineitem)
  then 'No relevant products found after extraction' end as relevance_reason from orders""")
def a22(spark, d):
    return ops.domain_relevance(table(spark, d, "orders").select(F.col("o_orderkey").alias("domain")),
                                table(spark, d, "lineitem").select(F.col("l_orderkey").alias("domain")))
