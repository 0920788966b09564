"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.session import work_path
from orgweave.sources import files

DEPTH_SQL = "len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) - 3"


def with_depth(spark, d):
    from orgweave.functions.urls import url_path
    return st.pages(spark, d).withColumn("depth", F.size(F.split(url_path(F.col("url")), "/")) - 3).withColumnRenamed(
        "site", "domain")


@query("s1_scan_pages", f"""with {st.PG} select page_id, url from pg where site = 'blog.tionsh.net' order by page_id
limit 1000""")
def s1(spark, d):
    return files.scan_pages(with_depth(spark, d), "blog.tionsh.net", 1000).select("page_id", "url")


@query("s2_scan_homepage", f"""with {st.PG} select site as domain, page_id, url from (select *, row_number() over (partition by
  site order by page_id) as rn from pg where {DEPTH_SQL} = 0) where rn = 1""")
def s2(spark, d):
    return files.scan_homepage(with_depth(spark, d)).select("domain", "page_id", "url")


LOG = "message_id long, domain string, status string, sent_at timestamp"


@query("s3_scan_jsonl_tolerant", f"""with {st.SENDS} select message_id, domain, status from sends where status <> 'queued'""")
def s3(spark, d):
    path = work_path(spark, "log")
    sends = st.sends(spark, d)
    line = F.when(F.col("status") != "queued", F.to_json(F.struct("message_id", "domain", "status", "sent_at"))).when(
        F.col("value") > 50, F.lit("")).otherwise(F.lit('{"message_id": 1, "domain": '))
    sends.select(line.alias("value")).write.text(path)
    return files.scan_jsonl(spark, path, LOG).select("message_id", "domain", "status")


@query("s4_scan_jsonl_gz", f"with {st.PG} select site as domain, count(*) as pages from pg group by 1")
def s4(spark, d):
    path = work_path(spark, "pages")
    files.write_pages_gz(st.pages(spark, d).select(F.col("site").alias("domain"), "url", F.lit("x").alias("links")), path)
    return files.page_counts_gz(spark, path, "domain string, url string")


@query("s5_sink_append_log", f"with {st.SENDS} select message_id, domain, status, epoch_us(sent_at) as us from sends")
def s5(spark, d):
    path = work_path(spark, "sent")
    sends = st.sends(spark, d).select("message_id", "domain", "status", "sent_at")
    files.append_log(sends.where("status = 'sent'"), path)
    files.append_log(sends.where("status <> 'sent'"), path)
    return files.scan_jsonl(spark, path, LOG).select("message_id", "domain", "status",
                                                     F.unix_micros("sent_at").alias("us"))


@query("s6_sink_pages_gz", f"with {st.PG} select page_id, site as domain, md5(html) as html from pg")
def s6(spark, d):
    path = work_path(spark, "pages")
    files.write_pages_gz(st.pages(spark, d).withColumnRenamed("site", "domain").withColumn("links", F.array("url")), path)
    back = spark.read.json(path)
    if "links" in back.columns:
        raise AssertionError("links were written")
    return back.select("page_id", "domain", F.md5("html").alias("html"))


@query("s7_sink_bulk_insert", f"with {st.PRODUCTS} select seq, domain, name from products")
def s7(spark, d):
    path = work_path(spark, "products")
    products = st.products(spark, d).select("seq", "domain", "name")
    files.bulk_insert(products.where("name < 'm'"), path)
    files.bulk_insert(products.where("name >= 'm'"), path)
    return spark.read.parquet(path)


@query("s8_sink_replace_domain", f"""with {st.PRODUCTS} select seq, domain, name, 'old' as run from products where
  domain <> 'promo.com' union all select seq, domain, brand, 'new' from products where domain = 'promo.com' and p_size > 25""")
def s8(spark, d):
    path = work_path(spark, "catalog")
    products = st.products(spark, d)
    files.replace_domains(products.select("seq", "domain", "name", F.lit("old").alias("run")), path)
    files.replace_domains(products.where("domain = 'promo.com' and p_size > 25").select(
        "seq", "domain", F.col("brand").alias("name"), F.lit("new").alias("run")), path)
    return spark.read.parquet(path).select("seq", "domain", "name", "run")


@query("s9_build_global_index", """with c as (select lower(t) || '.com' as domain from (select distinct p_type as t from part
  union all select 'none')), p as (select lower(p_type) || '.com' as domain, * from part)
select 'company' as kind, c.domain, 'a@' || c.domain as a, count(p_partkey)::varchar as b from c left join p
  on p.domain = c.domain group by 2 union all select 'product', domain, p_name, p_brand from p""")
def s9(spark, d):
    products = st.products(spark, d).select("domain", F.concat("domain", F.lit("_"), "seq").alias("product_id"), "brand",
                                            "name", "category", "price", F.lit(None).cast("string").alias("url"))
    domains = products.select("domain").distinct().unionByName(
        products.select(F.lit("none.com").alias("domain")).distinct())
    companies = domains.select("domain", F.lit(None).cast("string").alias("company"),
                               F.array(F.concat(F.lit("a@"), "domain")).alias("email"))
    index, rows = files.build_global_index(companies, products)
    return index.select(F.lit("company").alias("kind"), "domain", F.col("email")[0].alias("a"),
                        F.col("products_count").cast("string").alias("b")).unionByName(
        rows.select(F.lit("product").alias("kind"), "domain", F.col("name").alias("a"), F.col("brand").alias("b")))


@query("s10_source_serp_json", f"""with {st.PG} select page_id as seq, host as domain, url, case when page_id < 100 then 'T' ||
  page_id else '' end as title, case when page_id < 100 then '' else 's' end as snippet, case when page_id < 100 then 'google'
  else 'bing' end as source from pg""")
def s10(spark, d):
    p = st.pages(spark, d)
    none = F.lit(None).cast("string")
    google = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("T"), "page_id").alias("title"), F.col("url").alias("link"), none.alias("snippet")),
        F.struct(F.lit("no host").alias("title"), F.lit("").alias("link"), none.alias("snippet"))).alias("items")))
    bing = F.to_json(F.struct(F.struct(F.array(F.struct(
        none.alias("name"), "url", F.lit("s").alias("snippet"))).alias("value")).alias("webPages")))
    payloads = p.select(F.col("page_id").alias("seq"), F.when(F.col("page_id") < 100, google).otherwise(bing).alias("payload"))
    return files.serp_results(payloads).drop("rank")


@query("s11_export_recent_sends", f"""with {st.SENDS} select message_id::varchar as message_id, domain, '' as recipient,
  campaign_id, status from sends order by sends.message_id desc limit 100""")
def s11(spark, d):
    path = work_path(spark, "export")
    sends = st.sends(spark, d).withColumn("seq", F.col("message_id")).withColumn(
        "recipient", F.lit(None).cast("string")).withColumn("subject_line", F.lit("hello"))
    files.export_csv(files.recent_sends(sends, 100), path)
    back = spark.read.option("header", "true").csv(path)
    return back.select("message_id", "domain", F.coalesce("recipient", F.lit("")).alias("recipient"), "campaign_id", "status")
