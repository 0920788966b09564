"""How the given tables stand in for landed pages, sites, mails and the like.

Each stand-in exists twice: as a DataFrame and as SQL text for the reference
queries. Values a given table lacks (a footer link, a shop word) are derived
from the row's own url or key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.catalog.base import table
from orgweave.functions import urls

NOW = "2024-01-31 00:00:00"

# A few rules of the public-suffix list; for real data read the whole list with urls.read_suffix_rules.
SUFFIX_LINES = [
    "// a comment", "com", "net", "org", "io", "co", "uk", "co.uk", "org.uk", "ac.uk", "de", "fr", "es", "it", "jp", "co.jp",
    "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "br", "com.br", "*.nom.br", "au", "com.au", "za", "co.za",
]

HOST_SQL = (r"regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), "
            r"'^www\.', '')")
SITE_SQL = f"replace({HOST_SQL}, '.example.', '.')"
LABEL_SQL = r"regexp_extract(site, '([^.]+)\.[^.]+$', 1)"
PG = f"pg as (select page_id, url, html, {HOST_SQL} as host, {SITE_SQL} as site from pages)"
SITES = f"{PG}, sites as (select site, min(page_id) as seq from pg group by site)"
VARIANTS = SITES + r""", variants as (
  select site as d from sites
  union all select 'www.shop.' || site from sites
  union all select regexp_replace(site, '\.[a-z]+$', '.co.uk') from sites
  union all select regexp_replace(site, '^([^.]+)', '\1-gkstore') from sites)"""
SHOP_HTML_SQL = """html || case when url like '%utm_source%' then ' <b>Add to Cart</b>'
  when url like '%.html' then ' CDN.shopify.com' when url like '%#top' then ' "@type":"Product"'
  when url like '%?page=%' then ' shop price of a product' else '' end"""
RICH_HTML_SQL = """'<meta name="description" content="' || label || ' goods for ' || site || '">'
  || case when url like '%.html%' then '<meta content="' || label || ' Ltd" property="og:site_name">' else '' end
  || '<link rel="canonical" href="https://' || site || '/home"><footer><a href="https://www.facebook.com/' || label
  || '">f</a><a href="/about">About &amp; <b>us</b></a><a data-url="https://' || site
  || '/x" href="https://x.com/' || label || '">X</a> sales@' || site || ' info@example.com</footer>'
  || '<script type="application/ld+json">{"@type":"Organization","url":"https://' || site
  || '/","sameAs":["https://twitter.com/' || label || '"]}</script>'
  || replace(html, '<title>', '<title>' || label || case when url like '%#top' then ' - ' else ' ' end)"""
RICH = f"""{PG}, lab as (select *, {LABEL_SQL} as label from pg),
rich as (select page_id, url, host, site, label, {RICH_HTML_SQL} as html from lab)"""


def pages(spark, sf_dir) -> DataFrame:
    host = urls.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", host.alias("host"), F.replace(host, F.lit(".example."), F.lit(".")).alias("site"))


def sites(spark, sf_dir) -> DataFrame:
    return pages(spark, sf_dir).groupBy("site").agg(F.min("page_id").alias("seq"))


def variants(spark, sf_dir) -> DataFrame:
    site = F.col("site")
    return sites(spark, sf_dir).select(F.explode(F.array(
        site, F.concat(F.lit("www.shop."), site), F.regexp_replace(site, r"\.[a-z]+$", ".co.uk"),
        F.regexp_replace(site, r"^([^.]+)", "$1-gkstore"))).alias("d"))


def suffix_rules(spark) -> DataFrame:
    return urls.suffix_rules(spark.createDataFrame([(line,) for line in SUFFIX_LINES], "line string"))


def label(site: Column) -> Column:
    return F.regexp_extract(site, r"([^.]+)\.[^.]+$", 1)


def shop_html(html: Column, url: Column) -> Column:
    extra = (F.when(url.contains("utm_source"), F.lit(" <b>Add to Cart</b>"))
             .when(url.endswith(".html"), F.lit(" CDN.shopify.com"))
             .when(url.endswith("#top"), F.lit(' "@type":"Product"'))
             .when(url.contains("?page="), F.lit(" shop price of a product")).otherwise(F.lit("")))
    return F.concat(html, extra)


def rich_pages(spark, sf_dir) -> DataFrame:
    df = pages(spark, sf_dir).withColumn("label", label(F.col("site")))
    url, lab, site = F.col("url"), F.col("label"), F.col("site")
    html = F.concat(
        F.lit('<meta name="description" content="'), lab, F.lit(" goods for "), site, F.lit('">'),
        F.when(url.contains(".html"), F.concat(F.lit('<meta content="'), lab,
                                               F.lit(' Ltd" property="og:site_name">'))).otherwise(F.lit("")),
        F.lit('<link rel="canonical" href="https://'), site,
        F.lit('/home"><footer><a href="https://www.facebook.com/'), lab,
        F.lit('">f</a><a href="/about">About &amp; <b>us</b></a><a data-url="https://'), site,
        F.lit('/x" href="https://x.com/'), lab, F.lit('">X</a> sales@'), site, F.lit(" info@example.com</footer>"),
        F.lit('<script type="application/ld+json">{"@type":"Organization","url":"https://'), site,
        F.lit('/","sameAs":["https://twitter.com/'), lab, F.lit('"]}</script>'),
        F.replace(F.col("html"), F.lit("<title>"), F.concat(
            F.lit("<title>"), lab, F.when(url.endswith("#top"), F.lit(" - ")).otherwise(F.lit(" ")))))
    return df.select("page_id", "url", "host", "site", "label", html.alias("html"))


SENDS = """sends as (select event_id as message_id, 'd' || user_id || '.com' as domain,
  'c' || json_extract_string(props, '$.k') as campaign_id,
  case when event_type in ('error') then 'failed' when event_type = 'signup' then 'queued' else 'sent' end as status,
  value, ts as sent_at from events)"""


def sends(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("message_id"), F.concat(F.lit("d"), F.col("user_id"), F.lit(".com")).alias("domain"),
        F.concat(F.lit("c"), F.get_json_object("props", "$.k")).alias("campaign_id"),
        F.when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("sent").alias("status"),
        "value", F.col("ts").alias("sent_at"))


JOBS = """jobs as (select o_orderkey as id, o_custkey as user_id, o_orderpriority as job_type,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'queued' end as status,
  o_totalprice as amount, o_orderdate as created_at from orders)"""


def jobs(spark, sf_dir) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("job_type"),
        F.when(status == "F", "completed").when(status == "O", "running").otherwise("queued").alias("status"),
        F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("created_at"))


COMPANIES = """companies as (select o_orderkey as id, o_custkey as owner, 'site' || o_orderkey || '.com' as domain,
  case o_orderpriority when '1-URGENT' then 'irrelevant' when '2-HIGH' then null else 'relevant' end
    as relevance_status,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'crawling' else 'not_crawled' end as crawl_status,
  case when o_totalprice > 200000 then o_orderdate end as embedded_at, o_orderdate as created_at,
  o_totalprice as score from orders)"""


def companies(spark, sf_dir) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"),
        F.concat(F.lit("site"), F.col("o_orderkey"), F.lit(".com")).alias("domain"),
        F.when(priority == "1-URGENT", "irrelevant").when(priority == "2-HIGH", F.lit(None)).otherwise("relevant")
        .alias("relevance_status"),
        F.when(status == "F", "completed").when(status == "O", "crawling").otherwise("not_crawled")
        .alias("crawl_status"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate")).alias("embedded_at"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("score"))


PHONES = r"""ph as (select doc_id, unnest(regexp_extract_all(text, '\+?[0-9(][0-9 ().-]{4,}[0-9]')) as phone
  from documents)"""


def phones(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\+?[0-9(][0-9 ().-]{4,}[0-9]"), F.lit(0)))
        .alias("phone"))


MAILS = r"""mails as (select doc_id, source, lower(unnest(regexp_extract_all(text,
  '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b'))) as email from documents)"""


def mails(spark, sf_dir) -> DataFrame:
    from orgweave.functions.html import EMAIL_PATTERN
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.explode(F.transform(
            F.regexp_extract_all("text", F.lit(EMAIL_PATTERN), F.lit(0)), F.lower)).alias("email"))


PRODUCTS = """products as (select p_partkey as seq, lower(p_type) || '.com' as domain, p_name as name,
  p_brand as brand, p_type as category, '$' || p_retailprice as price, p_size, p_retailprice from part)"""


def products(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lower("p_type"), F.lit(".com")).alias("domain"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price"), "p_size", "p_retailprice")
