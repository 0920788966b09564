"""Page functions."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.functions import html as H

DROP = lambda inner, tag: f"regexp_replace({inner}, '(?is)<{tag}\\b[^>]*>.*?</{tag}[ \\t\\r\\n]*>', ' ', 'g')"
BLANK = lambda inner: f"trim(regexp_replace({inner}, '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g'))"
TAGS = lambda inner: f"regexp_replace({inner}, '<[^>]+>', ' ', 'g')"


# the entities that occur in the given pages; &amp; last so nothing is decoded twice
PAGE_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def entities_sql(inner: str) -> str:
    for name, char in PAGE_ENTITIES.items():
        inner = f"replace({inner}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return inner


def visible_sql(inner: str, paired: list[str], void: list[str]) -> str:
    inner = f"regexp_replace({inner}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in paired:
        inner = DROP(inner, tag)
    for tag in void:
        inner = f"regexp_replace({inner}, '(?i)<{tag}\\b[^>]*>', ' ', 'g')"
    return BLANK(entities_sql(TAGS(inner)))


STRIP_SQL = "substr(" + BLANK(TAGS(
    "regexp_replace(" + DROP(DROP("html", "script"), "style")
    + ", '(?i)\\b(privacy policy|terms of service|cookie|subscribe|newsletter)\\b', ' ', 'g')")) + ", 1, 8000)"


@query("f11_html_strip", f"""with s as (select page_id, {STRIP_SQL} as t from pages)
select page_id, length(t) as n, md5(t) as text from s""")
def f11(spark, d):
    return table(spark, d, "pages").select("page_id", H.html_strip(F.col("html"), 8000).alias("t")).select(
        "page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text"))


@query("f12_html_visible_text", f"""select page_id, md5({visible_sql('html', ['script', 'style'], ['meta', 'link'])})
  as scrape, md5({visible_sql('html', ['script', 'style', 'nav', 'footer'], [])}) as relevance from pages""")
def f12(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(H.scrape_text(F.col("html"))).alias("scrape"),
                                           F.md5(H.relevance_text(F.col("html"))).alias("relevance"))


def shop_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", st.shop_html(F.col("html"), F.col("url")).alias("html"))


@query("f15_platform_fingerprint", f"""select page_id, regexp_matches(lower({st.SHOP_HTML_SQL}),
  'cdn\\.shopify\\.com|shopify|x-shopify-stage|woocommerce|/wp-json/wc/|wp-content/plugins/woocommerce|cdn\\.bcapp|bigcommerce'
  ) as platform from pages""")
def f15(spark, d):
    return shop_pages(spark, d).select("page_id", H.platform_fingerprint(F.col("html")).alias("platform"))


@query("f16_soft_vet_flags", f"""with s as (select page_id, replace(url, '/de/', '/Cart/') as url, {st.SHOP_HTML_SQL}
  as html from pages)
select page_id, contains(html, '"@type":"Product"') as has_product_schema,
  regexp_matches(lower(html), 'add to cart|add-to-cart|basket') or regexp_matches(
    lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/cart|/checkout|/product|/collections|/shop')
    as has_cart,
  regexp_matches(lower(html), 'shopify|woocommerce|/wp-json/wc/|cdn\\.bcapp|bigcommerce') as has_platform_fp from s""")
def f16(spark, d):
    url = F.replace(F.col("url"), F.lit("/de/"), F.lit("/Cart/"))
    return shop_pages(spark, d).select("page_id", *H.soft_vet_flags(F.col("html"), url))


@query("f17_rule_flags", f"""with s as (select page_id, url, lower({st.SHOP_HTML_SQL}) as low from pages)
select page_id, regexp_matches(low, 'cdn\\.shopify\\.com|woocommerce|/wp-json/wc/|bigcommerce')
    or regexp_matches(lower(url), '/cart|/checkout|/product|/collections|/shop')
    or contains(low, '"@type":"product"') as rule_yes,
  not regexp_matches(low, 'product|cart|checkout|shop|store') as rule_no from s""")
def f17(spark, d):
    html, url = F.col("html"), F.col("url")
    return shop_pages(spark, d).select("page_id", H.rule_yes(html, url).alias("rule_yes"),
                                       H.rule_no(html).alias("rule_no"))


TITLE_SQL = "trim(" + entities_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + ")"


@query("f20_page_title_company", f"""with {st.RICH}, t as (select page_id, {TITLE_SQL} as title,
  regexp_extract(html, '(?is)<meta[^>]*\\bcontent="([^"]*)"[^>]*\\bproperty="og:site_name"', 1) as og from rich)
select page_id, title, case when og <> '' then og when contains(title, ' - ') then trim(string_split(title, ' - ')[1])
  when contains(title, ' | ') then trim(string_split(title, ' | ')[1])
  when contains(title, ' – ') then trim(string_split(title, ' – ')[1]) else title end as company from t""")
def f20(spark, d):
    html = F.col("html")
    return st.rich_pages(spark, d).select("page_id", H.page_title(html).alias("title"),
                                          H.site_name(html).alias("company"))


@query("f21_meta_description", f"""with {st.RICH} select page_id, regexp_extract(html,
  '(?is)<meta[^>]*\\bname="description"[^>]*\\bcontent="([^"]*)"', 1) as description from rich""")
def f21(spark, d):
    return st.rich_pages(spark, d).select("page_id", H.meta_description(F.col("html")).alias("description"))


EMAILS_SQL = r"regexp_extract_all({0}, '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z|]{{2,}}\b')"


@query("f22_page_emails", f"""select doc_id as id, 'doc' as kind,
  array_to_string(list_sort(list_distinct({EMAILS_SQL.format('text')}[1:5])), '|') as emails from documents
union all select page_id, 'page', array_to_string(list_sort(list_distinct(list_filter({EMAILS_SQL.format('html')},
  lambda e: not regexp_matches(lower(e), 'example\\.com|sentry\\.io|google|facebook\\.com'))[1:5])), '|') from rich"""
       .replace("select doc_id", f"with {st.RICH} select doc_id", 1))
def f22(spark, d):
    join = lambda e: F.array_join(F.array_sort(e), "|").alias("emails")
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), join(H.page_emails(F.col("text"), [], 5)))
    return docs.unionByName(st.rich_pages(spark, d).select(
        F.col("page_id").alias("id"), F.lit("page").alias("kind"), join(H.page_emails(F.col("html"), limit=5))))


def map_text(col):
    return F.array_join(F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat(
        e["key"], F.lit("="), e["value"]))), "|")


@query("f23_social_handles", f"""with {st.RICH}, h as (select page_id,
  regexp_extract(html, 'facebook\\.com/([a-zA-Z0-9_.]+)', 1) as fb,
  regexp_extract(html, 'twitter\\.com/([a-zA-Z0-9_]+)', 1) as tw from rich)
select page_id, array_to_string(list_filter([case when fb <> '' then 'facebook=' || fb end,
  case when tw <> '' then 'twitter=' || tw end], lambda x: x is not null), '|') as handles from h""")
def f23(spark, d):
    return st.rich_pages(spark, d).select("page_id", map_text(H.social_handles(F.col("html"))).alias("handles"))


@query("f24_footer_socials", rf"""with {st.RICH}, f as (select page_id, regexp_extract_all(regexp_extract(html,
  '(?is)<footer\b[^>]*>(.*?)</footer>', 1), '(?i)<a\s+[^>]*href=["'']([^"'']+)["'']', 1) as links from rich)
select page_id, 'facebook=' || list_filter(links, lambda l: contains(l, 'facebook.com'))[1] || '|twitter='
  || list_filter(links, lambda l: contains(l, 'x.com'))[1] as socials from f""")
def f24(spark, d):
    return st.rich_pages(spark, d).select(
        "page_id", map_text(H.footer_socials(F.col("html"), F.col("url"))).alias("socials"))


@query("f25_page_links", rf"""with {st.RICH}
select page_id, array_to_string(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"'']+)["'']', 1), '|') as hrefs,
  array_to_string(list_filter(list_transform(regexp_extract_all(html,
    '(?is)<a\s+[^>]*href=["''][^"'']+["''][^>]*>(.*?)</a>', 1),
    lambda t: lower(trim({entities_sql("regexp_replace(t, '<[^>]+>', ' ', 'g')")}))), lambda t: t <> ''), '|') as texts,
  array_to_string(regexp_extract_all(html,
    '(?i)<link\s+[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']+)["'']', 1), '|') as meta_urls,
  array_to_string(list_concat(regexp_extract_all(html, '(?i)data-(?:href|url|link)=["'']([^"'']+)["'']', 1),
    regexp_extract_all(html, '(?i)(?:url|href|link|website|domain)\s*[:=]\s*["'']([^"'']+)["'']', 1)), '|') as data_urls
from rich""")
def f25(spark, d):
    df = st.rich_pages(spark, d).select("page_id", H.page_links(F.col("html")).alias("l"))
    return df.select("page_id", F.array_join("l.hrefs", "|").alias("hrefs"),
                     F.array_join("l.link_texts", "|").alias("texts"),
                     F.array_join("l.meta_urls", "|").alias("meta_urls"),
                     F.array_join("l.data_urls", "|").alias("data_urls"))


@query("f26_jsonld_urls", rf"""with {st.RICH} select page_id, regexp_extract(html, '"url":"([^"]*)"', 1) || '|'
  || regexp_extract(html, '"sameAs":\["([^"]*)"\]', 1) as urls from rich""")
def f26(spark, d):
    return st.rich_pages(spark, d).select("page_id", F.array_join(H.jsonld_urls(F.col("html")), "|").alias("urls"))
