"""URL and domain functions."""

from pyspark.sql import functions as F

from orgweave.catalog import standins as st
from orgweave.catalog.base import query, table
from orgweave.functions import contacts, urls


@query("f1_url_host", f"select page_id, {st.HOST_SQL} as host from pages")
def f1(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_host(F.col("url")).alias("host"))


@query("f2_canonical_url", r"""select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as canonical
from pages""")
def f2(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("f3_resolve_url", r"""
with p as (select page_id, url, regexp_extract(url, '^([a-z]+)://', 1) as scheme,
    regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root,
    regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1) as folder,
    unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"'']+)["'']', 1)) as href from pages)
select page_id, href, root || href as absolute, root || folder || substr(href, 2) as relative,
  root || regexp_replace(folder, '[^/]+/$', '') || substr(href, 2) as parent,
  scheme || '://cdn.net' || href as other_host,
  regexp_replace(url, '[?#].*$', '') || '?q=1' as query_only, regexp_replace(url, '#.*$', '') || '#end' as fragment_only
from p""")
def f3(spark, d):
    from orgweave.functions.html import page_hrefs
    url, href = F.col("url"), F.col("href")
    rel = F.expr("substring(href, 2)")
    p = table(spark, d, "pages").select("page_id", "url", F.explode(page_hrefs(F.col("html"))).alias("href"))
    return p.select(
        "page_id", "href", urls.resolve_url(url, href).alias("absolute"), urls.resolve_url(url, rel).alias("relative"),
        urls.resolve_url(url, F.concat(F.lit("../"), rel)).alias("parent"),
        urls.resolve_url(url, F.concat(F.lit("//cdn.net"), href)).alias("other_host"),
        urls.resolve_url(url, F.lit("?q=1")).alias("query_only"),
        urls.resolve_url(url, F.lit("#end")).alias("fragment_only"))


@query("f4_domain_root", f"""with {st.VARIANTS}, s as (select d, string_split(lower(d), '.') as l from variants)
select d, case when len(l) >= 3 and l[-2] in ('co', 'com', 'net', 'org', 'ac') then array_to_string(l[-3:], '.')
  when len(l) >= 2 then array_to_string(l[-2:], '.') else d end as root from s""")
def f4(spark, d):
    return st.variants(spark, d).select("d", urls.domain_root(F.col("d")).alias("root"))


NAME_KEY_SQL = r"""(case when len(l) >= 3 and l[-2] in ('co','com','net','org','ac','gov','edu') then l[-3]
  when len(l) >= 2 then l[-2] else l[1] end)"""
TRIM_SQL = r"regexp_replace(lower({0}), '^(?:(?:www|shop|store|web|online|buy|get)\.)*([^.]+\..+)$', '\1')"


@query("f5_domain_name_key", f"""with {st.VARIANTS},
s as (select d, string_split({TRIM_SQL.format('d')}, '.') as l from variants)
select d, {NAME_KEY_SQL} as name_key from s""")
def f5(spark, d):
    return st.variants(spark, d).select("d", urls.domain_name_key(F.col("d")).alias("name_key"))


@query("f6_registrable_domain", rf"""with {st.VARIANTS}
select d, regexp_extract(d, '([^.]+\.(?:co\.uk|com|net|org))$', 1) as registrable from variants""")
def f6(spark, d):
    return urls.registrable_domain(st.variants(spark, d), "d", st.suffix_rules(spark))


RULES_SQL = ", ".join("('{}', '{}')".format(
    line.lstrip("!*."), {"!": "exception", "*": "wildcard"}.get(line[0], "plain")) for line in st.SUFFIX_LINES if line[0] != "/")
ENDINGS = [".ck", ".a.ck", ".city.kawasaki.jp", ".b.kawasaki.jp", ".kawasaki.jp", ".com.br", ".x.nom.br", ".Co.Uk", ".unknown"]


@query("f6_registrable_domain_rules", rf"""with {st.SITES}, rules(base, kind) as (values {RULES_SQL}), hosts as (
  select distinct regexp_replace(site, '\.[a-z]+$', e) as d from sites, unnest({ENDINGS!r}) u(e)
  union select unnest(['www.ck', 'ck', 'a.www.ck', 'city.kawasaki.jp', 'co.uk', '10.1.2.3'])),
l as (select d, string_split(lower(d), '.') as l from hosts), t as (select d, unnest(range(len(l))) as i, l from l),
cuts as (select d, kind, i + case kind when 'wildcard' then -1 when 'exception' then 1 else 0 end as c from t
  join rules on base = array_to_string(l[i + 1:], '.')),
best as (select d, coalesce(min(c) filter (kind = 'exception'), min(c)) as c from cuts where c >= 0 group by d)
select d, case when regexp_full_match(d, '[0-9.]+') then d else array_to_string(l[greatest(coalesce(c, len(l)), 1):], '.') end
  as registrable from l left join best using (d)""")
def f6_rules(spark, d):
    site = F.col("site")
    made = st.sites(spark, d).select(F.explode(F.array(*[F.regexp_replace(site, r"\.[a-z]+$", e) for e in ENDINGS])).alias("d"))
    odd = spark.createDataFrame([(x,) for x in ("www.ck", "ck", "a.www.ck", "city.kawasaki.jp", "co.uk", "10.1.2.3")], "d string")
    return urls.registrable_domain(made.unionByName(odd).distinct(), "d", st.suffix_rules(spark))


BRAND_SQL = r"""trim(lower(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(string_split({0}, '.')[1], 'store$', ''), 'shop$', ''), 'direct$', ''), 'global$', ''),
  'official$', ''), '[-_]', '', 'g'), 'gk', 'goalkeeper')))"""


@query("f7_brand_name", f"with {st.VARIANTS} select d, {BRAND_SQL.format('d')} as brand from variants")
def f7(spark, d):
    return st.variants(spark, d).select("d", urls.brand_name(F.col("d")).alias("brand"))


@query("f8_base_domain", rf"with {st.VARIANTS} select d, regexp_replace(d, '\.[^.]*$', '') as base from variants")
def f8(spark, d):
    return st.variants(spark, d).select("d", urls.base_domain(F.col("d")).alias("base"))


@query("f9_has_shop_path", r"""select page_id, regexp_matches(lower(replace(url, '.html', '/Cart')),
  '/cart|/checkout|/product|/products|/collections|/shop') as shop_path from pages""")
def f9(spark, d):
    return table(spark, d, "pages").select(
        "page_id", urls.has_shop_path(F.replace(F.col("url"), F.lit(".html"), F.lit("/Cart"))).alias("shop_path"))


@query("f38_valid_url", r"""select page_id, regexp_matches(url,
  '(?i)^https?://[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}(/.*)?$') as ok,
  regexp_matches(replace(url, '/en/', ':80/'), '(?i)^https?://[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}(/.*)?$') as port_ok
from pages""")
def f38(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.valid_url(url).alias("ok"), urls.valid_url(
        F.replace(url, F.lit("/en/"), F.lit(":80/"))).alias("port_ok"))


@query("f51_domain_patterns", f"""with {st.SITES}, b as (select site, 'www.' || site as w, site as s from sites)
select site,
  array_to_string([s, w, 'https://' || s, 'http://' || s, 'https://' || w, 'http://' || w, '//' || s, '//' || w,
    s || '/', w || '/'], '|') as plain,
  array_to_string(list_sort(['http%3a%2f%2f' || s, 'https%3a%2f%2f' || s, 'http%3a%2f%2f' || w,
    'https%3a%2f%2f' || w, 'http%3A%2F%2F' || s, 'https%3A%2F%2F' || s, 'http%3A%2F%2F' || w,
    'https%3A%2F%2F' || w, '%2f%2f' || s, '%2f%2f' || w, '%2F%2F' || s, '%2F%2F' || w]), '|') as encoded,
  array_to_string(list_sort(flatten(list_transform(['shop', 'blog', 'store', 'www', 'mail', 'app', 'portal', 'secure'],
    lambda x: [x || '.' || s, 'https://' || x || '.' || s, 'http://' || x || '.' || s]))), '|') as subdomains
from b""")
def f51(spark, d):
    site = F.col("site")
    return st.sites(spark, d).select(
        "site", F.array_join(urls.plain_patterns(site), "|").alias("plain"),
        F.array_join(F.array_sort(urls.encoded_patterns(site)), "|").alias("encoded"),
        F.array_join(F.array_sort(urls.subdomain_patterns(site)), "|").alias("subdomains"))


SOCIAL_URL_SQL = f"""{st.SITES}, lb as (select site, {st.LABEL_SQL} as label from sites), u as (
  select site, unnest(['https://www.instagram.com/' || label || '/?hl=en', 'https://instagram.com/p/' || label,
    'https://x.com/' || label, 'https://netflix.com/' || label, 'https://m.facebook.com/' || label || '#about',
    'https://facebook.com/groups/' || label, 'https://linkedin.com/company/' || label,
    'https://linkedin.com/company/' || label || '/posts/', 'https://youtube.com/@' || label,
    'https://youtube.com/watch', 'https://www.tiktok.com/@' || label, 'https://twitter.com/' || label || '/status/1',
    'https://' || site]) as link from lb)"""


def social_links(spark, d):
    label, site = st.label(F.col("site")), F.col("site")
    c = lambda a, b="": F.concat(F.lit(a), label, F.lit(b))
    return st.sites(spark, d).select("site", F.explode(F.array(
        c("https://www.instagram.com/", "/?hl=en"), c("https://instagram.com/p/"), c("https://x.com/"),
        c("https://netflix.com/"), c("https://m.facebook.com/", "#about"), c("https://facebook.com/groups/"),
        c("https://linkedin.com/company/"), c("https://linkedin.com/company/", "/posts/"),
        c("https://youtube.com/@"), F.lit("https://youtube.com/watch"), c("https://www.tiktok.com/@"),
        c("https://twitter.com/", "/status/1"), F.concat(F.lit("https://"), site))).alias("link"))


PLATFORM_SQL = r"""(case when regexp_matches(link, '^https?://([^/]*\.)?instagram\.com(/|$)') then 'instagram'
  when regexp_matches(link, '^https?://([^/]*\.)?(twitter|x)\.com(/|$)') then 'twitter'
  when regexp_matches(link, '^https?://([^/]*\.)?(facebook|fb)\.com(/|$)') then 'facebook'
  when regexp_matches(link, '^https?://([^/]*\.)?linkedin\.com(/|$)') then 'linkedin'
  when regexp_matches(link, '^https?://([^/]*\.)?youtube\.com(/|$)') then 'youtube'
  when regexp_matches(link, '^https?://([^/]*\.)?tiktok\.com(/|$)') then 'tiktok' end)"""


@query("f52_platform_of_url", f"with {SOCIAL_URL_SQL} select site, link, {PLATFORM_SQL} as platform from u")
def f52(spark, d):
    return social_links(spark, d).withColumn("platform", contacts.platform_of_url(F.col("link")))


@query("f53_clean_social_url", rf"""with {SOCIAL_URL_SQL}, p as (select *, {PLATFORM_SQL} as platform,
  regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', '') as bare from u)
select site, link, case
  when platform = 'linkedin' then case when regexp_matches(bare, '/company/|/in/')
    and not regexp_matches(bare || '', '/posts/|/jobs/|/feed/|/updates/') then bare end
  when platform = 'instagram' then case when not regexp_matches(bare, '/p/|/reel/|/stories/|/tv/|/explore/')
    and coalesce(string_split(bare, '/')[4], '') <> '' then bare end
  when platform = 'facebook' then case when not regexp_matches(bare,
    '/posts/|/photo|/videos/|/events/|/groups/|/watch/|/marketplace/|/people/') then bare end
  when platform = 'twitter' then case when not regexp_matches(bare, '/status/|/moments/|/lists/|/i/') then bare end
  when platform = 'youtube' then case when regexp_matches(bare, '/@|/c/|/channel/|/user/')
    and not regexp_matches(bare, '/watch|/playlist') then bare end
  when platform = 'tiktok' then case when bare like '%/@%' and bare not like '%/video/%' then bare end
  else bare end as clean from p""")
def f53(spark, d):
    link = F.col("link")
    return social_links(spark, d).select(
        "site", "link", contacts.clean_social_url(link, F.coalesce(contacts.platform_of_url(link), F.lit("other")))
        .alias("clean"))
