"""Filters, searches, lookups and narrow projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import clip
from orgweave.functions.urls import contains_any, url_host, url_path
from orgweave.operators.ordering import clamp_limit, paginate

# Page keywords and the scrape plan's paths.
PROFILE_PAGES = ["/about", "/contact", "/team", "/company", "/who-we-are"]
PRODUCT_PAGES = ["/product", "/shop", "/collection", "/catalog", "/store", "/glove"]
CONTACT_PATHS = ["contact", "kontakt", "contacto"]
ABOUT_PATHS = ["about", "about-us"]


def filter_companies(df: DataFrame, owner=None, exclude_irrelevant: bool = False, only_embedded: bool = False,
                     crawled_only: bool = False) -> DataFrame:
    """Optional conjunctive predicates; a missing relevance is not 'irrelevant'."""
    if owner is not None:
        df = df.where(F.col("owner") == owner)
    if exclude_irrelevant:
        df = df.where(~F.col("relevance_status").eqNullSafe("irrelevant"))
    if only_embedded:
        df = df.where(F.col("embedded_at").isNotNull())
    if crawled_only:
        df = df.where(F.col("crawl_status") == "completed")
    return df


def search_regex(df: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive regex in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False))
    return df.where(hit)


def search_like(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.where(hit)


def filter_jobs(df: DataFrame, owner=None, job_type: str | None = None, status: str | None = None) -> DataFrame:
    for column, wanted in (("user_id", owner), ("job_type", job_type), ("status", status)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def filter_sends(df: DataFrame, domain: str | None = None, campaign: str | None = None,
                 since: Column | None = None) -> DataFrame:
    if domain is not None:
        df = df.where(F.col("domain") == domain)
    if campaign is not None:
        df = df.where(F.col("campaign_id") == campaign)
    if since is not None:
        df = df.where(F.col("sent_at") >= since)
    return df


def robots_filter(links: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Drop URLs the host's rules disallow for every agent.

    ``rules``: host, agent, rule (allow / disallow), prefix. A host's rules
    (one robots file) travel as one array; the longest matching prefix decides
    and allow wins a tie.
    """
    per_host = (rules.where((F.col("agent") == "*") & (F.col("prefix") != "")).groupBy(F.col("host").alias("_host"))
                .agg(F.collect_set(F.struct(F.length("prefix").alias("n"), (F.col("rule") == "allow").alias("allow"),
                                            F.col("prefix").alias("prefix"))).alias("_rules")))
    path = F.when(url_path(F.col(url)) == "", F.lit("/")).otherwise(url_path(F.col(url)))
    keyed = links.withColumn("_h", url_host(F.col(url))).withColumn("_p", path)
    joined = keyed.join(per_host, F.col("_h") == F.col("_host"), "left")
    decisive = F.array_max(F.filter("_rules", lambda r: F.col("_p").startswith(r["prefix"])))
    return joined.where(F.coalesce(decisive["allow"], F.lit(True))).drop("_h", "_p", "_host", "_rules")


def owned_rows(rows: DataFrame, companies: DataFrame, fk: str, owner, key: str = "id") -> DataFrame:
    """Rows whose parent company belongs to ``owner``."""
    mine = companies.where(F.col("owner") == owner).select(F.col(key).alias("_parent"))
    return rows.join(mine, F.col(fk) == F.col("_parent"), "left_semi")


def recent_crawls(df: DataFrame, limit: int, when: str = "crawled_at", key: str = "id") -> DataFrame:
    """Last completed crawls, newest first; the limit is forced into 1..100."""
    done = df.where((F.col("crawl_status") == "completed") & F.col(when).isNotNull())
    return paginate(done, [F.col(when).desc(), F.col(key)], limit=clamp_limit(limit))


def profile_page(url: Column, depth: Column | None = None) -> Column:
    hit = contains_any(F.lower(url), PROFILE_PAGES)
    return hit if depth is None else hit | (depth == 0)


def product_page(url: Column) -> Column:
    return contains_any(F.lower(url), PRODUCT_PAGES)


def priority_rank(flag: Column, seq: str | Column) -> Column:
    """Sort key that puts flagged pages first, each group in page order."""
    return F.struct((~flag).alias("later"), (F.col(seq) if isinstance(seq, str) else seq).alias("seq"))


def contact_page_plan(domains: DataFrame, mode: str = "lenient", max_pages: int | None = None) -> DataFrame:
    """(domain, position, url, page_type) rows to look at, in order; ``max_pages`` cuts the plan."""
    plan = [("", "homepage"), *[(f"/{p}", "contact") for p in CONTACT_PATHS]]
    if mode == "aggressive":
        plan += [*[(f"/{p}", "about") for p in ABOUT_PATHS], ("/social", "social")]
    steps = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(p).alias("path"), F.lit(t).alias("page_type"))
                      for i, (p, t) in enumerate(plan[:max_pages])])
    return domains.select("domain", F.explode(steps).alias("s")).select(
        "domain", "s.position", F.concat(F.lit("https://"), F.col("domain"), F.col("s.path")).alias("url"),
        "s.page_type")


def serp_for_platform(results: DataFrame, site: str) -> DataFrame:
    """Results on the platform that mention a brand variant (array column ``variants``)."""
    text = F.lower(F.concat_ws(" ", "url", "title", "snippet"))
    return results.where(F.lower("url").contains(site)
                         & F.exists("variants", lambda v: text.contains(F.lower(v))))


def product_cards(products: DataFrame) -> DataFrame:
    return products.select("seq", "domain", "name", "price", "category", clip(F.col("description"), 200)
                           .alias("description"))


def company_cards(companies: DataFrame) -> DataFrame:
    return companies.select("domain", "name", clip(F.col("description"), 100).alias("description"))


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def lookup_many(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows for a table of keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def children_of(df: DataFrame, fk: str, value, order: Sequence[str | Column], limit: int,
                skip: int = 0) -> DataFrame:
    return paginate(df.where(F.col(fk) == F.lit(value)), order, skip, limit=limit)


def state_sets(states: DataFrame, column: str) -> DataFrame:
    """Distinct members of an array column per domain, as rows."""
    return states.select("domain", F.explode(column).alias("member")).distinct()


def active_crawls(df: DataFrame) -> DataFrame:
    return df.where(F.col("crawl_status").isin("queued", "crawling"))
