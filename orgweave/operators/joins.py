"""Equi, anti, as-of and nested joins between the collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.contacts import first_email
from orgweave.functions.html import jsonld_urls, page_links
from orgweave.functions.urls import domain_name_key, domain_patterns, fallback_patterns
from orgweave.partitioning import first_n_per_key, nest_pages, range_buckets, running


def crawl_status_batch(domains: DataFrame, states: DataFrame) -> DataFrame:
    """Crawl status of the requested domains; absent domains get defaults."""
    done, pages = F.coalesce("is_complete", F.lit(False)), F.coalesce("pages_crawled", F.lit(0))
    return domains.join(states, "domain", "left").select(
        "domain", done.alias("fully_crawled"), pages.alias("pages"),
        F.coalesce("n_visited", F.lit(0)).alias("visited_urls"), (~done & (pages > 0)).alias("in_progress"),
        "started_at", "completed_at")


def list_status(fully: Column, in_progress: Column, pages: Column) -> Column:
    return (F.when(fully, F.lit("completed")).when(in_progress, F.lit("crawling"))
            .when(pages > 0, F.lit("completed")).otherwise(F.lit("not_crawled")))


def company_list_status(companies: DataFrame, states: DataFrame) -> DataFrame:
    status = crawl_status_batch(companies, states)
    return status.withColumn("crawl_status", list_status(F.col("fully_crawled"), F.col("in_progress"), F.col("pages")))


def company_detail_status(companies: DataFrame, states: DataFrame) -> DataFrame:
    joined = companies.join(states, "domain", "left")
    return joined.withColumn("crawl_status", F.when(F.col("is_complete"), F.lit("completed")).when(
        F.col("pages_crawled") > 0, F.lit("crawling")).otherwise(F.lit("not_crawled"))).withColumn(
        "crawled_at", F.coalesce("completed_at", "started_at"))


def company_bundle(companies: DataFrame, products: DataFrame, fields: Sequence[str], page_size: int = 10_000) -> DataFrame:
    """Companies with their products nested, ``page_size`` products per row; at least one row per company."""
    total = products.groupBy("domain").agg(F.count("*").alias("products_extracted"))
    nested = nest_pages(products.select("domain", "seq", *fields), ["domain"], "seq", fields, page_size, "products")
    return (companies.join(total, "domain", "left").join(nested, "domain", "left")
            .withColumn("products_extracted", F.coalesce("products_extracted", F.lit(0)))
            .withColumn("page", F.coalesce("page", F.lit(0))))


def social_map(links: Column) -> Column:
    """Platform -> URL out of an array of links; the last link of a platform wins."""
    links = F.filter(links, lambda s: s["platform"].isNotNull())
    platforms = F.transform(links, lambda s: s["platform"])
    last = F.filter(links, lambda s, i: ~F.array_contains(F.slice(platforms, i + 2, F.size(links)), s["platform"]))
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["platform"], s["url"])))


def contacts_of_owner(contacts: DataFrame, companies: DataFrame, owner) -> DataFrame:
    mine = companies.where(F.col("owner") == owner).select(F.col("id").alias("company_id"))
    return contacts.join(mine, "company_id", "inner")


def vetting_lookup(results: DataFrame, vetting: DataFrame) -> DataFrame:
    return results.join(vetting, "domain", "inner")


def pending_queries(queries: DataFrame, engines: Sequence[str], cache: DataFrame) -> DataFrame:
    """(engine, query) pairs the cache has not completed."""
    pairs = queries.select("query", F.explode(F.array(*[F.lit(e) for e in engines])).alias("engine"))
    return pairs.join(cache.where(F.col("completed_at").isNotNull()).select("engine", "query").distinct(),
                      ["engine", "query"], "left_anti")


def not_crawled(domains: DataFrame, states: DataFrame) -> DataFrame:
    return domains.join(states.where("is_complete").select("domain"), "domain", "left_anti")


def not_embedded_by_hash(chunks: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Chunks whose content the collection does not hold yet."""
    on = ["domain", "collection_name", "content_hash"]
    return chunks if force else chunks.join(stored.select(*on).distinct(), on, "left_anti")


def not_embedded_by_id(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    return chunks.join(stored.select("chunk_id").distinct(), "chunk_id", "left_anti")


def embed_counts(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """New and skipped chunks per domain."""
    known = stored.select("chunk_id").distinct().withColumn("_known", F.lit(True))
    return chunks.join(known, "chunk_id", "left").groupBy("domain").agg(
        F.count_if(F.col("_known").isNull()).alias("new"), F.count_if(F.col("_known")).alias("skipped"))


def alias_join(new_domains: DataFrame, companies: DataFrame, confidence: float = 0.9) -> DataFrame:
    """New domains that share their brand-level name with a company of the same owner.

    Companies are first reduced to one per (owner, name), the earliest id.
    """
    first = first_n_per_key(companies.withColumn("_key", domain_name_key(F.col("domain"))), ["owner", "_key"], ["id"])
    known = first.select("owner", "_key", F.col("domain").alias("primary_domain"))
    return new_domains.withColumn("_key", domain_name_key(F.col("domain"))).join(known, ["owner", "_key"]).select(
        "owner", "primary_domain", F.col("domain").alias("alias_domain"), F.lit(confidence).alias("confidence"),
        F.lit("discovery_deduplication").alias("source"))


def ttl_lookup(requests: DataFrame, cache: DataFrame, key: str, at: str, cached_at: str, payload: Sequence[str],
               ttl_hours: int = 168, request_id: str = "request_id") -> DataFrame:
    """Latest cached row at or before each request; null when there is none or it is older than the TTL.

    Both sides are laid on one time line per key, one entry per point in time:
    rows stamped alike become one before they are shuffled. The line is cut into ranges of (key, time)
    with as many points as a task takes, whatever the density of a key or hour,
    and the newest cached row is carried forward within each and, one row per range and key, across them.
    """
    hit = F.struct(F.col(cached_at).alias("cached_at"), *[F.col(c).alias(c) for c in payload])
    entries = cache.select(key, F.col(cached_at).alias("_at"), hit.alias("_hit"))
    asks = requests.select(key, F.col(at).alias("_at"), F.lit(None).cast(entries.schema["_hit"].dataType).alias("_hit"))
    points = entries.unionByName(asks).groupBy(key, "_at").agg(F.max("_hit").alias("_hit"))
    dealt = range_buckets(points, [key, "_at"], "_range")
    line = running(dealt, [key], ["_at"], {"_best": ("max", F.col("_hit"))}, bucket=F.col("_range")).select(
        F.col(key).alias("_key"), F.col("_at").alias("_when"), "_best")
    found = requests.select(request_id, key, F.col(at).alias("_at")).join(
        line, F.col(key).eqNullSafe(F.col("_key")) & F.col("_at").eqNullSafe(F.col("_when")))
    fresh = F.unix_micros("_best.cached_at") >= F.unix_micros("_at") - F.lit(ttl_hours * 3600 * 1_000_000)
    return found.select(request_id, key, F.col("_at").alias(at),
                        *[F.when(fresh, F.col(f"_best.{c}")).alias(c) for c in ("cached_at", *payload)])


def history_with_counts(queries: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Latest queries with the number of domains each found."""
    latest = queries.orderBy(F.col("executed_at").desc(), F.col("query_id")).limit(limit)
    counts = found.join(latest.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(
        F.count("*").alias("domain_count"))
    return latest.join(counts, "query_id", "left").withColumn("domain_count", F.coalesce("domain_count", F.lit(0)))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _mentions(patterns: Column, texts: Column) -> Column:
    """Whether one of the texts holds one of the patterns."""
    # bound to a variable, both arrays are made once and not once per pattern
    both = F.array(F.struct(patterns.alias("patterns"), texts.alias("texts")))
    held = F.transform(both, lambda b: F.exists(b["patterns"], lambda p: F.exists(b["texts"], lambda t: t.contains(p))))
    return F.get(held, F.lit(0))


def backlink_verified(links: Column, structured: Column, page: Column, domain: Column) -> Column:
    """Does a profile page name the company's domain?

    ``links`` is the struct of page_links; hrefs and data URLs count both raw
    and URL-decoded (once more for redirect parameters), then canonical URLs,
    structured data, link texts and the page text itself.
    """
    lowered = lambda arr: F.transform(arr, F.lower)
    hrefs = lowered(links["hrefs"])
    once = F.transform(hrefs, _decoded)
    twice = F.transform(once, _decoded)
    data = lowered(links["data_urls"])
    texts = F.concat(hrefs, once, twice, data, F.transform(data, _decoded), lowered(links["meta_urls"]),
                     lowered(structured), links["link_texts"], F.array(F.lower(page)))
    return _mentions(F.concat(domain_patterns(domain), fallback_patterns(domain)), texts)


def verify_backlinks(profiles: DataFrame, name: str = "verified") -> DataFrame:
    """Add ``verified`` to landed profile pages (domain, html)."""
    parsed = profiles.withColumn("_links", page_links(F.col("html"))).withColumn("_data", jsonld_urls(F.col("html")))
    return parsed.withColumn(name, backlink_verified(F.col("_links"), F.col("_data"), F.col("html"), F.col("domain"))
                             ).drop("_links", "_data")


def team_fanout(messages: DataFrame, members: DataFrame) -> DataFrame:
    """One copy of each team message per member; works on streams with a static member table."""
    return messages.join(members.select("team_id", F.col("user_id").alias("recipient")), "team_id", "inner")


def social_fill_missing(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Per (domain, platform) the non-empty existing URL, else the first verified find (by ``seq``)."""
    first = first_n_per_key(found.where("verified"), ["domain", "platform"], ["seq"]).select(
        "domain", "platform", F.col("url").alias("_found"))
    kept = existing.where(F.trim(F.coalesce("url", F.lit(""))) != "")
    return kept.join(first, ["domain", "platform"], "full_outer").select(
        "domain", "platform", F.coalesce("url", "_found").alias("url"))


def seed_drafts(chosen: DataFrame, companies: DataFrame, owner, campaign_id: str) -> DataFrame:
    """A placeholder draft for each chosen company of the owner."""
    mine = companies.where(F.col("owner") == owner)
    return chosen.join(mine, "company_id", "inner").select(
        "company_id", "domain", F.lit(campaign_id).alias("campaign_id"), F.lit("uninitiated").alias("status"),
        F.lit("").alias("subject"), F.lit("").alias("body"), first_email(F.col("contacts")).alias("to_email"))
