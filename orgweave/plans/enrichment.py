"""Contact pipelines: search results, profile text, site pages and social profile pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions import contacts as C
from orgweave.functions import html as H
from orgweave.operators.contacts import contact_counts, dedup_contacts
from orgweave.partitioning import first_n_per_key


def _rescored(found: Column, confidence: float, source: str) -> Column:
    return F.transform(found, lambda c: F.struct(
        c["value"].alias("value"), c["type"].alias("type"), F.lit(confidence).alias("confidence"),
        c["context"].alias("context"), F.lit(source).alias("source")))


def serp_contacts(results: DataFrame, context_chars: int = 100) -> DataFrame:
    """Contacts out of search results by query_type (phone, whatsapp, linkedin).

    ``results``: seq, domain, title, snippet, url, query_type.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    df = results.withColumn("_text", text)
    none = F.array().cast(f"array<{C.CONTACT}>")
    only = lambda kind, col: F.when(F.col("query_type") == kind, F.col(col))
    in_url = F.array(F.struct(
        F.col("url").alias("value"),
        F.when(F.col("url").contains("/company/"), "linkedin_company").otherwise("linkedin_individual").alias("type"),
        F.lit(0.85).alias("confidence"), F.substring("_text", 1, context_chars).alias("context"),
        F.lit("google_search").alias("source")))
    linkedin = F.when(F.col("query_type") == "linkedin", F.when(F.col("url").contains("linkedin.com"), in_url).otherwise(
        _rescored(C.extract_linkedin(F.col("_text")), 0.7, "google_search")))
    df = (df.withColumn("_p", _rescored(C.extract_phones(only("phone", "_text"), 100), 0.7, "google_search"))
          .withColumn("_w", _rescored(C.extract_whatsapp(only("whatsapp", "_text"), only("whatsapp", "url")), 0.75,
                                      "google_search"))
          .withColumn("_l", F.coalesce(linkedin, none)))
    return df.select("seq", "domain", F.explode(F.concat(F.coalesce("_p", none), F.coalesce("_w", none), "_l"))
                     .alias("c")).select("seq", "domain", "c.*")


def enrich_profile(profiles: DataFrame, min_confidence: float = 0.6, context_chars: int = 100) -> dict[str, DataFrame]:
    """Contacts of a profile's own text and links.

    ``profiles``: domain, description, notes (array), social (map), verification
    (map of structs with is_valid). Returns normalised contact rows and a
    scored row per domain.
    """
    texts = F.filter(F.array(F.col("description"), F.array_join(F.coalesce("notes", F.array().cast("array<string>")), " ")),
                     lambda t: F.coalesce(t, F.lit("")) != "")
    rows = profiles.select("domain", F.posexplode(texts).alias("part", "text"))
    found = rows.withColumn("_p", C.extract_phones(F.col("text"))).withColumn(
        "_w", C.extract_whatsapp(F.col("text"), phones=F.col("_p")))
    flat = found.select("domain", "part", F.posexplode(F.concat("_p", "_w")).alias("at", "c")).select(
        "domain", "c.*", (F.col("part") * 1_000_000 + F.col("at")).alias("seq"))
    best = dedup_contacts(flat, ["domain"]).where(F.col("confidence") >= min_confidence)
    number = C.normalize_phone(F.col("value"))
    from_text = best.withColumn("value", number).where(C.is_valid_phone(F.col("value"))).select(
        "domain", "type", "value", "confidence", "source", F.substring("context", 1, context_chars).alias("context"))
    links = profiles.select("domain", F.explode(F.map_entries("social")).alias("e")).where(
        F.trim(F.coalesce("e.value", F.lit(""))) != "")
    socials = links.select("domain", F.col("e.key").alias("platform"), F.col("e.value").alias("url"))
    own = socials.where("platform = 'linkedin'").select(
        "domain", F.lit("linkedin_company").alias("type"), F.col("url").alias("value"), F.lit(0.95).alias("confidence"),
        F.lit("existing_profile").alias("source"), F.lit("").alias("context"))
    contacts = from_text.unionByName(own)
    mode = profiles.select("domain", C.search_mode(F.col("verification")).alias("search_mode"))
    summary = mode.join(contact_counts(contacts, socials), "domain", "left").withColumn(
        "contact_score", F.coalesce("contact_score", F.lit("low"))).withColumn(
        "notes", F.coalesce("notes", F.lit("No additional contacts found"))).fillna(0)
    return {"contacts": contacts, "socials": socials, "summary": summary}


def site_contacts(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Contacts of the landed pages of each domain, of its first ``max_pages`` if given.

    ``pages``: domain, page_id, url, page_type, html; pages are taken in
    page_id order (the scrape plan's order).
    """
    chosen = pages if max_pages is None else first_n_per_key(pages, ["domain"], ["page_id"], max_pages)
    text = H.scrape_text(F.col("html"))
    df = chosen.withColumn("_text", text)
    df = (df.withColumn("_phones", C.extract_phones(F.col("_text")))
          .withColumn("_whatsapp", C.extract_whatsapp(F.col("_text"), F.col("html"), phones=F.col("_phones"))))
    footer = F.transform(F.map_entries(H.footer_socials(F.col("html"), F.col("url"))), lambda e: F.struct(
        e["value"].alias("value"), F.concat(F.lit("social_"), e["key"]).alias("type"), F.lit(0.9).alias("confidence"),
        F.lit("footer").alias("context"), F.lit("website_footer").alias("source")))
    found = F.concat(F.col("_phones"), F.col("_whatsapp"), C.extract_linkedin(F.col("_text"), F.col("html")),
                     C.extract_social(F.col("_text"), F.col("html")), footer)
    flat = df.select("domain", "page_id", "page_type", F.posexplode(found).alias("at", "c"))
    own = F.when(F.col("c.source") == "website_footer", F.col("c.source")).otherwise(
        F.concat(F.lit("website_"), F.col("page_type")))
    return flat.select("domain", "page_id", "at", F.col("c.type").alias("type"), F.col("c.value").alias("value"),
                       C.boost_by_page(F.col("c.type"), F.col("c.confidence"), F.col("page_type")).alias("confidence"),
                       F.col("c.context").alias("context"), own.alias("source"))


def profile_page_contacts(profiles: DataFrame) -> DataFrame:
    """Phones and WhatsApp contacts of landed social profile pages.

    ``profiles``: domain, platform, html; only pages of known text platforms count.
    """
    known = profiles.where(F.col("platform").isin("instagram", "facebook", "twitter", "x"))
    df = known.withColumn("_text", H.scrape_text(F.col("html")))
    df = (df.withColumn("_p", C.extract_phones(F.col("_text"), 100))
          .withColumn("_w", C.extract_whatsapp(F.col("_text"), F.col("html"))))
    return df.select("domain", "platform", F.explode(F.concat("_p", "_w")).alias("c")).select(
        "domain", "platform", "c.type", "c.value", "c.confidence", "c.context",
        F.concat(F.lit("social_"), F.col("platform")).alias("source"))
