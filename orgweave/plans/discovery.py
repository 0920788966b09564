"""Query expansion, keyword variants and saving of discovery results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.urls import domain_name_key
from orgweave.operators.folds import dedup_queries, family_cap
from orgweave.operators.joins import alias_join
from orgweave.operators.setops import union_terms
from orgweave.operators.writes import insert_if_absent

# Query templates.
INTENTS = ["buy", "price", "sale", "clearance", "in stock", "catalog", "new arrivals", "store", "shop", "retailer",
           "distributor", "wholesale", "supplier"]
NEGATIVES = ["-site:amazon.com", "-site:ebay.com", "-site:alibaba.com", "-site:etsy.com", "-site:pinterest.com",
             "-site:facebook.com", "-site:linkedin.com", "-job", "-career", "-pdf", "-forum", "-reddit"]
PLATFORM_HINTS = ["inurl:/collections", "inurl:/product", "inurl:/products", "inurl:/shop",
                  "inurl:/wp-content/plugins/woocommerce", "site:myshopify.com", "site:bigcommerce.com",
                  "site:bigcartel.com"]
GEO_TLDS = [".co.uk", ".de", ".es", ".it", ".com.au"]
REGIONS = ["us", "uk", "de", "es", "it"]
CONTACT_TEMPLATES = {
    "lenient": [("phone", '"{company}" phone number contact'), ("whatsapp", '"{company}" whatsapp'),
                ("linkedin", '"{company}" linkedin company')],
    "aggressive": [("phone", "site:{domain} phone"), ("phone", "site:{domain} tel"),
                   ("whatsapp", "site:{domain} wa.me"), ("whatsapp", '"{company}" whatsapp business'),
                   ("linkedin", "site:linkedin.com/company {company}"), ("linkedin", "site:linkedin.com/in {company}")],
}
PLATFORM_SITES = {
    "linkedin": ["linkedin.com", "linkedin.com"],
    "instagram": ["instagram.com"],
    "facebook": ["facebook.com"],
    "twitter": ["twitter.com", "x.com"],
    "youtube": ["youtube.com", "youtube.com", "youtube.com"],
    "tiktok": ["tiktok.com"],
}
LENIENT_PLATFORMS = ["linkedin", "instagram", "facebook", "twitter"]


def _options(words: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)])


def expand_queries(variants: DataFrame, base_keywords: Sequence[str], intents: Sequence[str] = INTENTS,
                   hints: Sequence[str] = PLATFORM_HINTS, geo_tlds: Sequence[str] = GEO_TLDS,
                   regions: Sequence[str] = REGIONS, negatives: Sequence[str] = NEGATIVES,
                   per_family_cap: int | None = None, max_queries: int | None = None, seed: int = 42) -> DataFrame:
    """Search queries out of keyword variants (variant, pos) and templates.

    Templates are short fixed lists and travel as literals, so each variant is
    expanded in place. Where the caller caps families or the whole, the queries
    with the smallest seeded hashes stay; base keywords are always in the result.
    """
    v = F.col("variant")
    one = lambda words: variants.select("pos", v, F.explode(_options(words)).alias("x")).withColumn("y", F.lit(0))
    two = lambda words, more: variants.select("pos", v, F.explode(_options(words)).alias("x")).select(
        "pos", v, "x", F.explode(_options(more)).alias("y"))
    families = [(one(intents), F.concat_ws(" ", v, "x.w"), None)]
    if hints:
        families.append((one(hints), F.concat_ws(" ", v, "x.w"), None))
    families.append((one(intents[:5]), F.concat_ws(" ", "x.w", v), None))
    if geo_tlds:
        families.append((two(intents[:3], geo_tlds), F.concat(v, F.lit(" "), F.col("x.w"), F.lit(" site:"), F.col("y.w")),
                         "y.i"))
    if regions:
        families.append((two(intents[:3], regions), F.concat_ws(" ", v, "x.w", "y.w"), "y.i"))
    tail = " ".join(negatives)
    rows = None
    for number, (df, text, inner) in enumerate(families):
        full = F.concat(text, F.lit(" " + tail)) if tail else text
        order = F.struct(F.lit(number).alias("family"), F.col("pos").cast("long").alias("pos"),
                         F.col("x.i").alias("i"), (F.col(inner) if inner else F.lit(0)).alias("j"))
        part = df.select(F.lit(number).alias("family"), F.trim(full).alias("query"), order.alias("seq"))
        rows = part if rows is None else rows.unionByName(part)
    if per_family_cap is not None:
        rows = family_cap(rows, per_family_cap, seed)
    unique = dedup_queries(rows)
    if max_queries is not None:
        unique = unique.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "query")), "query").limit(max_queries)
    base = variants.sparkSession.createDataFrame([(k,) for k in base_keywords], "query string")
    added = base.join(unique.select(F.lower("query").alias("_q")), F.lower("query") == F.col("_q"), "left_anti")
    return unique.select("query").unionByName(added)


def keyword_variants(keywords: DataFrame, cache: DataFrame, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """Variants per keyword list: cached ones, else generated ones joined with the keywords and their tokens.

    ``keywords``: id, words (array). ``cache``: keyword, variants. ``generate``
    turns the combined keyword column into an array of given terms.
    """
    combined = F.array_join("words", " ")
    df = keywords.withColumn("_key", F.trim(F.lower(combined)))
    cached = cache.select(F.col("keyword").alias("_key"), F.col("variants").alias("_cached"))
    given = generate(combined) if generate else F.array().cast("array<string>")
    return df.join(cached, "_key", "left").select(
        "id", F.coalesce("_cached", union_terms(given, F.col("words"))).alias("variants"),
        F.col("_cached").isNotNull().alias("from_cache"))


def contact_queries(companies: DataFrame, mode: str = "lenient") -> DataFrame:
    """(domain, query_type, query) rows for each company (domain, company)."""
    templates = CONTACT_TEMPLATES["lenient"] + (CONTACT_TEMPLATES["aggressive"] if mode == "aggressive" else [])

    def filled(template: str) -> Column:
        text = F.replace(F.lit(template), F.lit("{company}"), F.col("company"))
        return F.replace(text, F.lit("{domain}"), F.col("domain"))

    rows = F.array(*[F.struct(F.lit(kind).alias("query_type"), filled(t).alias("query")) for kind, t in templates])
    return companies.select("domain", F.inline(rows))


def platform_queries(companies: DataFrame, mode: str = "lenient") -> DataFrame:
    """(domain, platform, query): site searches for any brand spelling (array ``variants``)."""
    names = LENIENT_PLATFORMS if mode == "lenient" else list(PLATFORM_SITES)
    any_of = F.array_join(F.transform("variants", lambda v: F.concat(F.lit('intext:"'), v, F.lit('"'))), " OR ")
    rows = F.array(*[F.struct(F.lit(p).alias("platform"), F.concat(F.lit(f"site:{s} ("), any_of, F.lit(")"))
                              .alias("query")) for p in names for s in PLATFORM_SITES[p]])
    return companies.select("domain", F.inline(rows))


def save_discovery(results: DataFrame, vetting: DataFrame, discovered: DataFrame, companies: DataFrame,
                   owner) -> dict[str, DataFrame]:
    """Save vetted results: discovered domains, aliases of known brands, new companies and five counts.

    ``results``: seq, domain, title, snippet, source. ``vetting``: domain,
    status, relevance_score. ``discovered``: domain, engine (of this query).
    ``companies``: id, owner, domain.
    """
    vetted = results.where(F.coalesce("domain", F.lit("")) != "").join(
        vetting.select("domain", "status", "relevance_score"), "domain")
    rows = vetted.select("domain", F.coalesce("source", F.lit("unknown")).alias("engine"), "seq")
    found = insert_if_absent(discovered.withColumn("seq", F.lit(None).cast("long")), rows, ["domain"], "seq").drop("seq")
    fresh = vetted.where("status = 'approved'").join(companies.select("domain"), "domain", "left_anti").withColumn(
        "owner", F.lit(owner))
    mine = companies.where(F.col("owner") == owner)
    aliases = alias_join(fresh.select("owner", "domain"), mine)
    known = mine.select(domain_name_key(F.col("domain")).alias("_key")).distinct()
    new = fresh.withColumn("_key", domain_name_key(F.col("domain"))).join(known, "_key", "left_anti").select(
        "owner", "domain", F.coalesce("title", F.lit("")).alias("company_name"),
        F.coalesce("snippet", F.lit("")).alias("description"), F.lit("discovery").alias("search_mode"),
        F.lit("approved").alias("vetting_status"), F.col("relevance_score").alias("vetting_score"),
        F.lit("not_crawled").alias("crawl_status"))
    n = lambda df, name: df.agg(F.count("*").alias(name)).scalar()
    counts = vetting.agg(
        F.count("*").alias("vetted"), F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "rejected").alias("rejected")).select(
        n(results, "total").alias("total"), "vetted", "approved", "rejected", n(new, "saved").alias("saved"))
    return {"discovered": found, "aliases": aliases, "companies": new, "counts": counts}
