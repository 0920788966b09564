"""Relevance vetting of discovered domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.html import relevance_text, rule_no, rule_yes
from orgweave.functions.text import ecommerce_terms, keyword_counts, relevance_score
from orgweave.functions.urls import domain_keyword_score
from orgweave.operators.writes import insert_if_absent


def fixed2(x: Column) -> Column:
    """Two decimals, rounded from the exact binary value (ties to even), for values from 0.01 to 8."""
    scaled = (x * F.lit(float(2 ** 60))).cast("bigint").cast("decimal(20,0)") * 100
    unit, half = F.lit(2 ** 60), F.lit(2 ** 59)
    q = F.floor((scaled / unit).cast("decimal(38,18)"))
    rest = scaled - q * unit
    up = (rest > half) | ((rest == half) & (q % 2 == 1))
    cents = (q + F.when(up, 1).otherwise(0)).cast("int")
    return F.format_string("%d.%02d", F.floor(cents / 100).cast("int"), cents % 100)


def vet_domains(domains: DataFrame, homepages: DataFrame, variants: list[str], min_terms: int = 1,
                min_score: float = 0.2) -> DataFrame:
    """Approve or reject each domain by shop terms and keyword relevance.

    ``homepages`` has one row per domain (domain, html). A domain without a page
    is approved on its name alone.
    """
    joined = domains.select("domain").join(homepages.select("domain", "html"), "domain", "left")
    counts = F.array(*[c.cast("long") for c in keyword_counts(F.lower(relevance_text(F.col("html"))), variants)])
    df = joined.select(
        "domain", (F.coalesce("html", F.lit("")) == "").alias("_missing"),
        domain_keyword_score(F.col("domain"), variants).alias("_name_score"),
        F.coalesce(ecommerce_terms(F.col("html")), F.array().cast("array<string>")).alias("_terms"),
        F.when(F.col("html") != "", counts).alias("_counts"))
    df = df.withColumn("_found", F.size(F.filter("_counts", lambda n: n > 0))).withColumn(
        "_total", F.aggregate("_counts", F.lit(0).cast("long"), lambda a, n: a + n))
    df = df.withColumn("_content", relevance_score(F.col("_found"), F.col("_total"), len(variants)))
    df = df.withColumn("_score", F.when(F.col("_missing"), F.col("_name_score")).otherwise(
        F.greatest("_content", "_name_score")))
    missing, name, score, n = F.col("_missing"), F.col("_name_score"), F.col("_score"), F.size("_terms")
    enough = score >= min_score
    approved = F.when(missing, enough).otherwise((n >= 1) & (n >= min_terms) & enough)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    reason = (
        F.when(missing & enough, say("Approved by domain name relevance (score: ", fixed2(name),
                                     ") - fetch failed but domain name highly relevant"))
        .when(missing, say("Could not fetch homepage (tried homepage, /products, /shop, /about) and domain name not "
                           "relevant enough (score: ", fixed2(name), ")"))
        .when(n < 1, say(f"No e-commerce indicators found (need {min_terms}, found ", n.cast("string"), ")"))
        .when(~enough, say("Low keyword relevance (content: ", fixed2(F.col("_content")), ", domain: ", fixed2(name),
                           ", combined: ", fixed2(score), f", need >= {min_score})"))
        .otherwise(say("Approved: Has e-commerce (", n.cast("string"), " keywords) and relevant content (score: ",
                       fixed2(score), F.when(name > F.col("_content"), F.lit(" (domain name boost)")).otherwise(
                           F.lit("")), ")")))
    by_name = missing & enough
    return df.select(
        "domain", F.when(approved, F.lit("approved")).otherwise(F.lit("rejected")).alias("status"), reason.alias("reason"),
        F.when(missing, enough).otherwise(n >= 1).alias("has_ecommerce"),
        F.when(by_name, F.array(F.lit("domain-name-match"))).otherwise(F.col("_terms")).alias("ecommerce_terms"),
        score.alias("relevance_score"),
        F.when(by_name, F.lit(1).cast("long")).otherwise(F.coalesce("_total", F.lit(0))).alias("keyword_mentions"))


def rule_vet(domains: DataFrame, cache: DataFrame, homepages: DataFrame) -> DataFrame:
    """yes / no / unclear per domain: cached flags first, then page rules; a missing page is a no.

    ``cache``: domain, has_cart, has_product_schema, has_platform_fp, one row per domain.
    """
    flagged = cache.select("domain", (F.col("has_cart") | F.col("has_product_schema") | F.col("has_platform_fp"))
                           .alias("_cached"))
    joined = domains.select("domain").join(flagged, "domain", "left").join(
        homepages.select("domain", "html"), "domain", "left")
    html = F.col("html")
    verdict = (F.when(F.col("_cached"), F.lit("yes")).when(F.coalesce(html, F.lit("")) == "", F.lit("no"))
               .when(rule_yes(html, F.concat(F.lit("https://"), F.col("domain"))), F.lit("yes"))
               .when(rule_no(html), F.lit("no")).otherwise(F.lit("unclear")))
    return joined.select("domain", verdict.alias("verdict"))


def revet(domains: DataFrame, homepages: DataFrame, variants: list[str], companies: DataFrame, owner, min_terms: int,
          min_score: float) -> dict[str, DataFrame]:
    """Vet again with other thresholds; approved domains that are no company yet become one."""
    vetted = vet_domains(domains, homepages, variants, min_terms, min_score)
    approved = vetted.where("status = 'approved'").select("domain", F.lit(owner).alias("owner"))
    base = companies.select("domain", "owner")
    return {"vetting": vetted, "companies": insert_if_absent(base, approved, ["domain"], "domain")}
