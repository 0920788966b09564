"""Duplicate check of new domains against the crawled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.scores import homepage_score
from orgweave.functions.text import words
from orgweave.operators.similarity import NAME_CLASSES, name_parts, pairs_of_class
from orgweave.session import cut_lineage

ROUNDING = 1e-9  # bounds and scores add the same parts in another order


def page_sizes(features: Column) -> Column:
    """What bounds a page comparison: lengths of name and title, numbers of mail addresses, description words and handles."""
    length = lambda c: F.when(c != "", F.length(F.trim(F.lower(c))))
    return F.when(features.isNotNull(), F.struct(
        *[F.coalesce(c, F.lit(0)).alias(n) for n, c in (
            ("name", length(features["company_name"])), ("title", length(features["title"])),
            ("emails", F.size(features["emails"])), ("words", F.size(F.array_distinct(words(features["description"])))),
            ("handles", F.size(features["social"])))]))


def page_bound(a: Column, b: Column) -> Column:
    """The most that ``homepage_score`` can give two pages of these sizes (0.60 at most)."""
    def alike(part: str) -> Column:
        shorter, longer = F.least(a[part], b[part]), F.greatest(a[part], b[part])
        return F.when(shorter > 0, shorter / longer).otherwise(F.lit(0.0))

    return (0.25 * alike("name") + F.when((a["emails"] > 0) & (b["emails"] > 0), 0.15).otherwise(0.0) + 0.10 * alike("words")
            + 0.05 * alike("title") + 0.05 * F.least(F.least(a["handles"], b["handles"]) / F.lit(3.0), F.lit(1.0)))


def best_matches(new: DataFrame, crawled: DataFrame, threshold: float = 0.20) -> DataFrame:
    """(domain, matched, best): the best candidate of each new domain, as a top-1 similarity join.

    ``matched`` tells whether any crawled domain has a similar name, ``best`` is
    null or the struct (total_score, candidate, pattern_score, homepage_score)
    with the highest total, the earliest ``seq`` among equals.

    Name scores come in four classes, best first. A round finds the pairs of one
    class for the domains that are still open, compares pages only where the bound of
    the two pages' sizes lets the pair reach the domain's best total so far, and keeps one candidate per
    domain. A domain is closed when no pair of the classes left can reach its best; one without a page when it has a
    match. So what is kept between rounds is a row per domain, whatever the number of pairs.
    """
    nothing = F.lit(None).cast("struct<total_score:double,order:long,candidate:string,pattern_score:double,homepage_score:double>")
    own = new.select("domain", F.col("features").alias("_new"))
    state = cut_lineage(name_parts(new).join(own.select("domain", page_sizes(F.col("_new")).alias("sizes")), "domain")
                        .withColumns({"matched": F.lit(False), "best": nothing}))
    pages = crawled.where(F.col("features").isNotNull()).select(
        F.col("domain").alias("c_domain"), "seq", F.col("features").alias("_old"))
    old = cut_lineage(name_parts(crawled).withColumnsRenamed({c: f"c_{c}" for c in ("domain", "brand", "stem", "tld")}).join(
        pages.select("c_domain", page_sizes(F.col("_old")).alias("c_sizes")), "c_domain", "left"))
    total = F.col("best.total_score")
    for score, _ in NAME_CLASSES:
        if score < threshold:
            continue
        reach = F.coalesce(score + page_bound(F.col("sizes"), F.col("sizes")) + ROUNDING >= total, F.lit(True))
        still = state.where(F.when(F.col("sizes").isNull(), ~F.col("matched")).otherwise(reach))
        pairs = pairs_of_class(still, old, score)
        may = F.col("sizes").isNotNull() & F.col("c_sizes").isNotNull() & F.coalesce(
            score + page_bound(F.col("sizes"), F.col("c_sizes")) + ROUNDING >= total, F.lit(True))
        # pairs that can't win become one row per domain before anything is shuffled
        worth = pairs.select("domain", F.when(may, F.col("c_domain")).alias("c_domain")).distinct()
        page = homepage_score(F.col("_new"), F.col("_old"))
        compared = worth.join(own, "domain").join(pages, "c_domain", "left").withColumn(
            "page", F.when(F.col("_old").isNotNull(), page))
        found = compared.groupBy("domain").agg(F.max(F.when(F.col("page").isNotNull(), F.struct(
            (score + F.col("page")).alias("total_score"), (-F.col("seq")).cast("long").alias("order"),
            F.col("c_domain").alias("candidate"), F.lit(score).alias("pattern_score"),
            F.col("page").alias("homepage_score")))).alias("found"))
        state = cut_lineage(state.join(found.withColumn("hit", F.lit(True)), "domain", "left").withColumns({
            "matched": F.col("matched") | F.col("hit").isNotNull(),
            "best": F.greatest("best", "found")}).drop("found", "hit"))
    return state.select("domain", "matched", F.when(F.col("best").isNotNull(), F.col("best").dropFields("order")).alias("best"))


def duplicate_check(new: DataFrame, crawled: DataFrame, pattern_threshold: float = 0.20,
                    duplicate_threshold: float = 0.70) -> DataFrame:
    """UNIQUE or DUPLICATE per new domain.

    ``new``: domain, features (homepage features struct, null when the page is
    missing). ``crawled``: domain, seq, features; rows without features are
    no candidates for the page comparison. Cheap name scores come first, pages
    are compared only for pairs that can still be a domain's best.
    """
    best = best_matches(new, crawled, pattern_threshold)
    any_crawled = crawled.agg((F.count("*") > 0).alias("any")).scalar()
    joined = new.join(best, "domain", "left")
    total = F.col("best.total_score")
    duplicate = F.coalesce(total >= duplicate_threshold, F.lit(False))
    return joined.select(
        "domain", F.when(duplicate, F.lit("DUPLICATE")).otherwise(F.lit("UNIQUE")).alias("status"),
        F.when(duplicate, F.lit("skip")).otherwise(F.lit("crawl")).alias("action"),
        F.when(duplicate, F.col("best.candidate")).alias("primary_domain"),
        F.when(~any_crawled, F.lit("First domain to be crawled"))
        .when(~F.coalesce("matched", F.lit(False)), F.lit("No pattern matches found"))
        .when(F.col("features").isNull(), F.lit("Could not fetch homepage for comparison")).alias("reason"),
        F.col("best.pattern_score"), F.col("best.homepage_score"), total.alias("total_score"),
        F.col("features.company_name").alias("new_company_name"), F.col("features.emails").alias("new_emails"),
        F.col("features.social").alias("new_social"))
