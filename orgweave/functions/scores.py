"""Similarity and duplicate scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgweave.functions.text import edit_similarity, jaccard_words


def email_hosts_overlap(a: Column, b: Column) -> Column:
    """Any mail host in common."""
    hosts = lambda emails: F.transform(F.filter(emails, lambda e: e.contains("@")),
                                       lambda e: F.lower(F.get(F.split(e, "@"), F.lit(1))))
    return F.coalesce(F.arrays_overlap(hosts(a), hosts(b)), F.lit(False))


def equal_handles(a: Column, b: Column) -> Column:
    """Number of platforms with the same handle on both sides."""
    clean = lambda h: F.replace(F.trim(F.lower(h)), F.lit("@"), F.lit(""))
    same = F.filter(F.map_keys(a), lambda p: clean(F.element_at(a, p)) == clean(F.try_element_at(b, p)))
    return F.coalesce(F.size(same), F.lit(0))


def pattern_score(brand_a: Column, stem_a: Column, tld_a: Column,
                  brand_b: Column, stem_b: Column, tld_b: Column) -> Column:
    """Name similarity of two domains: 0.40, 0.35, 0.30, 0.25 or 0."""
    d = F.levenshtein(brand_a, brand_b)
    inside = (brand_a != "") & (brand_b != "") & (brand_a.contains(brand_b) | brand_b.contains(brand_a))
    return (F.when((brand_a == brand_b) & (tld_a != tld_b), F.lit(0.40)).when(stem_a == stem_b, F.lit(0.35))
            .when(d == 1, F.lit(0.35)).when(d == 2, F.lit(0.30)).when(inside, F.lit(0.25)).otherwise(F.lit(0.0)))


def homepage_score(a: Column, b: Column) -> Column:
    """Weighted page similarity of two feature structs, 0 to 0.60."""
    flag = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return (0.25 * edit_similarity(a["company_name"], b["company_name"])
            + flag(email_hosts_overlap(a["emails"], b["emails"]), 0.15)
            + 0.10 * jaccard_words(a["description"], b["description"])
            + 0.05 * edit_similarity(a["title"], b["title"])
            + 0.05 * F.least(equal_handles(a["social"], b["social"]) / F.lit(3.0), F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 when a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
