"""Set operations on results, link frontiers and term lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import tokenize
from orgweave.functions.urls import url_host
from orgweave.operators.writes import upsert_latest


def union_sources(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Bag union of result tables, each row tagged with its source name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn(tag, F.lit(name)) for name, df in sources.items()])


def union_vetting(approved: DataFrame, rejected: DataFrame, key: str = "domain", order: str = "seq") -> DataFrame:
    """Approved and rejected results as one table, the last result per domain winning."""
    both = approved.withColumn("status", F.lit("approved")).unionByName(
        rejected.withColumn("status", F.lit("rejected")))
    return upsert_latest(both, None, [key], order)


def new_frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct same-host link targets that were not visited yet.

    ``links`` has from_url and url (resolved, canonical), ``visited`` has url.
    """
    same_host = links.where(url_host(F.col("from_url")) == url_host(F.col("url")))
    return same_host.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def union_terms(given: Column, keywords: Column) -> Column:
    """Given terms, lower-cased keywords and their tokens, without repeats."""
    lowered = F.transform(keywords, F.lower)
    tokens = F.flatten(F.transform(keywords, tokenize))
    return F.array_union(given, F.array_union(lowered, tokens))
