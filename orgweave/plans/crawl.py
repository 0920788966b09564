"""Breadth-first walks over landed pages and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.urls import canonical_url, has_page_extension, resolve_url, url_host
from orgweave.operators.filters import robots_filter
from orgweave.operators.joins import not_crawled
from orgweave.partitioning import first_n_per_key, id_bucket, running
from orgweave.session import cut_lineage


def link_edges(pages: DataFrame, hrefs: Column) -> DataFrame:
    """(from_url, url, pos): canonical same-host links of each landed page, first position each."""
    rows = pages.select(F.col("url").alias("_page"), F.posexplode(hrefs).alias("pos", "_href"))
    resolved = rows.where(F.coalesce("_href", F.lit("")) != "").select(
        canonical_url(F.col("_page")).alias("from_url"),
        canonical_url(resolve_url(F.col("_page"), F.col("_href"))).alias("url"), "pos")
    return resolved.where(url_host(F.col("from_url")) == url_host(F.col("url"))).groupBy("from_url", "url").agg(
        F.min("pos").alias("pos"))


def link_bfs(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, max_pages: int | None = None,
             visited: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Visit order of a breadth-first walk from each seed: (domain, url, depth, position).

    ``seeds``: domain, url. ``edges``: from_url, url, pos. ``visited``: domain,
    url of earlier walks; they count towards ``max_pages``, if that is given, and
    are not walked again. One join and one anti join per level; a level is ordered by the
    position of the page that links first, then by the link's place on it, as a
    queue would. Each level is checkpointed, so plans do not grow with depth and
    a lost executor costs one level.
    """
    def allowed(df: DataFrame) -> DataFrame:
        df = df.where(has_page_extension(F.col("url")))
        return robots_filter(df, rules) if rules is not None else df

    # the links are read at every level: keep them, not the pages they are parsed from
    edges = cut_lineage(edges.select("from_url", "url", "pos"))
    none = seeds.select("domain", canonical_url(F.col("url")).alias("url")).limit(0)
    before = none if visited is None else visited.select("domain", "url").distinct()
    spent = before.groupBy("domain").agg(F.count("*").alias("_spent"))
    start = allowed(seeds.select("domain", canonical_url(F.col("url")).alias("url")).distinct())
    start = start.join(before, ["domain", "url"], "left_anti").join(spent, "domain", "left")
    room = F.lit(True) if max_pages is None else F.coalesce("_spent", F.lit(0)) < max_pages
    level = start.where(room).select(
        "domain", "url", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("position"))
    level = cut_lineage(level)
    done = level
    for depth in range(1, max_depth + 1):
        found = level.select("domain", F.col("url").alias("from_url"), F.col("position").alias("_from")).join(
            edges, "from_url").groupBy("domain", "url").agg(F.min(F.struct("_from", "pos")).alias("_order"))
        seen = done.select("domain", "url").unionByName(before)
        fresh = allowed(found).join(seen, ["domain", "url"], "left_anti")
        used = done.groupBy("domain").agg(F.max("position").alias("_used"))
        if max_pages is not None:
            # at most max_pages rows per domain are ranked; the rest cannot be visited
            fresh = first_n_per_key(fresh, ["domain"], ["_order", "url"], max_pages)
        # ranks are counted per run of linking pages, so one domain's level is no single task
        fresh = fresh.select("domain", "url", "_order._from", "_order.pos")
        ranked = running(fresh, ["domain"], ["_from", "pos", "url"], {"_rank": ("sum", F.lit(1).cast("long"))},
                         bucket=id_bucket("_from", 1024)).join(used, "domain").withColumn(
            "position", F.col("_used") + F.col("_rank"))
        if max_pages is not None:
            ranked = ranked.join(spent, "domain", "left").where(
                F.col("position") + F.coalesce("_spent", F.lit(0)) <= max_pages)
        level = ranked.select("domain", "url", F.lit(depth).alias("depth"), "position")
        level = cut_lineage(level)
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done


def crawl_all(seeds: DataFrame, edges: DataFrame, pages: DataFrame, states: DataFrame | None = None,
              max_depth: int = 2, max_pages: int | None = None, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Walk all seeds not crawled yet; result rows per domain and totals.

    ``pages``: url, content_hash of the landed pages; a page whose content was
    already met in its domain is visited but not counted.
    """
    todo = seeds if states is None else not_crawled(seeds, states)
    walk = link_bfs(todo, edges, max_depth, max_pages, rules=rules)
    landed = pages.select(canonical_url(F.col("url")).alias("url"), "content_hash").distinct()
    results = walk.join(landed, "url", "left").groupBy("domain").agg(
        F.countDistinct("url").alias("urls_visited"), F.countDistinct("content_hash").alias("pages_crawled"))
    summary = results.agg(F.count("*").alias("crawled_domains"), F.sum("pages_crawled").alias("total_pages"))
    total = seeds.agg(F.count("*").alias("n"))
    left = todo.agg(F.count("*").alias("n"))
    totals = summary.select(total.scalar().alias("total_domains"), "crawled_domains",
                            (total.scalar() - left.scalar()).alias("skipped_domains"), "total_pages")
    return {"visits": walk, "results": results, "summary": totals}
