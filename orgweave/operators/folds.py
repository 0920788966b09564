"""Ordered folds: firsts, budgets, packing, numbering and run lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.functions.text import squeeze
from orgweave.functions.urls import domain_name_key
from orgweave.partitioning import BUCKET_ROWS, first_n_per_key, id_bucket, position, running, since_last
from orgweave.session import cut_lineage


def first_per_brand(results: DataFrame, order: str = "seq") -> DataFrame:
    """First result per brand-level name; rows without a domain are dropped."""
    kept = results.where(F.coalesce("domain", F.lit("")) != "")
    return first_n_per_key(kept, [domain_name_key(F.col("domain"))], [order])


def dedup_page_content(pages: DataFrame, content: str = "content", order: str = "seq") -> DataFrame:
    """First page per (domain, content hash)."""
    hashed = pages.withColumn("content_hash", F.sha2(content, 256))
    return first_n_per_key(hashed, ["domain", "content_hash"], [order])


def dedup_queries(queries: DataFrame, order: str = "seq") -> DataFrame:
    """Whitespace-collapsed queries, first spelling per lower-case form."""
    clean = queries.withColumn("query", squeeze(F.col("query"))).where(F.col("query") != "")
    return first_n_per_key(clean, [F.lower("query")], [order])


def char_budget_prefix(pages: DataFrame, length: Column, order: str, limit: int = 500_000,
                       key: str = "domain") -> DataFrame:
    """Leading pages of each domain while their running length stays within the limit."""
    df = running(pages, [key], order, {"running_chars": ("sum", length.cast("long"))})
    return df.where(F.col("running_chars") <= limit)


def latest_per_company(drafts: DataFrame, when: str = "created_at", key: str = "company_id",
                       tie: str = "id") -> DataFrame:
    return first_n_per_key(drafts, [key], [F.col(when).desc(), F.col(tie).desc()])


def top_profiles(people: DataFrame, n: int = 3, minimum: float = 0.6, key: str = "domain") -> DataFrame:
    """Best ``n`` people per company by confidence."""
    return first_n_per_key(people.where(F.col("confidence") >= minimum), [key], [F.col("confidence").desc(), "seq"], n)


def merge_products(products: DataFrame) -> DataFrame:
    """First product per (name, price), else (name, url), else name; numbered per domain in order."""
    blank = lambda c: F.coalesce(F.trim(F.lower(c)), F.lit(""))
    name, price, url = blank("name"), blank("price"), F.coalesce(F.trim("url"), F.lit(""))
    second = F.when(price != "", price).when(url != "", url).otherwise(F.lit("no_price"))
    keyed = products.where(name != "").withColumn("_name", name).withColumn("_second", second)
    first = first_n_per_key(keyed, ["domain", "_name", "_second"], ["seq"]).drop("_name", "_second")
    return position(first, ["domain"], "seq", "_n").withColumn(
        "product_id", F.concat("domain", F.lit("_product_"), F.col("_n").cast("string"))).drop("_n")


def family_cap(queries: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` queries per family, in a seeded pseudo-random order."""
    return first_n_per_key(queries, ["family"], [F.md5(F.concat(F.lit(f"{seed}:"), "query")), F.col("query")], cap)


def chat_window(turns: DataFrame, size: int = 6, processed: str | None = None, key: str = "conv_id",
                order: str = "turn") -> DataFrame:
    """Tag turns: 'active' for the last ``size``, 'to_summarise' for older ones past the processed count."""
    numbered = position(turns, [key], order, "_pos")
    total = turns.groupBy(key).agg(F.count("*").alias("_n"))
    done = F.lit(0) if processed is None else F.col(processed)
    active = F.col("_pos") > F.col("_n") - size
    tagged = numbered.join(total, key).withColumn("part", F.when(active, F.lit("active")).when(
        F.col("_pos") > done, F.lit("to_summarise")))
    return tagged.where(F.col("part").isNotNull()).drop("_pos", "_n")


def history_desc(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    return rows.orderBy(key, F.col(when).desc(), tie)


def approved_first(vetting: DataFrame, order: str = "seq") -> DataFrame:
    return vetting.orderBy(F.col("status") == "rejected", order)


def consecutive_failures(accesses: DataFrame, source: str, success: Column, order: str, limit: int = 3) -> DataFrame:
    """Failures in a row after each access; unhealthy from ``limit`` on, healthy again after a success."""
    counted = since_last(accesses, [source], order, success, "failures")
    return counted.withColumn("healthy", F.col("failures") < limit)


def cap_results(results: DataFrame, max_results: int, order: str = "seq") -> DataFrame:
    """The first ``max_results`` distinct domains in first-seen order."""
    seen = results.groupBy("domain").agg(F.min(order).alias(order))
    return seen.orderBy(order).limit(max_results)


def cap_per_engine(results: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return first_n_per_key(results, ["engine"], [order], n)


def engine_fallback(results: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Per query the results of the first engine, in preference order, that returned any."""
    rank = F.coalesce(*[F.when(F.col("engine") == e, F.lit(i)) for i, e in enumerate(preference)])
    ranked = results.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = ranked.groupBy("query").agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, ["query", "_rank"], "left_semi").drop("_rank")


def page_block(title: Column, url: Column, content: Column) -> Column:
    """The text a page contributes to a chunk."""
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("Page")), F.lit("\nURL: "), F.coalesce(url, F.lit("")),
                    F.lit("\n\n"), F.coalesce(content, F.lit("")), F.lit("\n\n---\n\n"))


def _starts(lengths: np.ndarray, limit: int, carried: int, opened: bool) -> np.ndarray:
    """Rows that open a chunk; ``carried`` characters may come in with an open chunk."""
    ends = np.cumsum(lengths)
    starts: list[int] = []
    base, at = -carried, 0
    if not opened and len(lengths):
        starts, base, at = [0], 0, 1
    while at < len(lengths):
        # a chunk holds rows while ends - base <= limit; its first row is always taken
        following = max(int(np.searchsorted(ends, base + limit, side="right")), at)
        if following >= len(lengths):
            break
        starts.append(following)
        base, at = int(ends[following] - lengths[following]), following + 1
    return np.asarray(starts, dtype="int64")


def _bucket_function(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a bucket of pages does to a chunk that comes in from the left, as (end, count, fill) per class of fills.

    A chunk that comes in with c characters takes pages up to the first whose ``end`` is above limit - c; from there on ``count``
    chunks open, and the last one holds ``fill`` characters. Empty pages open no chunk, so there are at most limit + 2 classes.
    The chains of openings are followed by pointer doubling: after k rounds a row knows its 2**k-th next opening.
    """
    ends = np.cumsum(lengths)
    n = len(lengths)
    jump = np.maximum(np.searchsorted(ends, ends - lengths + limit, side="right"), np.arange(n) + 1)
    jumps = [np.append(jump, n)]  # row n is the end of the bucket
    while (jumps[-1][:n] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    head = min(int(np.searchsorted(ends, limit, side="right")) + 1, n)
    opens = np.flatnonzero((lengths[:head] > 0) | (np.arange(head) == 0))
    last, count = opens.copy(), np.ones(len(opens), dtype="int64")
    for k in range(len(jumps) - 1, -1, -1):
        far = jumps[k][last]
        inside = far < n
        last, count = np.where(inside, far, last), count + (inside << np.int64(k))
    return ends[opens], count, ends[-1] - ends[last] + lengths[last]


def greedy_pack(pages: DataFrame, length: Column, order: str, limit: int = 25_000, key: str = "domain",
                width: int = 4 * BUCKET_ROWS, rank: Column | None = None) -> DataFrame:
    """Number the chunks of each domain: pages in order, a page never split, at most ``limit`` characters.

    Exact and spread over tasks even when one domain holds most pages. Pages
    are numbered, cut into buckets of ``width`` and each bucket is summarised
    alone as a function of the fill a chunk comes in with: a row for every page that could be the
    first to overflow it, with how many chunks open from there and how full the last one is.
    Reading these rows in order gives each bucket's incoming state; a second pass numbers its pages.
    """
    narrow = pages.select(key, order, length.cast("long").alias("_len"), *([rank.alias("_rank")] if rank is not None else []))
    if rank is None:
        numbered = position(narrow, [key], order, "_pos")
    else:
        # pages of the second group are numbered after all of the first
        grouped = narrow.withColumn("_later", F.col("_rank.later"))
        early = grouped.groupBy(F.col(key).alias("_early_key")).agg(F.count_if(~F.col("_later")).alias("_early"))
        numbered = position(grouped, [key, "_later"], order, "_pos").join(
            early, F.col(key).eqNullSafe(F.col("_early_key"))).withColumn(
            "_pos", F.col("_pos") + F.when(F.col("_later"), F.col("_early")).otherwise(0))
    # lengths and positions are used three times: keep them, not the texts they come from
    sized = cut_lineage(numbered.select(key, order, "_pos", "_len", id_bucket(F.col("_pos") - 1, width).alias("_b")))
    kinds = dict(sized.dtypes)
    kind = kinds[key]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        lens = pdf.sort_values("_pos")["_len"].to_numpy()
        end, count, fill = _bucket_function(lens, limit)
        return pd.DataFrame({key: pdf[key].iloc[0], "_b": pdf["_b"].iloc[0], "end": end, "count": count, "fill": fill,
                             "total": int(lens.sum())})

    # only domains of more than one bucket need summaries; all others start empty
    large = sized.where("_b > 0").select(F.col(key).alias("_large")).distinct()
    summary = sized.join(large, F.col(key).eqNullSafe(F.col("_large")), "left_semi").groupBy(key, "_b").applyInPandas(
        summarise, f"{key} {kind}, _b long, end long, count long, fill long, total long")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by domain, bucket and end; of each bucket one row is picked, the others pass by
        domain, bucket, carried, chunk, opened, passed, picked = None, None, 0, 0, False, 0, True
        for pdf in batches:
            out = []
            codes = pd.factorize(pdf[key])[0]
            buckets, ends, totals = (pdf[c].to_numpy() for c in ("_b", "end", "total"))
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(buckets) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(pdf)]):
                name = None if codes[i] < 0 else pdf[key].iat[i]
                if bucket is None or (name, buckets[i]) != (domain, bucket):
                    carried += 0 if picked else passed
                    if bucket is None or name != domain:
                        carried, chunk, opened = 0, 0, False
                    domain, bucket, passed, picked = name, buckets[i], int(totals[i]), False
                    out.append((name, bucket, carried, chunk, opened))
                if not picked:
                    at = i + int(np.searchsorted(ends[i:j], limit - carried, side="right")) if opened else i
                    if at < j:
                        chunk, carried = chunk + int(pdf["count"].iat[at]), int(pdf["fill"].iat[at])
                        opened = picked = True
            yield pd.DataFrame(out, columns=[key, "_b", "_carried", "_chunk", "_opened"])

    # the summaries of a domain are read as a stream: nothing is collected, whatever the number of buckets
    entry = summary.repartition(key).sortWithinPartitions(key, "_b", "end").mapInPandas(
        walk, f"{key} {kind}, _b long, _carried long, _chunk long, _opened boolean")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted; a group may go on in the next batch, so the state outlives it
        current, carried, chunk, opened = None, 0, 0, False
        for pdf in batches:
            codes = pd.factorize(pdf[key])[0]
            buckets, lens = pdf["_b"].to_numpy(), pdf["_len"].to_numpy()
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(buckets) != 0)) + 1
            numbers = np.empty(len(pdf), dtype="int64")
            for i, j in zip([0, *cuts], [*cuts, len(pdf)]):
                group = (None if codes[i] < 0 else pdf[key].iat[i], buckets[i])
                if current is None or group != current:
                    carried, chunk, opened = (int(pdf["_carried"].iat[i]), int(pdf["_chunk"].iat[i]),
                                              bool(pdf["_opened"].iat[i]))
                    current = group
                part = lens[i:j]
                starts = _starts(part, limit, carried, opened)
                opens = np.zeros(j - i, dtype="int64")
                opens[starts] = 1
                numbers[i:j] = chunk + np.cumsum(opens)
                carried = int(part[starts[-1]:].sum()) if len(starts) else carried + int(part.sum())
                chunk, opened = int(numbers[j - 1]), True
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "_pos": pdf["_pos"], "chunk_no": numbers})

    state = entry.select(F.col(key).alias("_ek"), F.col("_b").alias("_eb"), "_carried", "_chunk", "_opened")
    ready = (sized.join(state, F.col(key).eqNullSafe(F.col("_ek")) & (F.col("_b") == F.col("_eb")), "left")
             .select(key, order, "_b", "_pos", "_len", F.coalesce("_carried", F.lit(0)).alias("_carried"),
                     F.coalesce("_chunk", F.lit(0)).alias("_chunk"), F.coalesce("_opened", F.lit(False)).alias("_opened"))
             .repartition(key, "_b").sortWithinPartitions(key, "_b", "_pos"))
    packed = ready.mapInPandas(number, f"{key} {kind}, {order} {kinds[order]}, _pos long, chunk_no long").select(
        F.col(key).alias("_nk"), F.col(order).alias("_no"), F.col("_pos").alias("page_no"), "chunk_no")
    return pages.join(packed, F.col(key).eqNullSafe(F.col("_nk")) & (F.col(order) == F.col("_no"))).drop("_nk", "_no")


def chunk_texts(packed: DataFrame, block: Column, key: str = "domain") -> DataFrame:
    """Chunk texts out of packed pages; a chunk is bounded by the pack limit (or one page)."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", F.col("_block"))))
    return packed.withColumn("_block", block).groupBy(key, "chunk_no").agg(
        F.array_join(F.transform(parts, lambda p: p["_block"]), "").alias("chunk"))
