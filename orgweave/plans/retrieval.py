"""Embedding of chunks and exact retrieval over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.operators.joins import not_embedded_by_hash
from orgweave.operators.ordering import topk_cosine
from orgweave.operators.writes import upsert_latest
from orgweave.session import arrow_rows, cut_lineage

BATCH_SIZE = 100
TEXT_ROWS = 500  # whole texts that a worker holds at a time where chunks are made and embedded

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed word hashing, for tests and dry runs; a null text is an empty one."""
    from zlib import crc32
    out = np.zeros((len(texts), dim), dtype="float32")
    for row, text in enumerate(texts):
        h = np.array([crc32(word.encode()) for word in (text or "").lower().split()], dtype=np.int64)
        out[row] = np.bincount(h % dim, np.where(h & 0x10000, 1.0, -1.0), dim)
    return out


def embed_batches(chunks: DataFrame, embed: Embedder = hashing_embedder, text: str = "content",
                  batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add ``embedding``; the function gets lists of at most ``batch_size`` texts."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at:at + batch_size].copy()
                part["embedding"] = [np.asarray(vec, dtype="float32") for vec in embed(part[text].tolist())]
                yield part

    return chunks.mapInPandas(run, schema)


def retrieve(embeddings: DataFrame, query: Sequence[float], top_k: int = 5, collections: Sequence[str] | None = None,
             filters: dict[str, str] | None = None, min_similarity: float = 0.0, key: str = "chunk_id",
             vector: str = "embedding") -> DataFrame:
    """Nearest chunks with similarity and distance; filters apply before the scan is scored."""
    if collections is not None:
        embeddings = embeddings.where(F.col("collection_name").isin(list(collections)))
    for name, value in (filters or {}).items():
        column = F.col(name) if name in embeddings.columns else F.col("metadata")[name]
        embeddings = embeddings.where(column == value)
    hits = topk_cosine(embeddings, [query], top_k, vector, key, min_similarity)
    return hits.withColumn("distance", 1.0 - F.col("similarity")).drop("query")


def competitors(embeddings: DataFrame, query: Sequence[float], own_domain: str, top_k: int = 5,
                collection: str = "companies") -> DataFrame:
    """The ``top_k`` nearest company chunks of other domains: domain, company, best similarity and distance."""
    others = embeddings.where(F.col("domain") != own_domain)
    hits = retrieve(others, query, top_k, [collection])
    best = F.struct("similarity", F.col("metadata")["company"].alias("company"))
    return hits.groupBy("domain").agg(F.max(best).alias("b"), F.min("distance").alias("distance")).select(
        "domain", "b.company", "b.similarity", "distance")


def context_block(hits: DataFrame, numbered: bool = True) -> DataFrame:
    """One text out of retrieved chunks (a top-k result), best first."""
    source = F.concat(F.lit("["), F.col("collection_name"), F.lit("] "), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("rank"), "chunk_id", "collection_name",
                                                 "domain", "url", "content", source.alias("plain"))))
    def block(p, i):
        tag = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f" {label}: "), v)).otherwise(F.lit(""))
        return F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), p["collection_name"], F.lit("]"),
                        tag("Domain", p["domain"]), tag("URL", p["url"]), F.lit("\n"), p["content"])
    text = (F.array_join(F.transform(parts, block), "\n\n---\n\n") if numbered
            else F.array_join(F.transform(parts, lambda p: p["plain"]), "\n\n"))
    return hits.agg(text.alias("context"))


def embed_domain(chunk_tables: Sequence[DataFrame], stored: DataFrame, embed: Embedder = hashing_embedder,
                 force: bool = False) -> dict[str, DataFrame]:
    """Embed the chunks whose content is not stored yet and upsert them by chunk id.

    ``chunk_tables`` share chunk_id, domain, collection_name, content,
    content_hash, tokens; ``stored`` adds embedding. Returns the new table and
    new / skipped counts per domain and collection.
    """
    shared = ["chunk_id", "domain", "collection_name", "content", "content_hash", "tokens"]
    # chunking and embedding are costly and both feed the table and the counts: run each once
    with arrow_rows(stored.sparkSession, TEXT_ROWS):
        chunks = cut_lineage(reduce(lambda a, b: a.unionByName(b), [t.select(*shared) for t in chunk_tables]))
        todo = not_embedded_by_hash(chunks, stored, force)
        embedded = cut_lineage(embed_batches(todo, embed))
    table = upsert_latest(stored.select(*shared, "embedding").withColumn("_at", F.lit(0)),
                          embedded.withColumn("_at", F.lit(1)), ["chunk_id"], "_at").drop("_at")
    keys = ["domain", "collection_name"]
    new = embedded.groupBy(*keys).agg(F.count("*").alias("new_embeddings"))
    stats = chunks.groupBy(*keys).agg(F.count("*").alias("_n")).join(new, keys, "left").select(
        *keys, F.coalesce("new_embeddings", F.lit(0)).alias("new_embeddings"),
        (F.col("_n") - F.coalesce("new_embeddings", F.lit(0))).alias("skipped_embeddings"))
    return {"embeddings": table, "stats": stats}
