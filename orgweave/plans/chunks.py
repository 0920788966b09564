"""Text chunks for retrieval: pages, products and companies."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.functions.contacts import values_by_type
from orgweave.functions.records import company_text, product_text
from orgweave.partitioning import position

# Chunk sizes in tokens.
CHUNK_TOKENS = 800
OVERLAP_TOKENS = 150
MIN_TOKENS = 100

Tokenizer = Callable[[str], list[str]]


def blank_tokens(text: str) -> list[str]:
    """Default tokenizer: words with the blanks in front of them, so that tokens join back to the text."""
    return re.findall(r"\s*\S+", text)


def sections_of(text: str) -> list[str]:
    """Parts that begin with a header line; without headers, paragraphs."""
    headed = re.split(r"(?m)\n(?=[^\S\n]*#)", text)
    return headed if len(headed) > 1 else [p for p in map(str.strip, text.split("\n\n")) if p]


def sentences_of(section: str) -> list[str]:
    return re.split(r"(?<=\.) |\n", section)


def units_of(text: str, tokenize: Tokenizer, size: int) -> tuple[list[str], np.ndarray]:
    """The pieces that are never cut, sections or the sentences of oversize ones, and their token counts."""
    sections = sections_of(text)
    counts = [len(tokenize(s)) for s in sections]
    pieces = [(s, n) if n <= size else (p, None) for s, n in zip(sections, counts)
              for p in ([s] if n <= size else sentences_of(s))]
    return [p for p, _ in pieces], np.array([len(tokenize(p)) if n is None else n for p, n in pieces], dtype=np.int64)


def cut_points(counts: np.ndarray, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first unit, end, tokens carried over) of each chunk, by search in the running totals."""
    total = np.concatenate([[0], np.cumsum(counts)])
    cuts, start, carried = [], 0, 0
    while start < len(counts):
        fits = int(np.searchsorted(total, total[start] + size - carried, side="right")) - 1
        end = max(start + 1, fits)
        cuts.append((start, end, carried))
        carried = min(overlap, carried + int(total[end] - total[start]))
        start = end
    return cuts


def chunk_text(text: str | None, tokenize: Tokenizer = blank_tokens, size: int = CHUNK_TOKENS,
               overlap: int = OVERLAP_TOKENS, min_tokens: int = MIN_TOKENS) -> list[str]:
    """Chunks of up to ``size`` tokens; each but the first begins with the last ``overlap`` tokens of the one before.

    Token counts are taken per unit and added up.
    """
    if not text or not text.strip():
        return []
    units, counts = units_of(text, tokenize, size)
    chunks, tokens = [], []
    for start, end, carried in cut_points(counts, size, overlap):
        lead = ["".join(tokens[-carried:])] if carried else []
        chunk = "\n".join(lead + units[start:end])
        tokens = tokenize(chunk)
        if len(tokens) >= min_tokens:
            chunks.append(chunk)
    return chunks


def semantic_chunks(text: Column, tokenize: Tokenizer = blank_tokens, size: int = CHUNK_TOKENS,
                    overlap: int = OVERLAP_TOKENS, min_tokens: int = MIN_TOKENS) -> Column:
    """Array of chunk texts. The tokenizer returns string pieces that join back to the text."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(col: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(t if isinstance(t, str) else None, tokenize, size, overlap, min_tokens)
                          for t in col], index=col.index, dtype=object)
    return split(text)


def token_count(text: Column, tokenize: Tokenizer | None = None) -> Column:
    """Number of tokens; with the default tokenizer counted without leaving the JVM."""
    if tokenize is None or tokenize is blank_tokens:
        return F.regexp_count(text, F.lit(r"[^ \t\r\n\x0B\f]+"))

    @F.pandas_udf(T.IntegerType())
    def count(col: pd.Series) -> pd.Series:
        return col.map(lambda t: len(tokenize(t)) if isinstance(t, str) else 0)
    return count(text)


def number_chunks(pages: DataFrame, order: str, chunks: str = "chunks") -> DataFrame:
    """One row per chunk with page_idx, chunk_index, total_chunks and chunk_id."""
    numbered = position(pages, ["domain"], order, "_p").withColumn("page_idx", F.col("_p") - 1)
    rows = numbered.withColumn("total_chunks", F.size(chunks)).select(
        *[c for c in numbered.columns if c not in (chunks, "_p")], "total_chunks",
        F.posexplode(chunks).alias("chunk_index", "content"))
    return rows.withColumn("chunk_id", F.format_string("%s_page_%d_chunk_%d", "domain", "page_idx", "chunk_index"))


def page_chunks(pages: DataFrame, order: str = "page_id", tokenize: Tokenizer = blank_tokens, **sizes) -> DataFrame:
    """Chunks of landed pages (domain, url, title, content, depth, order column)."""
    cut = pages.withColumn("chunks", semantic_chunks(F.col("content"), tokenize, **sizes)).drop("content")
    return number_chunks(cut, order).withColumn("collection_name", F.lit("raw_pages")).withColumn(
        "content_hash", F.sha2("content", 256)).withColumn("tokens", token_count(F.col("content"), tokenize))


def _record_chunks(rows: DataFrame, tokenize: Tokenizer) -> DataFrame:
    return rows.where(F.col("content") != "").withColumn("content_hash", F.sha2("content", 256)).withColumn(
        "tokens", token_count(F.col("content"), tokenize))


def product_chunks(products: DataFrame, tokenize: Tokenizer = blank_tokens) -> DataFrame:
    """One chunk per product; rows without an external id get their position in the catalogue.

    ``products``: domain, seq, external_id, name, brand, category, description,
    specs (map), price, reviews (array), url.
    """
    numbered = position(products, ["domain"], "seq", "_n")
    generated = F.concat("domain", F.lit("_product_"), (F.col("_n") - 1).cast("string"))
    return _record_chunks(numbered.select(
        F.coalesce(F.when(F.col("external_id") != "", F.col("external_id")), generated).alias("chunk_id"), "domain",
        F.lit("products").alias("collection_name"), "url", F.col("name").alias("title"),
        product_text().alias("content")), tokenize)


def company_chunks(companies: DataFrame, tokenize: Tokenizer = blank_tokens) -> DataFrame:
    """One chunk per company. ``companies``: domain, company_name, description, notes, contacts."""
    return _record_chunks(companies.select(
        F.concat("domain", F.lit("_company")).alias("chunk_id"), "domain", F.lit("companies").alias("collection_name"),
        F.concat(F.lit("https://"), F.col("domain")).alias("url"), F.col("company_name").alias("title"),
        company_text(values_by_type(F.col("contacts"))).alias("content")), tokenize)
