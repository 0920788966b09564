"""Profiles and products out of landed pages by a caller-supplied extractor."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.operators.filters import priority_rank
from orgweave.operators.folds import char_budget_prefix, chunk_texts, greedy_pack, page_block
from orgweave.operators.profiles import merge_profiles
from orgweave.session import cut_lineage

PROFILE = ("company string, description string, notes array<string>, main_contacts struct<email:array<string>,"
           "phone:array<string>,address:array<string>,contact_page:string>, social_media map<string,string>")

Extractor = Callable[[str], dict]


def pattern_extractor(chunk: str) -> dict:
    """Default extractor: first heading, first line, addresses and profile links of the chunk."""
    heading = re.search(r"(?m)^# (.+)$", chunk)
    body = [line for line in chunk.split("\n") if line and not line.startswith(("# ", "URL: ", "---"))]
    mails = list(dict.fromkeys(re.findall(r"[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", chunk)))
    twitter = re.search(r"twitter\.com/[A-Za-z0-9_]+", chunk)
    return {
        "company": heading.group(1) if heading else "", "description": body[0][:200] if body else "", "notes": [],
        "main_contacts": {"email": mails, "phone": [], "address": [], "contact_page": ""},
        "social_media": {"twitter": f"https://{twitter.group(0)}"} if twitter else {},
    }


def extract_profiles(pages: DataFrame, first: Column, extract: Extractor = pattern_extractor, order: str = "page_id",
                     char_limit: int | None = None, chunk_chars: int = 25_000) -> dict[str, DataFrame]:
    """Budget, order, pack, extract and merge.

    ``pages``: domain, page id, url, title, content; ``first`` flags the pages
    that go in front. The extractor sees one chunk text at a time. All pages are
    read unless a character budget per domain is given.
    """
    kept = pages if char_limit is None else char_budget_prefix(pages, F.length("content"), order, char_limit)
    block = page_block(F.col("title"), F.col("url"), F.col("content"))
    packed = greedy_pack(kept, F.length(block), order, chunk_chars, rank=priority_rank(first, order))
    chunks = chunk_texts(packed, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([extract(c) for c in pdf["chunk"]])
            yield pd.concat([pdf[["domain", "chunk_no"]].reset_index(drop=True), found], axis=1)

    # the extractor is costly and its result feeds three outputs: run it once
    profiles = cut_lineage(chunks.mapInPandas(run, f"domain string, chunk_no long, {PROFILE}"))
    return {"chunks": chunks, **merge_profiles(profiles.withColumnRenamed("chunk_no", "seq"))}
