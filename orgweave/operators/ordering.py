"""Sorted pages, clamped limits and exact top-k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orgweave.partitioning import as_columns

QUERY_BLOCK = 4096  # query vectors that travel with a task at once


def paginate(df: DataFrame, order: Sequence[str | Column], skip: int = 0, *, limit: int) -> DataFrame:
    """One page of the sorted rows; planned as a top-k, not a full sort."""
    page = df.orderBy(*as_columns(order))
    if skip:
        page = page.offset(skip)
    return page.limit(limit)


def page_to_skip(page: int, page_size: int) -> int:
    return (page - 1) * page_size


def skip_to_page(skip: int, limit: int) -> int:
    return skip // limit + 1 if limit else 1


def page_numbers(df: DataFrame, page_size: int) -> DataFrame:
    """Row total and number of pages, one row."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.ceil(total / F.lit(page_size)).cast("long").alias("total_pages"))


def clamp_limit(n: int, low: int = 1, high: int = 100) -> int:
    return max(low, min(int(n), high))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def topk_cosine(df: DataFrame, queries: Sequence[Sequence[float]], k: int, vector: str = "embedding",
                key: str = "vec_id", min_similarity: float | None = None) -> DataFrame:
    """Exact top ``k`` rows by cosine similarity for each query vector.

    The query vectors travel with the tasks, a block of them at a time. Only key
    and vector go through Python: each Arrow batch is scored with one matrix
    product and keeps its own best ``k`` per query, so the shuffle carries at
    most ``k`` rows per query and batch. The winners are then joined back to
    their rows, whose other columns stay in the JVM. Ties go to the smaller
    ``key``, which is unique. Returns ``query``, ``similarity`` and the columns
    of ``df`` except the vector.
    """
    if len(queries) > QUERY_BLOCK:
        blocks = [topk_cosine(df, queries[at:at + QUERY_BLOCK], k, vector, key, min_similarity).withColumn(
            "query", F.col("query") + at) for at in range(0, len(queries), QUERY_BLOCK)]
        return reduce(DataFrame.unionByName, blocks)
    units = _unit_rows(np.asarray(queries, dtype="float64"))
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
                           df.schema[key]])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            rows = _unit_rows(np.stack(batch[vector].to_numpy()).astype("float64"))
            sims = rows @ units.T
            keys = batch[key].to_numpy()
            for q in range(units.shape[0]):
                scores = sims[:, q]
                candidates = np.arange(len(scores))
                if min_similarity is not None:
                    candidates = candidates[scores >= min_similarity]
                # rounding before the cut keeps ties stable across batch layouts
                order = np.lexsort((keys[candidates], -np.round(scores[candidates], 12)))[:k]
                pick = candidates[order]
                yield pd.DataFrame({"query": np.full(len(pick), q, dtype="int32"), "similarity": scores[pick],
                                    key: keys[pick]})

    local = df.select(key, vector).mapInPandas(best, schema)
    w = Window.partitionBy("query").orderBy(F.round("similarity", 12).desc(), F.col(key))
    top = local.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    rest = [c for c in df.columns if c not in (key, vector)]
    if not rest:
        return top
    return top.join(df.select(key, *rest), key).select("query", "similarity", *[c for c in df.columns if c != vector])
