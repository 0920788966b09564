"""Exact top-k inner products through a pivot-distance index.

Vectors are integers, floor(1024 x) per component. One more component makes all
of them equally long, so the largest inner products are the nearest points.
Every vector is keyed by its nearest pivot and cut into rings by its distance
to it. A query knows its distance to every pivot, and by the triangle inequality
a vector in a ring [lo, hi] around a pivot at distance d is at least
max(d - hi, lo - d) away: that bounds its score. Each query searches the rings
with the best bounds first; with the k-th score found so far, all rings whose
bound is lower are never visited. The rounds go on until no ring is left, so
the result is exact whatever the pivots are.

Pivots and ring borders are fitted on at most ``sample_rows`` vectors; every
vector is indexed, and the rings' true borders are taken over all of them. The
ring table has at most ``pivots * rings`` rows; rings of many vectors are dealt
over blocks of about ``block_rows``.

Odd input: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; a shorter vector counts as filled up with zeros; a
repeated candidate row is one candidate per row, a repeated query id is one
query (its first vector in value order); other columns are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orgweave.session import stored

UNIT = 1024
SAMPLE_ROWS = 4096
PIVOTS = 32
RINGS = 8
BLOCK_ROWS = 4096
QUERY_BLOCK = 4096
FIRST_RINGS = 4

_INDEX = "vec_id long, v array<long>, pivot int, dist double, cell int"
_VISIT = "cell int, query_id long, v array<long>, least long"
_FOUND = "query_id long, vec_id long, score long"


def whole_components(vectors: DataFrame, id_col: str, vec_col: str, unit: int = UNIT) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as integers of one length."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * unit)).alias("v"))
    return own


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows as float64; exact, as all components and products stay far below 2 ** 53 (checked by the caller)."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _augmented(x: np.ndarray, reach: float) -> np.ndarray:
    """One more component, so that every row has the squared length ``reach``."""
    rest = np.sqrt(np.maximum(reach - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack([x, rest])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of a sample."""
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


@dataclass
class Geometry:
    """What a task needs to know of the index: at most ``pivots * rings`` rings."""

    width: int
    reach: float
    pivots: np.ndarray
    borders: np.ndarray
    cells: np.ndarray
    home: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest pivot, distance, cell) of each row."""
        near = _distances(_augmented(x, self.reach), self.pivots)
        home, dist = near.argmin(axis=1), near.min(axis=1)
        ring = (dist[:, None] > self.borders[home]).sum(axis=1)
        return home, dist, home * (self.borders.shape[1] + 1) + ring

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Upper bound of the score of each row of ``x`` against each ring."""
        d = _distances(np.column_stack([x, np.zeros(len(x))]), self.pivots)[:, self.home]
        far = np.maximum(np.maximum(d - self.hi, self.lo - d), 0)
        own = np.einsum("ij,ij->i", x, x)[:, None] + self.reach
        return (own - far * far) / 2 + 1e-6 * (own + 1)  # the slack covers rounding


@dataclass
class Index:
    """The keyed vectors, the rings' geometry and the number of blocks each ring is dealt over."""

    rows: DataFrame
    geometry: Geometry
    blocks: pd.DataFrame


def _sampled(vectors: DataFrame, n: int, sample_rows: int, width: int, reach: float) -> np.ndarray:
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1, sample_rows / n))
    rows = vectors.where(share).limit(sample_rows).toPandas()
    if rows.empty:
        rows = vectors.limit(1).toPandas()
    return _augmented(_matrix(rows["v"], width), reach)


def build_index(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, n_pivots: int = PIVOTS, n_rings: int = RINGS,
                block_rows: int = BLOCK_ROWS) -> Index | None:
    """Index all rows of (vec_id, v); None for no rows."""
    width, reach, n = vectors.agg(
        F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)),
        F.count("*")).first()
    if not n:
        return None
    if reach >= 2 ** 52:
        raise ValueError("components are too large for exact integer scores")
    width = max(width, 1)
    sample = _sampled(vectors, n, sample_rows, width, reach)
    pivots = choose_pivots(sample, n_pivots)
    near = _distances(sample, pivots)
    home, dist = near.argmin(axis=1), near.min(axis=1)
    parts = np.linspace(0, 1, n_rings + 1)[1:-1]
    borders = np.array([np.quantile(dist[home == p], parts) if (home == p).any() else np.zeros(n_rings - 1)
                        for p in range(len(pivots))])
    none = np.zeros(0)
    fitted = Geometry(width, reach, pivots, borders, none, none, none, none)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            home, dist, cell = fitted.keys(_matrix(pdf["v"], width))
            yield pdf.assign(pivot=home.astype("int32"), dist=dist, cell=cell.astype("int32"))

    rows = stored(vectors.mapInPandas(key, _INDEX), "pivot-index")
    # at most pivots * rings rows
    rings = rows.groupBy("cell", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"),
                                              F.count("*").alias("n")).toPandas()
    rings = rings.sort_values("cell", ignore_index=True)
    whole = Geometry(width, reach, pivots, borders, *(rings[c].to_numpy() for c in ("cell", "pivot", "lo", "hi")))
    blocks = pd.DataFrame({"cell": rings["cell"], "blocks": -(-rings["n"] // block_rows)}).astype("int32")
    return Index(rows, whole, blocks)


def _visits(index: Index, queries: DataFrame, first: int, last: int) -> DataFrame:
    """(cell, query) pairs of a round: the rings of rank first to last - 1 whose bound reaches the query's least score."""
    shape = index.geometry

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bounds = shape.bounds(_matrix(pdf["v"], shape.width))
            order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
            least = pdf["least"].to_numpy(dtype=np.float64)
            row = np.repeat(np.arange(len(pdf)), order.shape[1])
            cell = order.ravel()
            open_ = bounds[row, cell] >= least[row]
            row, cell = row[open_], cell[open_]
            yield pd.DataFrame({"cell": shape.cells[cell].astype("int32"), "query_id": pdf["query_id"].to_numpy()[row],
                                "v": pdf["v"].to_numpy()[row], "least": pdf["least"].to_numpy()[row]})

    return queries.select("query_id", "v", "least").mapInPandas(plan, _VISIT)


def _search(index: Index, visits: DataFrame, k: int, query_block: int) -> DataFrame:
    """The best k of every block for every query that visits it."""
    spark = visits.sparkSession
    width = index.geometry.width
    blocks = F.broadcast(spark.createDataFrame(index.blocks))  # a row per ring
    parts = max(1, -(-visits.select("query_id").distinct().count() // query_block))
    part_of = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    asked = visits.join(blocks, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part_of.alias("part"), "query_id", "v",
        "least")
    dealt = index.rows.join(blocks, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "v")

    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", ignore_index=True)
            x, ids = _matrix(rows["v"], width), rows["vec_id"].to_numpy()
            for at in range(0, len(queries), 512):
                q = queries.iloc[at:at + 512]
                scores = _matrix(q["v"], width) @ x.T
                for own, least, s in zip(q["query_id"].to_numpy(), q["least"].to_numpy(), scores, strict=True):
                    ok = np.flatnonzero((s >= least) & (ids != own))
                    if len(ok) > k:
                        ok = ok[np.argsort(-s[ok], kind="stable")[:k]]
                    out["query_id"].extend([own] * len(ok))
                    out["vec_id"].extend(ids[ok].tolist())
                    out["score"].extend(s[ok].astype(np.int64).tolist())
        return pd.DataFrame(out, dtype="int64")

    key = ["cell", "block", "part"]
    return dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(best, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           sample_rows: int = SAMPLE_ROWS, pivots: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS,
           query_block: int = QUERY_BLOCK, first_rings: int = FIRST_RINGS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for every row where ``queries`` holds.

    ``queries`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    own = whole_components(vectors, id_col, vec_col)
    index = build_index(own, sample_rows, pivots, rings, block_rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = index.rows.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    open_ = asked.withColumn("least", F.lit(-(2 ** 62)).cast("long"))
    found, first, width = None, 0, first_rings
    while first < len(index.blocks):
        new = _search(index, _visits(index, open_, first, first + width), k, query_block)
        found = stored(_top(new if found is None else found.select(*new.columns).union(new), k), "pivot-found")
        # a query with k results only needs rings whose bound reaches its k-th score
        least = found.where(F.col("rank") == k).select(F.col("query_id").alias("__q"), F.col("score").alias("__least"))
        open_ = asked.join(least, F.col("query_id") == F.col("__q"), "left").select(
            "query_id", "v", F.coalesce("__least", F.lit(-(2 ** 62)).cast("long")).alias("least"))
        first, width = first + width, len(index.blocks)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
