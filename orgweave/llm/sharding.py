"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are laid out in one global order (hash of the text, then a hash of the id,
then the id), which deals texts evenly over hash buckets and keeps equal texts
next to each other. Each bucket sums its own rows, the bucket totals are summed
once more (one row per bucket, ``BUCKETS`` in all), and the two give every row
its global offset in bytes and rows without a global sort. Cutting the offsets
at equal targets gives contiguous shards of near equal size.

A text with so many copies that they would span ``BUCKETS`` rows of a cell is
split by ``SPREAD`` id hashes, so no task holds more than its part of them.
Copies of a text stay in one shard as long as together they are smaller than
``whole_groups`` of a shard; larger groups are cut like any other rows.

Odd input: a null text has no bytes; null ids go first within their text;
repeated rows each get a slot of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orgweave.llm.common import without

BUCKETS = 4096
SPREAD = 1024
RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]

_GROUP = ["__llm_hash", "text_crc32", "size"]
_CELL = [*_GROUP, "__llm_sub"]


def byte_size(text: Column, overhead: int = 8) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + overhead


def _running(value: str, keys: list[str], order: list[str]) -> Column:
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0).cast("long"))


def _shard_of(offset: Column, n_shards: int) -> Column:
    """Shard that holds the byte at ``offset`` of ``__llm_total``."""
    at = F.call_function("div", offset * n_shards, F.greatest(F.col("__llm_total"), F.lit(1)))
    return F.least(at, F.lit(n_shards - 1)).cast("int")


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 8, whole_groups: float = 0.1) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = without(docs, RESULTS).withColumns({
        "size": byte_size(F.col(text_col), overhead), "text_crc32": F.crc32(text.cast("binary")),
        "__llm_hash": F.xxhash64(text), "__llm_sub": F.pmod(F.xxhash64(F.col(id_col)), F.lit(SPREAD)).cast("int")})
    # one shuffle on the cell serves both the rows' ranks and the cells' counts
    cell = W.partitionBy(*_CELL)
    ranked = rows.withColumn("__llm_rank", F.row_number().over(cell.orderBy(F.col(id_col))) - 1).withColumn(
        "__llm_n", F.count("*").over(cell))
    cells = ranked.where("__llm_rank = 0").select(*_CELL, F.col("__llm_n").alias("__llm_count")).withColumns({
        "__llm_bucket": F.shiftrightunsigned("__llm_hash", 52).cast("int"),
        "__llm_bytes": F.col("__llm_count") * F.col("size")})
    totals = cells.groupBy(F.col("__llm_bucket").alias("__llm_b")).agg(
        F.sum("__llm_count").alias("__llm_bn"), F.sum("__llm_bytes").alias("__llm_bb"))
    # at most BUCKETS rows: the only step without a key
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select("__llm_b", _running("__llm_bn", [], ["__llm_b"]).alias("__llm_n0"),
                            _running("__llm_bb", [], ["__llm_b"]).alias("__llm_b0"),
                            F.sum("__llm_bb").over(every).alias("__llm_total"))
    order = ["__llm_hash", "text_crc32", "size", "__llm_sub"]
    group = W.partitionBy("__llm_bucket", *_GROUP)
    placed = cells.withColumns({
        "__llm_rows0": _running("__llm_count", ["__llm_bucket"], order),
        "__llm_bytes0": _running("__llm_bytes", ["__llm_bucket"], order),
    }).withColumns({"__llm_first": F.min("__llm_bytes0").over(group), "__llm_all": F.sum("__llm_bytes").over(group)})
    placed = placed.join(F.broadcast(offsets), F.col("__llm_bucket") == F.col("__llm_b")).select(
        *_CELL, (F.col("__llm_rows0") + F.col("__llm_n0")).alias("__llm_row0"),
        (F.col("__llm_bytes0") + F.col("__llm_b0")).alias("__llm_byte0"),
        (F.col("__llm_first") + F.col("__llm_b0")).alias("__llm_group0"), "__llm_all", "__llm_total")
    at = ranked.join(placed, _CELL).withColumn("__llm_row", F.col("__llm_row0") + F.col("__llm_rank"))
    own = F.col("__llm_byte0") + F.col("__llm_rank") * F.col("size") + F.call_function("div", F.col("size"), F.lit(2))
    whole = F.col("__llm_all") * n_shards <= F.lit(whole_groups) * F.col("__llm_total")
    middle = F.col("__llm_group0") + F.call_function("div", F.col("__llm_all"), F.lit(2))
    at = at.withColumn("shard", _shard_of(F.when(whole, middle).otherwise(own), n_shards))
    # at most n_shards rows
    starts = at.groupBy(F.col("shard").alias("__llm_shard")).agg(F.min("__llm_row").alias("__llm_start"))
    out = at.join(F.broadcast(starts), F.col("shard") == F.col("__llm_shard")).withColumns({
        "slot": F.col("__llm_row") - F.col("__llm_start"), "law": F.lit("bytes"),
        "grown_shard": F.lit(None).cast("int")})
    kept = [c for c in without(docs, RESULTS).columns]
    return out.select(*[F.col(f"`{c}`") for c in kept], *RESULTS)


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **options) -> None:
    """Write one folder per shard, each sorted by slot; a shard takes as many files as tasks hold rows of it."""
    placed = shard_by_bytes(docs, n_shards, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
