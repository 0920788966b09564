"""Skew-safe building blocks shared by the operators.

A single key may hold a third of all rows, so nothing here puts one key's rows
into one task: firsts and top-n are cut on the map side before the shuffle,
running values are computed per bounded bucket and stitched with bucket totals,
and nested output is paged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orgweave.session import cut_lineage

BUCKET_ROWS = 65_536
BUCKETS_TOGETHER = 1 << 24  # bucket totals that are carried over together: few, even where ids are sparse


def as_columns(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def first_n_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column],
                    n: int = 1) -> DataFrame:
    """First ``n`` rows per key in ``order``.

    A ``row_number() <= n`` filter is planned as a partial group limit in
    front of the exchange, so each map task forwards at most ``n`` rows a key.
    """
    w = Window.partitionBy(*as_columns(keys)).orderBy(*as_columns(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def id_bucket(col: str | Column, width: int = BUCKET_ROWS) -> Column:
    """Bucket of a unique integer order column: at most ``width`` rows each."""
    col = F.col(col) if isinstance(col, str) else col
    return F.call_function("div", col.cast("long"), F.lit(width).cast("long"))


_COMBINE = {
    "sum": (F.sum, lambda offset, local: F.coalesce(offset, F.lit(0)) + F.coalesce(local, F.lit(0))),
    "max": (F.max, lambda offset, local: F.greatest(offset, local)),
    "min": (F.min, lambda offset, local: F.least(offset, local)),
}


def range_buckets(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Add an integer bucket that grows with ``order``, by range partitioning; the rows are kept in the shared folder.

    Spark takes the borders from quantiles of a sample, so a bucket holds what one task takes, however
    dense or sparse the values are. Equal rows share a bucket: make the order columns unique where they may be many.
    """
    dealt = df.repartitionByRange(*as_columns(order))
    return cut_lineage(dealt.withColumn(name, F.spark_partition_id().cast("long")))


def running(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], values: dict[str, tuple[str, Column]],
            width: int = BUCKET_ROWS, bucket: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Add running aggregates along ``order`` within ``keys``.

    ``order`` is a unique integer column, or several columns together with an
    integer ``bucket`` expression that grows with them. ``values`` maps an
    output name to ``(kind, expression)`` with kind sum, max or min; the running
    value includes the current row unless ``inclusive`` is false. Rows are windowed per (keys, bucket); the
    bucket totals, one row per bucket, carry the running value across buckets.
    Buckets may be many (sparse ids fill one each), so their totals are carried
    the same way, a bounded number of buckets at a time.
    """
    order = [order] if isinstance(order, str) else list(order)
    own = id_bucket(order[0], width) if bucket is None else bucket.cast("long")
    together = BUCKETS_TOGETHER if bucket is None else width
    return _running(df, list(keys), order, values, own, 2, together, Window.currentRow if inclusive else -1)


def _null_safe(df: DataFrame, keys: list[str], depth: int) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with key columns without nulls: null keys go with a flag, so that a join on them is a plain equality.

    Returns the columns that stand for the keys, and those that were added.
    """
    nullable = [k for k in keys if df.schema[k].nullable]
    flags = {k: f"_n{depth}_{i}" for i, k in enumerate(nullable)}
    filled = {k: f"_f{depth}_{i}" for i, k in enumerate(nullable)}
    kinds = dict(df.dtypes)
    for k in nullable:
        blank = F.lit("") if kinds[k] == "string" else F.lit(0).cast(kinds[k])
        df = df.withColumns({flags[k]: F.col(k).isNull(), filled[k]: F.coalesce(F.col(k), blank)})
    return df, [filled.get(k, k) for k in keys] + list(flags.values()), [*flags.values(), *filled.values()]


def _running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], bucket: Column,
             depth: int, width: int, last: int) -> DataFrame:
    # helper columns carry the depth in their names: the totals go through here once more
    here, there = f"_bucket{depth}", f"_b{depth}"
    own = {n: f"_v{depth}_{n}" for n in values}
    local_names = {n: f"_l{depth}_{n}" for n in values}
    before_names = {n: f"_o{depth}_{n}" for n in values}
    df = df.withColumn(here, bucket)
    # the join below is on the columns the window is partitioned by, so the rows are shuffled and sorted once
    df, parts, added = _null_safe(df, keys, depth)
    for n, (_, expr) in values.items():
        df = df.withColumn(own[n], expr)
    names = [f"_k{depth}_{i}" for i in range(len(parts))]
    totals = df.groupBy(*[F.col(c).alias(a) for c, a in zip(parts, names)], F.col(here).alias(there)).agg(
        *[_COMBINE[kind][0](own[n]).alias(f"_t{depth}_{n}") for n, (kind, _) in values.items()])
    carried = {before_names[n]: (kind, F.col(f"_t{depth}_{n}")) for n, (kind, _) in values.items()}
    if depth > 1:
        offsets = _running(totals, names, [there], carried, id_bucket(there, width), depth - 1, width, -1).select(
            *names, there, *carried)
    else:
        before = Window.partitionBy(*names).orderBy(there).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*names, there, *[_COMBINE[kind][0](expr).over(before).alias(name)
                                                 for name, (kind, expr) in carried.items()])
    window = Window.partitionBy(*parts, here).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    for n, (kind, _) in values.items():
        df = df.withColumn(local_names[n], _COMBINE[kind][0](own[n]).over(window))
    on = [F.col(c) == F.col(a) for c, a in zip(parts, names)] + [F.col(here) == F.col(there)]
    joined = df.join(offsets, on, "inner")
    for n, (kind, _) in values.items():
        joined = joined.withColumn(n, _COMBINE[kind][1](F.col(before_names[n]), F.col(local_names[n])))
    return joined.drop(here, there, *names, *added, *own.values(), *local_names.values(),
                       *before_names.values())


def since_last(df: DataFrame, keys: Sequence[str], order: str, condition: Column, name: str,
               width: int = BUCKET_ROWS) -> DataFrame:
    """Add the number of rows since the last one with ``condition`` (0 there), or since the start of the key.

    ``order`` is a unique integer column. The summary of a stretch of rows is (rows, place of the last hit), which
    merges from left to right: places move by the rows before them, the later one counts. Each bucket is summarised
    alone, the summaries are merged along their buckets, and the rows are moved once.
    """
    here, there, count, place, hit = "_since_b", "_since_t", "_since_n", "_since_p", "_since_hit"
    keys = list(keys)
    df, parts, added = _null_safe(df.withColumns({here: id_bucket(order, width), hit: condition}), keys, 9)
    names = [f"_since_k{i}" for i in range(len(parts))]

    def placed(rows: DataFrame) -> DataFrame:
        own = Window.partitionBy(*parts, here).orderBy(order)
        return rows.withColumn(count, F.row_number().over(own).cast("long")).withColumn(place, F.max(F.when(
            F.col(hit), F.col(count))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    # the summaries need the order and the hits only; they are used several times, so they are kept
    totals = cut_lineage(placed(df.select(*parts, here, order, hit)).groupBy(
        *[F.col(c).alias(a) for c, a in zip(parts, names)], F.col(here).alias(there)).agg(
        F.max(count).alias("_since_rows"), F.max(place).alias("_since_last")))
    carried = lambda rows, new: _running(rows, names, [there], new, id_bucket(there, BUCKETS_TOGETHER), 1, BUCKETS_TOGETHER, -1)
    before = carried(totals, {"_since_before": ("sum", F.col("_since_rows"))})
    before = carried(before, {"_since_hit_before": ("max", F.col("_since_before") + F.col("_since_last"))}).select(
        *names, there, "_since_before", "_since_hit_before")
    on = [F.col(c) == F.col(a) for c, a in zip(parts, names)] + [F.col(here) == F.col(there)]
    joined = placed(df).join(before, on, "inner")
    at = F.col("_since_before") + F.col(count)
    last = F.coalesce(F.col("_since_before") + F.col(place), "_since_hit_before", F.lit(0))
    return joined.withColumn(name, at - last).drop(
        here, there, count, place, hit, *names, *added, "_since_before", "_since_hit_before")


def position(df: DataFrame, keys: Sequence[str], order: str, name: str = "position",
             width: int = BUCKET_ROWS) -> DataFrame:
    """1-based position of each row within ``keys`` along the unique ``order``."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, width)


def nest_pages(df: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str | Column],
               page_size: int = 10_000, name: str = "items") -> DataFrame:
    """Nest rows as arrays of structs, one output row per (keys, page).

    A page holds at most ``page_size`` items in ``order``; all pages of a key
    together hold all of its rows.
    """
    numbered = position(df, keys, order, "_pos")
    return (
        numbered.withColumn("page", F.floor((F.col("_pos") - 1) / page_size).cast("int"))
        .groupBy(*keys, "page")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_pos"), F.struct(*as_columns(payload)).alias("item"))))
             .alias("_list"))
        .withColumn(name, F.transform("_list", lambda s: s["item"]))
        .drop("_list")
    )
