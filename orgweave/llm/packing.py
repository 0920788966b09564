"""Best-fit packing: hierarchical residual packing of token sequences.

A document is its ids and an end id; only what is longer than a sequence is cut,
into full pieces and a last shorter one. Each partition packs its own pieces by
best fit (longest first, into the fullest bin that still takes it) and emits
the bins that are nearly full. The underfull bins go on as items: partitions
are merged ``FAN_IN`` at a time and their underfull bins best-fitted again, up
the tree, until one partition is left or a round of merging gains nothing.
A task never takes more than ``TASK_BINS`` underfull bins; as long as there are
more, they stay on several tasks.

Only lengths and places travel between the rounds. Each round is a Parquet
working table in the shared folder, so a lost executor repeats one task of one
round.

Odd input: a null or empty text is a sequence piece of one end id; null ids and
repeated rows are packed like any other row (a repeated row gets pieces of its
own); an empty table gives no rows; input columns named like a result go.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.tokens import encoder, slices, tokenizer_path
from orgweave.session import stored

CAPACITY = 2048
FAN_IN = 8
TASK_BINS = 200_000
FULL = 0.998  # share of a sequence from which a bin is emitted without another round

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, {ids}"
          "bin long, at int, filled int, emitted boolean")
BINS = "bin long, parent long, at int, filled int, emitted boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin) by best fit, longest items first."""
    order = np.argsort(-lengths, kind="stable")
    where = np.zeros(len(lengths), dtype=np.int64)
    at = np.zeros(len(lengths), dtype=np.int64)
    fills: list[int] = []
    open_bins: dict[int, list[int]] = {}  # free space -> bins
    free: list[int] = []  # the sizes of free space there are, ascending
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = bisect_left(free, n)
        if k == len(free):
            b, left = len(fills), capacity
            fills.append(0)
        else:
            left = free[k]
            bins = open_bins[left]
            b = bins.pop()
            if not bins:
                del open_bins[left]
                free.pop(k)
        where[i], at[i] = b, fills[b]
        fills[b] += n
        left -= n
        if left:
            if left not in open_bins:
                open_bins[left] = []
                insort(free, left)
            open_bins[left].append(b)
    return where, at, np.array(fills, dtype=np.int64)


def _bin_ids(level: int, partition: int, n: int) -> np.ndarray:
    """Ids no other task of any round gives: 5 bits of level, 24 of partition, 34 of bin."""
    return (np.int64(level) << 58) + (np.int64(partition) << 34) + np.arange(n, dtype=np.int64)


def cut_pieces(docs: DataFrame, capacity: int, end_id: int, full: float, path: str, keep_ids: bool) -> DataFrame:
    """Tokenise, cut and pack each partition; one row per piece."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        coder = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        doc_ids, docs_of, piece, start, length, crc, ids = [], [], [], [], [], [], []
        for pdf in batches:
            texts = pdf["text"].tolist()
            names = pdf["doc_id"].tolist()
            for part in slices(texts):
                for name, raw in zip(names[part], coder.encode(texts[part]), strict=True):
                    raw += end
                    for p, begin in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[begin:begin + 4 * capacity]
                        doc_ids.append(None if pd.isna(name) else name)
                        piece.append(p)
                        start.append(begin // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            ids.append(own)
        coder.rest()
        lengths = np.array(length, dtype=np.int64)
        where, at, fills = best_fit(lengths, capacity)
        names = _bin_ids(0, TaskContext.get().partitionId(), len(fills))
        for i in range(0, len(lengths), 10_000):
            s = slice(i, i + 10_000)
            out = pd.DataFrame({"doc_id": pd.array(doc_ids[s], dtype="Int64"), "piece": piece[s], "start": start[s],
                                "length": length[s], "ids_crc32": crc[s]})
            if keep_ids:
                out["ids"] = ids[s]
            out["bin"], out["at"], out["filled"] = names[where[s]], at[s], fills[where[s]]
            yield out.assign(emitted=out["filled"] >= full * capacity)

    schema = PIECES.format(ids="ids binary, " if keep_ids else "")
    return docs.select("doc_id", "text").mapInPandas(pack, schema)


def merge_round(bins: DataFrame, capacity: int, level: int, full: float) -> DataFrame:
    """Best-fit the bins of each partition into parents of this level."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pdf = pd.concat([pd.DataFrame({"bin": [], "filled": []}, dtype="int64"), *batches])
        where, at, fills = best_fit(pdf["filled"].to_numpy(dtype=np.int64), capacity)
        names = _bin_ids(level, TaskContext.get().partitionId(), len(fills))
        yield pd.DataFrame({"bin": pdf["bin"].to_numpy(), "parent": names[where], "at": at, "filled": fills[where],
                            "emitted": fills[where] >= full * capacity})

    return bins.mapInPandas(pack, BINS)


def _merge_tree(pieces: DataFrame, capacity: int, full: float) -> DataFrame | None:
    """(bin, sequence_id, base) of every bin that went through a merge."""
    spark = pieces.sparkSession
    # the item at the start of a bin stands for the bin: one row each, without a shuffle
    under = pieces.where("not emitted and at = 0").select("bin", "filled")
    rounds: list[DataFrame] = []
    count = under.count()
    groups = spark.sparkContext.defaultParallelism * FAN_IN
    level = 0
    while count > 1 and level < 31:
        level += 1
        groups = max(1, -(-groups // FAN_IN), -(-count // TASK_BINS))
        # merging partitions moves whole partitions to fewer tasks; a bin's place doesn't depend on a key
        packed = stored(merge_round(under.coalesce(groups), capacity, level, full), f"packing-{level}")
        rounds.append(packed)
        under = packed.where("not emitted and at = 0").select(F.col("parent").alias("bin"), "filled")
        before, count = count, under.count()
        if groups == 1 or (groups * TASK_BINS <= count + TASK_BINS and count == before):
            break
    if not rounds:
        return None
    known = rounds[-1].select("bin", F.col("parent").alias("sequence_id"), F.col("at").alias("base"))
    for packed in reversed(rounds[:-1]):
        later = known.select(F.col("bin").alias("__llm_up"), F.col("sequence_id").alias("__llm_s"),
                             F.col("base").alias("__llm_base"))
        known = packed.join(later, F.col("parent") == F.col("__llm_up"), "left").select(
            "bin", F.coalesce("__llm_s", "parent").alias("sequence_id"),
            (F.col("at") + F.coalesce("__llm_base", F.lit(0))).alias("base"))
    return known


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, full: float = FULL, path: str | None = None,
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    pieces = stored(cut_pieces(docs, capacity, end_id, full, path or tokenizer_path(), keep_ids), "packing-pieces")
    places = _merge_tree(pieces, capacity, full)
    own = [F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []))]
    if places is None:
        return pieces.select(*own, F.col("bin").alias("sequence_id"), F.col("at").cast("long").alias("offset"))
    moved = places.withColumnRenamed("bin", "__llm_bin")
    return pieces.join(moved, F.col("bin") == F.col("__llm_bin"), "left").select(
        *own, F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("base", F.lit(0))).cast("long").alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pieces packed with their ids; a sequence is at most one capacity long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
