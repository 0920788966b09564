"""An index of contents already stored: sorted runs with Bloom filters, merged in levels.

Every batch adds a run: the keys of its new contents, dealt over parts by their
first bits so that a part holds about ``PART_KEYS`` keys whatever the size of
the run, and one Bloom filter per part. When ``FAN`` runs of a level are there, they
become one run of the next level, so a store of n batches has at most ``FAN - 1``
runs on each of its log(n) levels.

A look-up reads the filters of the parts its keys fall into, and then the keys of the parts
whose filters let one of them through: what it reads grows with the batch and with the repeats in it, hardly with the store.

Which runs are live follows from the number of batches alone (its digits to
base ``FAN``), so there is no list of runs to keep consistent: a batch that is run again after a
failure writes the same folders again. Runs that a merge has replaced are deleted when the
next batch begins, which proves that the merging batch is through. A run that is missing, as in a store
written before it had an index, is made anew from the stored rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.session import delete_path, has_path

FAN = 8
PART_KEYS = 1 << 20
BITS_PER_KEY, HASHES = 10, 7  # about one key in a hundred passes a filter by chance


def content_key(*parts: str) -> Column:
    """16 bytes for a tuple of columns; nulls differ from empty strings."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(p).cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat_ws("\0", *marked)))


def live_runs(batches: int, fan: int = FAN) -> list[tuple[int, int, int]]:
    """(level, first batch, end) of the runs that cover ``batches`` batches, oldest first."""
    runs, at = [], 0
    level = 0
    while fan ** (level + 1) <= batches:
        level += 1
    for k in range(level, -1, -1):
        for _ in range((batches - at) // fan ** k):
            runs.append((k, at, at + fan ** k))
            at += fan ** k
    return runs


def run_name(run: tuple[int, int, int]) -> str:
    return "L{}-{}-{}".format(*run)


def _part(bits: Column | int, key: str = "key") -> Column:
    """The part of a key: its first ``bits`` bits."""
    head = F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long")
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.floor(head / F.pow(F.lit(2.0), 32 - bits)).cast("int")


def _positions(keys: list[bytes], size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits, by double hashing of its two halves."""
    halves = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    step = halves[:, 0] | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(halves[:, 1] + np.uint64(i) * step) % np.uint64(size) for i in range(HASHES)], axis=1)


def bloom(keys: list[bytes]) -> bytes:
    """The bits of a filter over the keys."""
    size = max(64, -(-len(keys) * BITS_PER_KEY // 8) * 8)
    bits = np.zeros(size, dtype=np.uint8)
    if keys:
        bits[_positions(keys, size).ravel().astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_hold(filter_bits: bytes, keys: list[bytes]) -> np.ndarray:
    """For each key whether the filter lets it through; every key it was made of passes."""
    if not keys:
        return np.zeros(0, dtype=bool)
    bits = np.unpackbits(np.frombuffer(filter_bits, dtype=np.uint8))
    return bits[_positions(keys, len(bits)).astype(np.int64)].all(axis=1)


class SeenIndex:
    """The index of one store, in the folder ``root``; ``stored_keys(first, end)`` gives the keys of a range of batches."""

    def __init__(self, spark: SparkSession, root: str, stored_keys: Callable[[int, int], DataFrame], fan: int = FAN,
                 part_keys: int = PART_KEYS):
        self.spark, self.root, self.stored_keys, self.fan, self.part_keys = spark, root, stored_keys, fan, part_keys

    def _path(self, kind: str, run: tuple[int, int, int] | None = None) -> str:
        return f"{self.root}/{kind}" + (f"/run={run_name(run)}" if run else "")

    def _write(self, run: tuple[int, int, int], keys: DataFrame) -> None:
        """Write a run: sorted keys and filters by part, and its size last, which makes it valid."""
        n = keys.count()
        bits = max(0, (max(n, 1) - 1) // self.part_keys).bit_length()
        dealt = keys.select("key", _part(bits).alias("part")).repartition("part").sortWithinPartitions("part", "key")
        dealt.write.mode("overwrite").partitionBy("part").parquet(self._path("keys", run))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bloom": [bloom(pdf["key"].tolist())], "part": pdf["part"].iloc[:1]})

        written = self.spark.read.schema("key binary, part int").parquet(self._path("keys", run))
        # a part has about part_keys keys: its filter is built by one task
        written.groupBy("part").applyInPandas(build, "bloom binary, part int").write.mode("overwrite").partitionBy(
            "part").parquet(self._path("filters", run))
        self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(bits).alias("bits")).write.mode(
            "overwrite").parquet(self._path("sizes", run))

    def _sizes(self) -> dict[str, tuple[int, int]]:
        """Run name -> (keys, bits of its parts) of all valid runs: a few rows."""
        if not has_path(self.spark, self._path("sizes")):
            return {}
        rows = self.spark.read.schema("n long, bits int, run string").parquet(self._path("sizes")).collect()
        return {r["run"]: (r["n"], r["bits"]) for r in rows}

    def add(self, batch_id: int, keys: DataFrame) -> None:
        """Add a batch's new keys as a run, then merge full levels."""
        self._write((0, batch_id, batch_id + 1), keys)
        end, width = batch_id + 1, self.fan
        level = 1
        while end % width == 0:
            parts = [(level - 1, a, a + width // self.fan) for a in range(end - width, end, width // self.fan)]
            self._ensure(parts)
            self._write((level, end - width, end), self._keys(parts).select("key"))
            level, width = level + 1, width * self.fan

    def _ensure(self, runs: list[tuple[int, int, int]]) -> dict[str, tuple[int, int]]:
        sizes = self._sizes()
        for run in runs:
            if run_name(run) not in sizes:
                self._write(run, self.stored_keys(run[1], run[2]))
        return self._sizes() if any(run_name(r) not in sizes for r in runs) else sizes

    def _keys(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        names = [run_name(r) for r in runs]
        return self.spark.read.schema("key binary, run string, part int").parquet(self._path("keys")).where(F.col("run").isin(names))

    def clean(self, batch_id: int) -> None:
        """Delete the runs that merges before this batch have replaced."""
        width, level = self.fan, 1
        while batch_id and batch_id % width == 0:
            for a in range(batch_id - width, batch_id, width // self.fan):
                for kind in ("sizes", "filters", "keys"):
                    delete_path(self.spark, self._path(kind, (level - 1, a, a + width // self.fan)))
            level, width = level + 1, width * self.fan

    def candidates(self, keys: DataFrame, batches: int) -> DataFrame:
        """(key, run, part) for the keys that a filter of the runs over the first ``batches`` batches lets through."""
        runs = live_runs(batches, self.fan)
        sizes = self._ensure(runs)
        live = {n: sizes[n] for n in map(run_name, runs) if sizes[n][0]}
        where = F.create_map(*[x for n, (_, bits) in live.items() for x in (F.lit(n), F.lit(bits))]) if live else F.create_map()
        if not live:
            return keys.select("key", F.lit("").alias("run"), F.lit(0).alias("part")).where("false")
        asked = keys.select("key", F.explode(where).alias("run", "bits")).select("key", "run", _part(F.col("bits")).alias("part"))
        # the parts asked for, at most one per part_keys keys of the store: filters of others are not read
        parts = asked.groupBy("run").agg(F.collect_set("part").alias("parts")).collect()
        of_batch = reduce(Column.__or__, [(F.col("run") == r["run"]) & F.col("part").isin(r["parts"]) for r in parts], F.lit(False))
        filters = self.spark.read.schema("bloom binary, run string, part int").parquet(self._path("filters")).where(of_batch)

        def test(asked: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            if asked.empty or of.empty:
                return asked.iloc[:0]
            return asked[may_hold(of["bloom"].iloc[0], asked["key"].tolist())]

        return asked.groupBy("run", "part").cogroup(filters.groupBy("run", "part")).applyInPandas(
            test, "key binary, run string, part int")

    def seen(self, keys: DataFrame, batches: int) -> tuple[DataFrame, dict[str, list[int]]]:
        """The keys that the first ``batches`` batches hold, and the parts of the runs that were read for them."""
        maybe = self.candidates(keys, batches).persist()
        parts = {r["run"]: r["parts"] for r in maybe.groupBy("run").agg(F.sort_array(F.collect_set("part")).alias("parts")).collect()}
        if not parts:
            return keys.select("key").where("false"), {}
        held = reduce(Column.__or__, [(F.col("run") == run) & F.col("part").isin(some) for run, some in parts.items()])
        stored = self.spark.read.schema("key binary, run string, part int").parquet(self._path("keys")).where(held)
        return maybe.join(stored, ["run", "part", "key"], "left_semi").select("key").distinct(), parts
