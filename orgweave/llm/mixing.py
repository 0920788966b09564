"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about ``block_bytes`` of its own stream (rows
in the order of a hash of the id). The target is a fluid that gives every source
with blocks left its share of each slot by weight; when a source is through, the
others share its part. Block ``j`` of a source is released in the slot in which
the fluid begins it and due by the end of the slot in which the fluid completes
it. With weights ``w``, ``W`` the sum over the sources not yet through and ``B``
the blocks of those that are, that is ``floor(B + j W / w)`` and
``ceil(B + (j + 1) W / w)``. Serving, at each slot, the released block with the
earliest deadline meets every deadline (the fluid does, and blocks are of unit
length), so every source is less than one block away from its target at every
slot, and every row is placed exactly once.

The weights are the given floats taken as exact fractions: releases and
deadlines are integer arithmetic without rounding, for any number of sources and
blocks. Such a schedule has no period, so the walk is over all blocks: one task
holds two heaps with an entry per source and gives out one row per block. Rows
stay where they are, and the driver sees nothing. A source may hold any share of
the rows: its prefix sums are taken per (source, hash bucket) and stitched with
one total per bucket, and each bucket gets the plan of its own blocks.

``plan_phases`` is the repeating table for weights that are rounded to whole slots
of a period; ``mix`` rounds to a period only if it is given one.

Odd input: a null source is a source of its own; a null or empty text has
``overhead`` bytes like any other row; null ids and repeated rows are placed
each; an unlisted source gets the weight ``other``; an empty table gives no
rows; input columns named like a result are replaced.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orgweave.llm.common import without
from orgweave.session import stored

BLOCK_BYTES = 65_536
PERIOD = 1000
BUCKETS = 4096
WALK_ROWS = 10_000
RESULTS = ["block", "phase", "release", "deadline", "slot", "place"]
WALK = "s string, block long, phase int, release long, deadline long, slot long"


def weights_to_slots(weights: list[float], period: int) -> list[int]:
    """Whole slots per period, one at least for each source, by largest remainder."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    slots = [max(1, int(x)) for x in exact]
    order = sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))
    k = 0
    while sum(slots) < period:
        slots[order[k % len(order)]] += 1
        k += 1
    while sum(slots) > period:
        slots[max(range(len(slots)), key=lambda i: (slots[i] - exact[i] if slots[i] > 1 else -period, i))] -= 1
    return slots


def earliest_deadline_first(slots: list[int]) -> list[list[int]]:
    """Slot of each of the blocks of every source within one period."""
    period = sum(slots)
    waiting = [(0, i, 0) for i in range(len(slots))]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    places: list[list[int]] = [[] for _ in slots]
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[i]), i, j))
        deadline, i, j = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline is missed")
        places[i].append(t)
        if j + 1 < slots[i]:
            heapq.heappush(waiting, ((j + 1) * period // slots[i], i, j + 1))
    return places


@dataclass
class Plan:
    """Phases per source and slots per block of a period; ``sources * period`` rows per phase at most."""

    phases: list[tuple]  # source, phase, first block, blocks, first slot, slots per period, period
    slots: list[tuple]  # source, phase, block of the period, slot of the period


def plan_phases(weights: dict[str, float], blocks: dict[str, int], period: int) -> Plan:
    """Schedule all blocks of all sources: a phase ends when a source runs out."""
    left = {s: b for s, b in blocks.items() if b}
    done = dict.fromkeys(left, 0)
    phases, slots, slot0, phase = [], [], 0, 0
    while left:
        active = sorted(left)
        n = max(period, len(active)) if len(active) > 1 else 1
        share = weights_to_slots([weights[s] for s in active], n)
        places = earliest_deadline_first(share)
        # the first slot after which some source has no block left
        end = min((left[s] - 1) // k * n + p[(left[s] - 1) % k] + 1 for s, k, p in zip(active, share, places))
        for s, k, p in zip(active, share, places):
            served = end // n * k + sum(x < end % n for x in p)
            if served:
                phases.append((s, phase, done[s], served, slot0, k, n))
                slots.extend((s, phase, j, x) for j, x in enumerate(p))
                done[s] += served
                left[s] -= served
        left = {s: b for s, b in left.items() if b}
        slot0, phase = slot0 + end, phase + 1
    return Plan(phases, slots)


def exact_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratios of the given floats."""
    parts = [Fraction(w) for w in weights]
    scale = math.lcm(*[x.denominator for x in parts])
    return [int(x * scale) for x in parts]


def walk(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot) of every block, by slot; a phase ends when the fluid ends a source."""
    names = sorted(s for s, b in blocks.items() if b)
    if not names:
        return
    w, b = exact_weights([weights[s] for s in names]), [blocks[s] for s in names]
    ends = sorted((Fraction(n, x), i) for i, (n, x) in enumerate(zip(b, w)))
    keys = [float(v) for v, _ in ends]
    active, given = [sum(w)], [0]  # in each phase: weight of the sources not yet through, blocks of the others
    for _, i in ends:
        active.append(active[-1] - w[i])
        given.append(given[-1] + b[i])

    def fluid(i: int, j: int) -> tuple[int, int, int]:
        """(phase, slot, rest) at which the fluid has given ``j`` blocks of source ``i``; no rest at a whole slot."""
        phase = bisect_right(keys, j / w[i])
        while phase and ends[phase - 1][0] * w[i] > j:  # floats of close ends may be equal
            phase -= 1
        slot, rest = divmod(j * active[phase], w[i])
        return phase, given[phase] + slot, rest

    waiting = [(0, i, 0, 0) for i in range(len(names))]  # (release, source, block, phase)
    ready: list[tuple[int, int, int, int, int, tuple[int, int, int]]] = []
    for t in range(given[-1]):
        while waiting and waiting[0][0] <= t:
            release, i, j, phase = heapq.heappop(waiting)
            end = fluid(i, j + 1)
            heapq.heappush(ready, (end[1] + (end[2] > 0), i, j, phase, release, end))
        deadline, i, j, phase, release, end = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline is missed")
        yield names[i], j, phase, release, deadline, t
        if j + 1 < b[i]:
            heapq.heappush(waiting, (end[1], i, j + 1, end[0]))


def tempered_weights(sizes: dict[str, int], power: float = 0.7) -> dict[str, float]:
    """Target weights that lift small sources: size to a power below 1."""
    return {s: max(n, 1) ** power for s, n in sizes.items()}


def _source_key(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("none"))


def _prefix(keys: list[str], order: list[str], value: str) -> Column:
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0).cast("long"))


def _check(totals: DataFrame, given: dict[str, float] | None, other: float) -> None:
    """An error if a source of the table has a weight that is no positive number."""
    if given is None:
        return
    fit = lambda w: 0 < w < math.inf
    name = F.col("__llm_source")
    bad = name.isin([s for s, w in given.items() if not fit(w)])
    if not fit(other):
        bad = bad | ~name.isin(list(given))
    elif all(fit(w) for w in given.values()):
        return
    if totals.where(bad).take(1):
        raise ValueError("weights are above 0; leave a source out of the table instead")


def _plan(totals: DataFrame, given: dict[str, float] | None, other: float, block_bytes: int,
          period: int | None) -> DataFrame:
    """One row per block of every source; what goes to the task of the walk is one row per source."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = {s: int(n) for pdf in batches for s, n in zip(pdf["__llm_source"], pdf["n"])}
        wanted = tempered_weights(sizes) if given is None else {s: given.get(s, other) for s in sizes}
        if period and wanted:
            names = sorted(wanted)
            wanted = dict(zip(names, weights_to_slots([wanted[s] for s in names], max(period, len(names)))))
        steps = walk(wanted, {s: -(-n // block_bytes) for s, n in sizes.items()})
        columns = [c.split()[0] for c in WALK.split(", ")]
        while part := list(islice(steps, WALK_ROWS)):
            yield pd.DataFrame(part, columns=columns)

    sizes = totals.groupBy("__llm_source").agg(F.sum("__llm_bytes").alias("n"))
    return sizes.coalesce(1).mapInPandas(plan, WALK)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, other: float = 1.0, source: str = "source",
        id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, period: int | None = None,
        overhead: int = 8) -> DataFrame:
    """Add block, phase, release, deadline, slot and place (within the slot) to every row.

    The mixed stream is the rows by (slot, place). Without ``weights`` the target
    is each source's share of the bytes to the power 0.7. With a ``period`` the
    target is rounded to whole slots of it first.
    """
    names = without(docs, RESULTS).columns
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + overhead
    rows = without(docs, RESULTS).withColumns({
        "__llm_source": _source_key(source), "__llm_size": size, "__llm_hash": F.xxhash64(F.col(id_col), F.col(text_col))})
    rows = rows.withColumn("__llm_bucket", F.shiftrightunsigned("__llm_hash", 52).cast("int"))
    key = ["__llm_source", "__llm_bucket"]
    totals = rows.groupBy(*key).agg(F.sum("__llm_size").alias("__llm_bytes"))
    given = None if weights is None else {"none" if s is None else f"={s}": float(w) for s, w in weights.items()}
    _check(totals, given, other)
    plan = _plan(totals, given, other, block_bytes, period)
    # one row per source and bucket, BUCKETS to a source at most, each with the plan of the blocks that begin or go on in it
    div = lambda x: F.call_function("div", x, F.lit(block_bytes))
    offsets = totals.withColumn("__llm_before", _prefix(["__llm_source"], ["__llm_bucket"], "__llm_bytes")).withColumns({
        "__llm_first": div(F.col("__llm_before")), "__llm_last": div(F.col("__llm_before") + F.col("__llm_bytes") - 1)})
    cells = offsets.withColumn("__llm_block", F.explode(F.sequence("__llm_first", "__llm_last")))
    cells = cells.join(plan, (F.col("__llm_source") == F.col("s")) & (F.col("__llm_block") == F.col("block")))
    steps = F.array_sort(F.collect_list(F.struct("block", "phase", "release", "deadline", "slot")))
    offsets = stored(cells.groupBy(*[F.col(k).alias(f"{k}_") for k in key]).agg(
        F.first("__llm_before").alias("__llm_before"), F.first("__llm_first").alias("__llm_first"),
        steps.alias("__llm_steps")), "mixing-plan")
    own = rows.withColumn("__llm_start", _prefix(key, ["__llm_hash", id_col, "__llm_size"], "__llm_size"))
    own = own.join(offsets, [F.col(k) == F.col(f"{k}_") for k in key])
    own = own.withColumn("__llm_start", F.col("__llm_start") + F.col("__llm_before"))
    own = own.withColumn("__llm_step", F.get("__llm_steps", (div(F.col("__llm_start")) - F.col("__llm_first")).cast("int")))
    own = own.withColumns({c: F.col(f"__llm_step.{c}") for c in RESULTS[:-1]}).withColumn(
        "place", F.col("__llm_start") % block_bytes)
    return own.select(*[F.col(f"`{c}`") for c in names], *RESULTS)


def mixed_stream(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str = "text",
                 **options) -> DataFrame:
    """The rows of ``docs`` in mixed order: partitions follow each other by slot, and each is sorted."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # keeps columns named like a result
    placed = mix(docs.select(whole, source, id_col, text_col), source=source, id_col=id_col, text_col=text_col, **options)
    return placed.select("row", "slot", "place").repartitionByRange("slot", "place").sortWithinPartitions(
        "slot", "place").select("row.*")
