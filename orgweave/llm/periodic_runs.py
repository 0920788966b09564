r"""Periodic runs of words: a dictionary of basic factors proposes the periods.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
the same), at least ``max(min_length, 2 * q)`` long, that no neighbouring word
extends with that period.

Texts are named a batch at a time: per power of two ``L`` every stretch of ``L``
words that comes back in its text has a name, made from the names of its two
halves. Per name the occurrences are walked in order. Successors at most
``L / 2`` apart form an arithmetic progression whose difference is the period
of the stretch itself; a progression and the progressions that begin within
``2 * L`` words propose further periods: from each occurrence to the first of a
later progression, and from last to last. Every run shows up this way: for
``L <= q < 2 * L`` the stretch at its start comes back ``q`` words later, in a
later progression unless ``q`` is the difference itself, and either both
progressions end inside the run (last to last is ``q``) or the later one begins
just there (first). Proposals at neighbouring places with one period are one
proposal. They are extended to both sides by comparing names, longest first,
and of equal stretches the smallest period stays.

A stretch that doesn't come back drops out of all longer ones, so ordinary
prose costs two rounds of naming; the work is O(n log n) names whatever the
text.

Odd input: a null or empty text has no run and an empty collapsed text; repeated
rows get the same result each; an empty table gives no rows; all input columns
stay, but one named like a result is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import without

RESULTS = ["runs", "collapsed"]
MIN_LENGTH = 12
BATCH_WORDS = 400_000  # words named together; a longer text is a batch of its own

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.string())])
RESULT_DDL = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def basic_factors(words: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4 ... words per place; -1 where a stretch is cut off or doesn't come back.

    ``words`` are ids from 0 that differ between texts, -1 between texts.
    """
    names = np.where(words >= 0, words, 0)
    often = np.bincount(names, weights=words >= 0) > 1
    levels = [np.where((words >= 0) & often[names], words, -1)]
    length = 1
    while True:
        last = levels[-1]
        at = np.flatnonzero((last[:-length] >= 0) & (last[length:] >= 0)) if length < len(last) else np.array([], int)
        if not len(at):
            return levels
        key = last[at] * (last.max() + 1) + last[at + length]
        _, name, times = np.unique(key, return_inverse=True, return_counts=True)
        back = times[name] > 1
        if not back.any():
            return levels
        level = np.full(len(last), -1, dtype=np.int64)
        level[at[back]] = name[back]
        levels.append(level)
        length *= 2


def _proposals(names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs that the successor occurrences of one length propose."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    name = names[at]
    same = name[1:] == name[:-1]
    gap = np.diff(at)
    chained = same & (2 * gap <= length)
    # progressions: first and last member of each, and the progression of every occurrence
    first = np.flatnonzero(np.concatenate([[True], ~chained]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    own = np.repeat(np.arange(len(first)), last - first + 1)
    more = last > first
    places, periods = [at[first[more]]], [at[first[more] + 1] - at[first[more]]]
    # a window of 2 * length words holds few progressions, as they are over length / 2 apart
    for k in count(1):
        b = np.flatnonzero(own + k < len(first))
        later = first[own[b] + k]
        ok = (name[later] == name[b]) & (at[later] - at[b] <= 2 * length)
        a = np.flatnonzero(np.arange(len(first)) + k < len(first))
        near = (name[first[a + k]] == name[first[a]]) & (at[first[a + k]] - at[last[a]] <= 2 * length)
        if not ok.any() and not near.any():
            break
        places += [at[b[ok]], at[last[a[near]]]]
        periods += [at[later[ok]] - at[b[ok]], at[last[a[near] + k]] - at[last[a[near]]]]
    place, period = np.concatenate(places), np.concatenate(periods)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # neighbouring places with one period lie in one stretch
    new = np.concatenate([[True], (np.diff(period) != 0) | (np.diff(place) > 1)]) if len(place) else np.array([], bool)
    return place[new], period[new]


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; ``words`` as in basic_factors."""
    levels = basic_factors(words)
    places, periods = [], []
    for k, names in enumerate(levels):
        # below, runs are long enough for the next length to show their periods
        if min_length < 4 * 2 ** k - 1 and (names >= 0).any():
            place, period = _proposals(names, 2 ** k)
            places.append(place)
            periods.append(period)
    empty = np.array([], dtype=np.int64)
    left, p = (np.concatenate(x) if x else empty for x in (places, periods))
    right = left.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, length = levels[k], 2 ** k
        for side, step in ((right, 0), (left, -length)):
            x, y = side + step, side + step + p
            inside = (x >= 0) & (y < len(names))
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            side += np.where(inside & (names[x] >= 0) & (names[x] == names[y]), length if step == 0 else -length, 0)
    length = right - left + p
    good = length >= np.maximum(min_length, 2 * p)
    left, length, p = left[good], length[good], p[good]
    order = np.lexsort((p, length, left))
    left, length, p = left[order], length[order], p[order]
    new = np.concatenate([[True], (np.diff(left) != 0) | (np.diff(length) != 0)]) if len(left) else np.array([], bool)
    left, length, p = left[new], length[new], p[new]
    order = np.lexsort((p, left))
    return left[order], length[order], p[order]


def _batches(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, about BATCH_WORDS of them at a time."""
    held, size = [], 0
    for t in texts:
        words = (t or b"").split()  # splits at \x20 and \x09-\x0D
        if held and size + len(words) > BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _of_texts(docs: list[list[bytes]], min_length: int) -> pa.StructArray:
    """Runs and collapsed texts of a few documents."""
    flat, base = [], 0
    for words in docs:
        seen: dict[bytes, int] = {}
        flat += [seen.setdefault(w, len(seen) + base) for w in words]
        flat.append(-1)
        base += len(seen)
    begins = np.cumsum([0] + [len(w) + 1 for w in docs])
    start, length, period = find_runs(np.array(flat, dtype=np.int64), min_length)
    doc = np.searchsorted(begins, start, side="right") - 1
    # words of a run behind its first period are repeats
    marks = np.zeros(begins[-1] + 1, dtype=np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.cumsum(marks) == 0
    hit = set(doc.tolist())
    collapsed = [b" ".join([w for w, k in zip(words, kept[b:].tolist(), strict=False) if k] if i in hit else words)
                 for i, (words, b) in enumerate(zip(docs, begins.tolist(), strict=False))]
    runs = pa.StructArray.from_arrays([pa.array(start - begins[doc]), pa.array(length), pa.array(period)], fields=list(RUN))
    offsets = pa.array(np.searchsorted(doc, np.arange(len(docs) + 1)).astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, runs),
                                       pa.array(collapsed, pa.binary()).cast(pa.string())], fields=list(RESULT))


def detect_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Add ``runs`` (by start, then period) and ``collapsed``, the text without the repeats, words joined by one blank."""

    @F.arrow_udf(RESULT_DDL)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_of_texts(d, min_length) for d in _batches(texts.cast(pa.binary()).to_pylist())]
            yield pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    # said to be non-deterministic so that the planner keeps one call, however many columns are made of its result
    found = without(docs, RESULTS).withColumn("__llm_found", scan.asNondeterministic()("text"))
    return found.withColumns({c: F.col("__llm_found")[c] for c in RESULTS}).drop("__llm_found")


def with_tail(doc_id: int | None, text: bytes | None) -> bytes | None:
    """The text with a periodic tail for every tenth id (by crc32); a null id leaves it as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    words = (text or b"").split() if h % 10 == 0 else []
    if not words:
        return text
    g = h // 10
    first = g % len(words)
    tail = words[first:first + 1 + (len(words) - first) // (3 + g % 8)]
    times = -(-(len(words) - first) // len(tail))
    return b" ".join((words[:first] + tail * times)[:len(words)])


def plant(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``with_tail``."""

    @F.arrow_udf("string")
    def planted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            pairs = zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)
            yield pa.array([with_tail(i, t) for i, t in pairs], pa.binary()).cast(pa.string())

    return docs.withColumn("text", planted("doc_id", "text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("__llm_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__llm_best.start")).alias("start"),
        F.col("__llm_best.length").alias("length"), (-F.col("__llm_best.period")).alias("period"),
        F.floor(1000 * F.col("__llm_best.length") / -F.col("__llm_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
