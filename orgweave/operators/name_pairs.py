"""Pairs of domains with similar names, made where the names meet: names are shuffled, pairs never are.

A card holds a brand with at most one domain of each side, so a pair of cards is a
pair of domains as it stands. Each kind of pair comes from one place and comes once:

* equal brands or equal stems: a join (``equal_names``);
* brands one or two edits apart: blocks of brands of one length are an index of what is left of
  them without two characters, the brands of that length and of the two lengths below are streamed past (``near_names``);
* a brand in another one that is longer by three characters or more: sorted suffixes, and a lookup for
  brands of one or two characters (``names_inside``). What is longer by less is within two edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3  # brands of so many characters and more meet the suffixes that begin with the same ones
GROUP_ROWS = 200_000  # suffixes with one beginning that a task sorts together
BLOCK_KEYS = 5_000_000  # keys that a block of brands holds in memory
PAST_ROWS = 1_000_000  # brands that go past a copy of a block
SHORT_ROWS = 100_000  # brands under GRAM characters that a task holds, and brands that it looks up in
PROBES, CANDIDATES, OUT_ROWS = 500_000, 200_000, 50_000  # keys, pairs and rows made at a time

FOUND = "domain string, candidate string, pattern_score double"
CARD = ["brand", "stem", "a", "b"]
HELD, COPY, PAST = 0, 1, 2  # what a row is in a slot: to hold, a copy of what another slot holds, or to go past that
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BACK, _BACK_2 = (np.uint64(pow(0x9E3779B97F4A7C15, -k, 1 << 64)) for k in (1, 2))


def cards(a: DataFrame, b: DataFrame) -> DataFrame:
    """(brand, stem, a, b) from two tables of ``name_parts``: each domain on one card, cards of a brand and stem filled from both.

    ``stem`` is null where it is the brand. A domain that begins with its brand is written as "=" and the rest, another one as "!" and all of it.
    """
    begins = F.col("domain").startswith(F.col("brand"))
    name = F.when(begins, F.concat(F.lit("="), F.expr("substring(domain, length(brand) + 1)"))).otherwise(F.concat(F.lit("!"), "domain"))
    side = lambda df, old: df.select("brand", F.when(F.col("stem") != F.col("brand"), F.col("stem")).alias("stem"),
                                     F.lit(old).alias("old"), name.alias("name"))
    schema = pa.schema([(c, pa.string()) for c in CARD])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, rows = None, [], []

        def written() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

        for batch in batches:
            for brand, stem, old, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (brand, stem) != key or len(waiting) == 1000:
                    rows += [(*key, x, None) for x in waiting]
                    key, waiting = (brand, stem), []
                if old:
                    rows.append((brand, stem, waiting.pop() if waiting else None, name))
                else:
                    waiting.append(name)
            yield written()
            rows = []
        rows += [(*key, x, None) for x in waiting]
        yield written()

    rows = side(a, False).unionByName(side(b, True)).repartition("brand", "stem").sortWithinPartitions("brand", "stem", "old")
    return rows.mapInArrow(deal, ", ".join(f"{c} string" for c in CARD))


def sizes(cards: DataFrame) -> list[int]:
    """Number of cards by length of the brand, from 0 on."""
    counted = {r["n"]: r["count"] for r in cards.groupBy(F.length("brand").alias("n")).count().collect()}
    return [counted.get(n, 0) for n in range(max(counted, default=0) + 1)]


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its domains written out."""
    brand = batch["brand"]

    def domain(name: pa.Array) -> pa.Array:
        rest = pc.utf8_slice_codeunits(name, 1)
        return pc.if_else(pc.starts_with(name, "="), pc.binary_join_element_wise(brand, rest, ""), rest)

    return pa.RecordBatch.from_arrays([domain(batch[n]) if n in "ab" else batch[n] for n in batch.schema.names], batch.schema.names)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.RecordBatch.from_arrays(
        [pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns)], schema=parts[0].schema)


def _rows(x: pa.RecordBatch, ix: np.ndarray, y: pa.RecordBatch, iy: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The domains of side a on cards ``ix`` of x with those of side b on cards ``iy`` of y, and the other way round."""
    full = lambda batch, c: batch[c].is_valid().to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(full(x, "stem")[ix] | full(y, "stem")[iy])
    if len(odd):  # pairs of equal stems are equal_names'
        stem = lambda batch, i: pc.coalesce(batch["stem"].take(i), batch["brand"].take(i))
        same = pc.equal(stem(x, pa.array(ix[odd])), stem(y, pa.array(iy[odd]))).to_numpy(zero_copy_only=False)
        keep = np.ones(len(ix), bool)
        keep[odd[same]] = False
        ix, iy, score = ix[keep], iy[keep], score[keep]
    for u, iu, v, iv in ((x, ix, y, iy), (y, iy, x, ix)):
        at = np.flatnonzero(full(u, "a")[iu] & full(v, "b")[iv])
        for lo in range(0, len(at), OUT_ROWS):
            i = at[lo:lo + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([u["a"].take(pa.array(iu[i])), v["b"].take(pa.array(iv[i])), pa.array(score[i])],
                                             ["domain", "candidate", "pattern_score"])


def _chars(brands: pa.Array, length: int) -> np.ndarray:
    """A row of code points per brand; all have this length."""
    text = "".join(brands.to_pylist()).encode("utf-32-le")
    return np.frombuffer(text, np.uint32).reshape(len(brands), length)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their characters) for each length of brands in the batch."""
    lengths = pc.utf8_length(batch["brand"]).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, _chars(batch["brand"].take(pa.array(at)), int(n))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers from ``first`` on, ``count`` of each."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting is quicker than numpy's hash table."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[:len(numbers)]]


def _meet(rows: DataFrame, slots: int, index: type) -> DataFrame:
    """The pairs of rows (slot, role, cards) that meet in a slot, and of those held once: what is held comes first, the others go past it."""
    names = ["slot", "role", *CARD]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, parts, held, own = None, [], None, False

        def hold() -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            if parts:
                held, parts = index(_joined(parts)), []
                if own:
                    yield from held.among()

        for batch in batches:
            cuts = batch["slot"].to_numpy().astype(np.int64) * 3 + batch["role"].to_numpy()
            batch = _whole(batch)
            ends = [*(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(cuts)]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if lo == hi:
                    continue
                at, role = divmod(int(cuts[lo]), 3)
                if at != slot:
                    yield from hold()
                    slot, held = at, None
                if role != PAST:
                    own = role == HELD
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                yield from hold()
                if held:
                    yield from held.meets(batch.slice(lo, hi - lo))
        yield from hold()

    return rows.select(*names).repartition(slots, "slot").sortWithinPartitions("slot", "role").mapInArrow(match, FOUND)


def _left(chars: np.ndarray, without: int) -> np.ndarray:
    """Hashes of what is left of each row without so many of its characters (at most two), a column for each choice."""
    n, size = chars.shape
    if size <= without:
        return np.zeros((n, 1), np.uint64)
    c = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    c = (c ^ (c >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    upto = np.zeros((n, size + 1), np.uint64)  # hash of each beginning; a character moved on by one place weighs _BACK as much
    np.cumsum((c ^ (c >> np.uint64(29))) * np.cumprod(np.full(size, _STEP)), axis=1, out=upto[:, 1:])
    end = upto[:, size:]
    if without == 0:
        return end
    once = upto * _BACK
    if without == 1:
        return upto[:, :size] - once[:, 1:] + end * _BACK
    first = upto[:, :size] - once[:, 1:] + end * _BACK_2
    second = once[:, :size] - (once * _BACK)[:, 1:]
    return np.concatenate([first[:, i:i + 1] + second[:, i + 1:] for i in range(size - 1)], axis=1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edits between the columns of x and those of y, which are shorter by two rows at most; 3 stands for more than two."""
    (size, n), other = x.shape, len(y)
    flat = lambda v: np.full(n, v, np.uint8)
    far, one = flat(3), np.uint8(1)
    row = [flat(k) if 0 <= k <= other else far for k in range(-2, 3)]  # by how far y is ahead
    for i in range(1, size + 1):
        last, row = row, []
        for k in range(-2, 3):
            j = i + k
            if not 0 <= j <= other:
                row.append(far)
                continue
            best = far if j == 0 else last[k + 2] + (x[i - 1] != y[j - 1])
            if k < 2:
                best = np.minimum(best, last[k + 3] + one)
            if j and k > -2:
                best = np.minimum(best, row[-1] + one)
            row.append(np.minimum(best, far))
    return row[other - size + 2]


class _Near:
    """Brands of one length by what is left of them without two characters.

    A brand that is shorter by d and within two edits has one of these among what is left of it without 2 - d characters.
    """

    def __init__(self, held: pa.RecordBatch):
        self.held = held
        self.size = int(pc.utf8_length(held["brand"][0]).as_py())
        self.chars = _chars(held["brand"], self.size)
        keys = np.sort(_left(self.chars, 2), axis=1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        card, keys = np.repeat(np.arange(len(keys), dtype=np.int32), new.sum(axis=1)), keys[new]
        order = np.argsort(keys)
        keys, self.card = keys[order], card[order]
        del order, card, new
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.first = keys[first], np.append(first, len(keys)).astype(np.int32)
        bits = len(self.keys).bit_length()
        self.shift, self.start = np.uint64(64 - bits), np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])
        self.seen = np.zeros(1 << min(25, bits + 3), bool)
        self.sift = np.uint64(65 - len(self.seen).bit_length())
        self.seen[self.keys >> self.sift] = True

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys stand, -1 for those that don't."""
        at = (keys >> self.shift).astype(np.int64)
        place, end = self.start[at], self.start[at + 1]
        out, open_ = np.full(len(keys), -1, np.int64), np.flatnonzero(place < end)
        while len(open_):  # keys that begin with the same bits, one or two on average
            here = self.keys[place[open_]]
            same = here == keys[open_]
            out[open_[same]] = place[open_[same]]
            open_ = open_[~same]
            place[open_] += 1
            open_ = open_[place[open_] < end[open_]]
        return out

    def among(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, self.held.num_rows, 10_000):
            yield from self.meets(self.held.slice(lo, 10_000), lo)

    def meets(self, batch: pa.RecordBatch, place_held: int | None = None) -> Iterator[pa.RecordBatch]:
        """The pairs with the batch; if it is held itself, from this place on, those with what is held behind each row."""
        bits = len(self.chars).bit_length()
        for at, chars in _by_length(batch):
            without = 2 - (self.size - chars.shape[1])
            step = max(1, PROBES // max(1, chars.shape[1] ** without))
            for lo in range(0, len(at), step):
                part = chars[lo:lo + step]
                keys = _left(part, without)
                if keys.shape[1] > 200:  # of long brands: what is left may be the same again and again
                    keys.sort(axis=1)
                    hit = np.ones(keys.shape, bool)
                    hit[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    hit &= self.seen[keys >> self.sift]
                else:
                    hit = self.seen[keys >> self.sift]
                hit = np.flatnonzero(hit.ravel())
                who, keys = hit // keys.shape[1], keys.ravel()[hit]
                place = self.places(keys)
                who, place = who[place >= 0], place[place >= 0]
                count = self.first[place + 1] - self.first[place]
                upto, done = np.cumsum(count), 0
                while done < len(who):
                    end = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + CANDIDATES, "right"))
                    end = int(np.searchsorted(who, who[max(end, done + 1) - 1], "right"))  # all of a brand at once
                    card = self.card[_ranges(self.first[place[done:end]], count[done:end])]
                    other = np.repeat(who[done:end], count[done:end])
                    done = end
                    if place_held is not None:
                        later = card > at[lo + other] + place_held
                        card, other = card[later], other[later]
                    pairs = _distinct(other << bits | card)
                    other, card = pairs >> bits, pairs & (1 << bits) - 1
                    edits = _apart(np.ascontiguousarray(self.chars[card].T), np.ascontiguousarray(part[other].T))
                    near = np.flatnonzero((edits == 1) | (edits == 2))
                    score = np.where(edits[near] == 1, 0.35, 0.30)
                    yield from _rows(self.held, card[near], batch, at[lo + other[near]], score)


def near_names(cards: DataFrame, counts: list[int]) -> DataFrame:
    """(domain, candidate, pattern_score) for brands one or two edits apart.

    Pairs are found in the blocks of the longer brand, or in the earlier block of two of one length.
    """
    keys = lambda n: max(1, n * (n - 1) // 2)
    # short brands are few but have many in reach
    blocks = [-(-count // max(1, min(BLOCK_KEYS // keys(n), 1000 << min(n, 20)))) for n, count in enumerate(counts)]
    splits = [max(1, -(-sum(counts[max(0, n - 2):n + 1]) // PAST_ROWS)) for n in range(len(counts))]
    tasks = [splits[n] for n, k in enumerate(blocks) for _ in range(k)]
    first, begin = F.lit([0, *accumulate([*blocks, 0, 0, 0])]), F.lit([0, *accumulate(tasks)])
    n, block = F.length("brand"), F.col("block")
    dealt = lambda row, from_, to: from_ + F.pmod(row, to - from_).cast("int")
    rows = cards.withColumn("own", dealt(F.xxhash64("brand", "a", "b"), F.get(first, n), F.get(first, n + 1))).select(
        *CARD, "own", F.explode(F.sequence("own", F.get(first, n + 3) - 1)).alias("block"))
    from_, to = F.get(begin, block), F.get(begin, block + 1)
    slots = F.when(block == F.col("own"), F.sequence(from_, to - 1)).otherwise(F.array(dealt(F.xxhash64("a", "b", "brand"), from_, to)))
    role = F.when(block != F.col("own"), PAST).when(F.col("slot") == from_, HELD).otherwise(COPY)
    return _meet(rows.select(*CARD, "own", "block", F.explode(slots).alias("slot")).withColumn("role", role), max(1, sum(tasks)), _Near)


class _Short:
    """Brands of one or two characters."""

    def __init__(self, held: pa.RecordBatch):
        self.held = held
        codes = np.zeros(held.num_rows, np.int64)
        for at, chars in _by_length(held):
            codes[at] = self.codes(chars, chars.shape[1])[:, 0]
        self.card = np.argsort(codes, kind="stable")
        codes = codes[self.card]
        self.first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        self.known = codes[self.first]
        self.first = np.append(self.first, len(codes))

    @staticmethod
    def codes(chars: np.ndarray, size: int) -> np.ndarray:
        """A number for each character, or for each two that follow each other."""
        c = chars.astype(np.int64) + 1
        return c if size == 1 else (c[:, :-1] << 22) + c[:, 1:]

    def among(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def meets(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, chars in _by_length(batch):
            for size in range(1, GRAM):
                if chars.shape[1] < size + 3:
                    continue
                codes = self.codes(chars, size)
                place = np.searchsorted(self.known, codes.ravel())
                place[place == len(self.known)] = 0
                hit = np.flatnonzero(self.known[place] == codes.ravel())
                found = _distinct(hit // codes.shape[1] * len(self.known) + place[hit])  # once, wherever it stands
                who, place = np.divmod(found, len(self.known))
                count = self.first[place + 1] - self.first[place]
                upto, done = np.cumsum(count), 0
                while done < len(who):
                    end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + CANDIDATES, "right")))
                    card = self.card[_ranges(self.first[place[done:end]], count[done:end])]
                    other = at[np.repeat(who[done:end], count[done:end])]
                    done = end
                    yield from _rows(self.held, card, batch, other, np.full(len(card), 0.25))


def _short_inside(cards: DataFrame, counts: list[int]) -> DataFrame:
    """The pairs of brands under ``GRAM`` characters: copies of these meet a part of the others each."""
    n, parts = F.length("brand"), max(1, -(-sum(counts) // SHORT_ROWS))
    groups = max(1, -(-sum(counts[1:GRAM]) // SHORT_ROWS))
    own = F.xxhash64("brand", "a", "b")
    held = cards.where((n > 0) & (n < GRAM)).select(*CARD, F.lit(HELD).alias("role"), F.explode(F.sequence(
        F.pmod(own, F.lit(groups)) * parts, F.pmod(own, F.lit(groups)) * parts + parts - 1)).alias("slot"))
    others = cards.where(n >= 4).select(*CARD, F.lit(PAST).alias("role"), F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * parts + F.pmod(own, F.lit(parts)))).alias("slot"))
    return _meet(held.unionByName(others), parts * groups, _Short)


def _long_inside(cards: DataFrame) -> DataFrame:
    """The pairs of brands of ``GRAM`` characters and more, from suffixes and brands sorted together.

    The brands that a suffix begins with are those on a stack of nested beginnings: a row takes off
    what it doesn't begin with. A beginning that a great many suffixes share is dealt over several groups with copies of its brands.
    """
    n = F.length("brand")
    places = lambda df: df.where(n >= GRAM + 3).select(*CARD, F.explode(F.sequence(F.lit(1), n - GRAM + 1)).alias("place"))
    gram = lambda place: F.substring("brand", place, F.lit(GRAM))
    counted = places(cards).groupBy(gram(F.col("place")).alias("gram")).count().where(F.col("count") > GROUP_ROWS).collect()
    # a row for each GROUP_ROWS suffixes at most
    crowded = cards.sparkSession.createDataFrame(pa.table({
        "gram": pa.array([r["gram"] for r in counted], pa.string()),
        "parts": pa.array([-(-r["count"] // GROUP_ROWS) for r in counted], pa.int32())}))
    dealt = lambda df, place: df.withColumn("gram", gram(place)).join(crowded, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    others = dealt(places(cards), F.col("place")).withColumn("part", F.pmod(F.xxhash64("brand", "a", "b"), F.col("parts")).cast("int"))
    held = dealt(cards.where(n >= GRAM).withColumn("place", F.lit(0)), F.lit(1)).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = [*CARD, "place", "part"]
    rows = held.select(*names).unionByName(others.select(*names))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack, before = None, [], None
        for batch in batches:
            batch = _whole(batch)
            kept = len(stack)
            if stack:
                batch = _joined([before.take(pa.array([i for _, i in stack])), batch])
                stack = [(y, i) for i, (y, _) in enumerate(stack)]
            xs, ys = [], []
            found = lambda: _rows(batch, np.array(xs, np.int64), batch, np.array(ys, np.int64), np.full(len(xs), 0.25))
            columns = (batch[c].slice(kept).to_pylist() for c in ("part", "place", "brand"))
            for i, (part, place, brand) in enumerate(zip(*columns, strict=True), kept):
                if part != group:
                    group, stack = part, []
                key = brand[place - 1:] if place else brand
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not place:
                    stack.append((key, i))
                    continue
                for y, k in stack:  # once, where it stands first
                    if len(y) + 3 <= len(brand) and brand.find(y) == place - 1:
                        xs.append(i)
                        ys.append(k)
                if len(xs) >= CANDIDATES:
                    yield from found()
                    xs, ys = [], []
            before = batch
            yield from found()

    key = F.expr("substring(brand, greatest(place, 1))")  # a brand comes before the suffixes that equal it
    return (rows.repartition(gram(F.greatest("place", F.lit(1))), "part").withColumn("key", key)
            .sortWithinPartitions("part", "key", "place").select(*names).mapInArrow(match, FOUND))


def names_inside(cards: DataFrame, counts: list[int]) -> DataFrame:
    """(domain, candidate, pattern_score) for brands that stand in a brand longer by three characters or more."""
    return _long_inside(cards).unionByName(_short_inside(cards, counts))


def equal_names(a: DataFrame, b: DataFrame, score: Column) -> DataFrame:
    """(domain, candidate, pattern_score) for equal brands or equal stems; ``b`` has its columns named c_, ``score`` is of both."""
    keyed = lambda df, c: df.withColumn(f"{c}key", F.explode(F.array_distinct(F.array(f"{c}brand", f"{c}stem"))))
    equal = lambda c: (F.col("key") == F.col(c)) & (F.col("key") == F.col(f"c_{c}"))
    found = keyed(a, "").join(keyed(b, "c_"), F.col("key") == F.col("c_key")).where(
        equal("brand") | equal("stem") & (F.col("brand") != F.col("c_brand")))
    return found.where(F.col("domain") != F.col("c_domain")).select(
        "domain", F.col("c_domain").alias("candidate"), score.alias("pattern_score"))
