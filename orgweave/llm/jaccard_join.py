"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words between white space, A-Z lower-cased;
a text of one to four words is one shingle). Texts of the same words are copies:
one node. Nodes meet in MinHash bands; each pair is handled once, in the first
band that it shares. There its MinHash values are compared ``STEP`` at a time, and
the pair is dropped as soon as the posterior probability that its similarity
reaches the threshold (uniform prior) falls below ``tolerance``. The pairs left
are verified exactly on their shingle sets.

Completeness: with 40 bands of 5 values a pair at 0.8 shares no band with
probability 1.2e-7, and a pair at the threshold is pruned with a probability of
the order of ``tolerance`` (1e-9) per step.

A band that many nodes share is dealt over blocks of two parts of at most about
``part_rows`` nodes, each pair of parts once, so no task holds an unbounded group.
Blocks report one row per node (its links there, and the smallest node it is
connected to), never pairs. Classes are the connected components, found by
alternating star contractions in the shared folder.

Odd input: null and empty texts have no words, are copies of each other and
have no links; null ids, repeated rows and ties each keep a row, and a class id
is null only if all ids of the class are; other input columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import worker_state
from orgweave.session import stored

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
STEP = 20
TOLERANCE = 1e-9
PART_ROWS = 256
CACHED = 100_000

_SIGNED = "key long, n int, sig binary"
_BLOCK = ["bucket", "i", "j"]
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2 ** 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RANDOM.integers(0, 2 ** 31, size=HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2 ** 32, size=HASHES, dtype=np.uint32)
_BAND_FACTORS = _RANDOM.integers(0, 2 ** 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hash per word, computed once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes() -> WordHashes:
    known = worker_state("word_hashes", WordHashes)
    if len(known) > CACHED:
        known.clear()
    return known


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def shingles(words: list[bytes], known: dict) -> np.ndarray:
    """Sorted different shingle hashes."""
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(w):
        return w
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(WORDS, len(w))):
        h += w[k:k + n] * _FACTORS[k]
    return np.unique(_mix(h + np.uint64(min(WORDS, len(w)))))


def signature(shingle_set: np.ndarray) -> bytes:
    """MinHash values, two bytes each."""
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at:at + 1024, None] * _A + _B).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def _signatures(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype="<u2").reshape(-1, HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h + (parts[:, :, k] + np.uint64(1)) * _BAND_FACTORS[k])
    return _mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """Per step, the fewest equal values with which the posterior still reaches the tolerance.

    With a uniform prior P(similarity >= t | m of n equal) is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, key, n and sig of every row, stored."""

    @F.pandas_udf(_SIGNED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash
        for texts in batches:
            known, out = word_hashes(), []
            for t in texts:
                words = text_words(t)
                s = shingles(words, known)
                key = xxhash.xxh3_64_intdigest(b" ".join(words)) - 2 ** 63
                out.append((key, len(s), signature(s) if len(s) else None))
            yield pd.DataFrame(out, columns=["key", "n", "sig"])
        word_hashes().clear()  # an idle worker keeps no memo

    return stored(docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*"), "jaccard-signed")


def _blocks(nodes: DataFrame, part_rows: int) -> DataFrame:
    """(bucket, i, j, band, part, key) of every band that nodes share."""

    @F.pandas_udf("array<long>")
    def keys_of(sigs: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(_signatures(sigs))))

    bands = nodes.select("key", F.posexplode(keys_of("sig")).alias("band", "bucket"))
    counts = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = bands.join(counts, "bucket")
    parts = F.when(F.col("members") <= 2 * part_rows, F.lit(1)).otherwise(
        F.ceil(F.col("members") / part_rows).cast("int"))
    shared = shared.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = shared.select("bucket", "band", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    return dealt.select("bucket", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "band", "part", "key")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of a stream sorted by block, cut so that no block is split."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = (pdf[_BLOCK] == pdf[_BLOCK].iloc[-1]).all(axis=1).to_numpy() if len(pdf) else np.zeros(0, dtype=bool)
        cut = len(pdf) - int(last.sum())
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _pairs(pdf: pd.DataFrame, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row number pairs to compare: within a block of one part all, between two parts only across."""
    block = pdf[_BLOCK].to_numpy()
    edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]).any(axis=1), True]) if len(pdf) else np.zeros(1, int)
    starts, sizes = edge[:-1], np.diff(edge)
    across = block[starts, 1] != block[starts, 2] if len(pdf) else np.zeros(0, bool)
    for size in np.unique(sizes[(~across) & (sizes > 1)]):
        a, b = np.triu_indices(size, 1)
        own = starts[(sizes == size) & ~across]
        per = max(1, most // len(a))
        for k in range(0, len(own), per):
            yield (own[k:k + per, None] + a).ravel(), (own[k:k + per, None] + b).ravel()
    part = pdf["part"].to_numpy()
    for s, n in zip(starts[across], sizes[across]):
        rows = np.arange(s, s + n)
        left, right = rows[part[rows] == block[s, 1]], rows[part[rows] != block[s, 1]]
        yield np.repeat(left, len(right)), np.tile(right, len(left))


def _survivors(pdf: pd.DataFrame, sig: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that no step prunes and whose first common band is their block's."""
    band = pdf["band"].to_numpy()
    for a, b in _pairs(pdf):
        equal = np.zeros(len(a), dtype=np.int64)
        for k, m in enumerate(least):
            cols = slice(k * STEP, (k + 1) * STEP)
            equal = equal + (sig[a, cols] == sig[b, cols]).sum(axis=1)
            alive = equal >= m
            a, b, equal = a[alive], b[alive], equal[alive]
        for at in range(0, len(a), 50_000):
            x, y = a[at:at + 50_000], b[at:at + 50_000]
            first = (sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[x]
            if first.any():
                yield x[first], y[first]


def _prune(blocks: DataFrame, least: np.ndarray) -> DataFrame:
    """The rows of a block that take part in a pair worth verifying."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches):
            keep = np.zeros(len(pdf), dtype=bool)
            for a, b in _survivors(pdf, _signatures(pdf["sig"]), least):
                keep[a] = keep[b] = True
            yield pdf[keep]

    return blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "key").mapInPandas(run, blocks.schema)


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
    # many pairs among few sets: products of 0/1 matrices, a run of shingles at a time
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = count[column] > 1
    rows, column = rows[held], column[held]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    gram = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        s = slice(*np.searchsorted(column, [lo, lo + 4096]))
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[rows[s], column[s] - lo] = 1
        gram += m @ m.T
    return gram[a, b].astype(np.int64)


def _verify(blocks: DataFrame, least: np.ndarray, threshold: Fraction) -> DataFrame:
    """Links and the smallest connected node of every node in every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches):
            known = word_hashes()
            sets = [shingles(text_words(t), known) for t in pdf["text"]]
            size = np.array([len(s) for s in sets])
            links, label = np.zeros(len(pdf), dtype=np.int64), pdf["key"].to_numpy().copy()
            found = []
            for a, b in _survivors(pdf, _signatures(pdf["sig"]), least):
                both = np.zeros(len(a), dtype=np.int64)
                block = pdf[_BLOCK].to_numpy()[a]
                edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]).any(axis=1), True])
                for lo, hi in zip(edge, edge[1:]):
                    rows, where = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
                    both[lo:hi] = _common([sets[r] for r in rows], where[:hi - lo], where[hi - lo:])
                near = both * threshold.denominator >= threshold.numerator * (size[a] + size[b] - both)
                found.append((a[near], b[near]))
                np.add.at(links, a[near], 1)
                np.add.at(links, b[near], 1)
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found))
            while True:
                least_label = np.minimum(label[a], label[b])
                if (least_label == label[a]).all() and (least_label == label[b]).all():
                    break
                np.minimum.at(label, a, least_label)
                np.minimum.at(label, b, least_label)
            linked = links > 0
            yield pd.DataFrame({"key": pdf["key"][linked], "links": links[linked], "parent": label[linked]})

    own = blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "key")
    return own.mapInPandas(run, "key long, links long, parent long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node each node of (u, v) edges is connected to, by alternating star contractions."""

    def checked(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = stored(df.where("u <> v").distinct(), name)
        return df, df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))

    e, state = checked(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while state[0]:
        e, new = checked(small_star(large_star(e)))
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                    part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, class_key, class_id, copy_id, n_links.

    ``class_id`` and ``copy_id`` are the smallest doc_id of the near-duplicate class and of
    the copies; ``n_links`` counts the other texts at or above the threshold.
    """
    least = least_matches(threshold, tolerance)
    exact = Fraction(threshold).limit_denominator(10_000)
    docs = docs.select("doc_id", "text")
    signed = sign(docs)
    nodes = stored(signed.where("n > 0").groupBy("key").agg(F.first("sig").alias("sig")), "jaccard-nodes")
    blocks = _blocks(nodes, part_rows).join(nodes, "key").select(*_BLOCK, "band", "part", "key", "sig")
    open_ = stored(_prune(blocks, least), "jaccard-open")
    # one text per node that is left to verify
    wanted = open_.select("key").distinct()
    texts = _texts_of(docs, wanted)
    links = stored(_verify(open_.join(texts, "key"), least, exact), "jaccard-links")
    labels = components(links.where("key <> parent").select(F.col("key").alias("u"), F.col("parent").alias("v")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links")).join(
        labels, F.col("key") == F.col("node"), "left").select(
        F.col("key").alias("k"), "links", F.coalesce("label", "key").alias("label"))
    copies = signed.groupBy("key").agg(F.min("doc_id").alias("copy_id"))
    named = copies.join(counts, F.col("key") == F.col("k"), "left").select(
        F.col("key").alias("k"), "copy_id", F.coalesce("label", "key").alias("label"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))
    classes = named.groupBy(F.col("label").alias("l")).agg(F.min("copy_id").alias("class_id"))
    named = named.join(classes, F.col("label") == F.col("l"))
    return signed.select("doc_id", "key").join(named, F.col("key") == F.col("k")).select(
        "doc_id", F.col("key").alias("text_key"), F.col("label").alias("class_key"), "class_id", "copy_id", "n_links")


def _key_column():
    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        import xxhash
        return pd.Series([xxhash.xxh3_64_intdigest(b" ".join(text_words(t))) - 2 ** 63 for t in texts], dtype="int64")
    return key


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) with one text per wanted key."""
    keyed = docs.select(_key_column()("text").alias("key"), "text")
    return keyed.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one row for each near-duplicate class: the one with the smallest id."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = jaccard_classes(docs, **options).groupBy("class_key").agg(F.min(rank).alias("b")).select(
        F.col("b.doc_id").alias("__llm_id"), F.col("b.text_key").alias("__llm_best"))
    keyed = docs.withColumn("__llm_key", _key_column()("text"))
    on = (keyed["__llm_key"] == best["__llm_best"]) & keyed["doc_id"].eqNullSafe(best["__llm_id"])
    return keyed.join(best, on, "left_semi").dropDuplicates(["doc_id", "__llm_key"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
