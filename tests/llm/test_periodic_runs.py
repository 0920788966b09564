import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.llm import periodic_runs as R
from tests.llm.conftest import DOCS


def brute(words, min_length):
    """All runs by comparing words p apart, stretch by stretch."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(min_length, 2 * p):
                found.setdefault((i, length), p)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def runs_of(words, min_length):
    return sorted(zip(*(x.tolist() for x in R.find_runs(np.array(words, dtype=np.int64), min_length)), strict=True))


@pytest.mark.parametrize("min_length", [2, 3, 5, 12])
def test_all_short_strings(min_length):
    for n in range(1, 11):
        for code in range(2 ** (n - 1)):
            words = [code >> i & 1 for i in range(n)]
            assert runs_of(words, min_length) == [(s, le, p) for s, le, p in brute(words, min_length)], words


def structured(rng):
    """Periodic stretches inside each other, broken here and there."""
    words = [rng.randrange(3) for _ in range(rng.randrange(1, 8))]
    for _ in range(rng.randrange(1, 7)):
        kind = rng.randrange(4)
        if kind == 0:
            words = words * rng.randrange(2, 4)
        elif kind == 1:
            words = words + words[:rng.randrange(len(words) + 1)]
        elif kind == 2:
            words = words[rng.randrange(len(words)):] + words
        else:
            words[rng.randrange(len(words))] = rng.randrange(3)
        words = words[:300]
    return words


@pytest.mark.parametrize("min_length", [2, 7, 12])
def test_structured_strings(min_length):
    rng = random.Random(min_length)
    for _ in range(300):
        words = structured(rng)
        assert runs_of(words, min_length) == brute(words, min_length), words


def test_fibonacci_words_and_texts_side_by_side():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert runs_of(b, 2) == brute(b, 2)
    # names differ between texts and -1 parts them: nothing runs across
    joined = b[:100] + [-1] + [w + 2 for w in b[:100]] + [-1]
    alone = brute(b[:100], 2)
    assert runs_of(joined, 2) == sorted(alone + [(s + 101, n, p) for s, n, p in alone])


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 12)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def run(docs):
    return R.digests(R.detect_runs(R.plant(docs)))


def test_query_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(f"w{rng.randrange(9)}é" for _ in range(rng.randrange(60))), "en", "s", 1)
            for i in range(300)]
    rows += [(1000 + i, "a b  " * rng.randrange(20) + "c " * rng.randrange(20), "en", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(expected(r[0], r[1]) for r in rows)
    assert sum(w[1] for w in want) > 40
    assert sorted(tuple(r) for r in run(docs).collect()) == want


def test_odd_input(odd, empty, crowded):
    want = sorted((expected(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 3), key=str)
    got = [tuple(r) for r in run(odd.where("doc_id is null or doc_id <> 3")).collect()]
    assert sorted(got, key=str) == want
    crowd = R.detect_runs(crowded.withColumn("runs", F.lit("own")))
    assert crowd.count() == odd.count() and crowd.columns[-2:] == R.RESULTS
    assert run(empty).count() == 0


def test_a_long_text_of_one_phrase(spark):
    docs = spark.createDataFrame([(1, "the same phrase over again " * 100_000, "en", "s", 1)], DOCS)
    row = R.detect_runs(docs).collect()[0]
    assert [tuple(r) for r in row.runs] == [(0, 500_000, 5)] and row.collapsed == "the same phrase over again"
