import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use for results or inside, as extra input columns
EXTRA = ["kept", "score", "labels", "shard", "slot", "block", "phase", "size", "n_words", "__llm_hash", "key", "x"]


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    long = words(rng, 20_000)
    plain = words(rng, 120)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, plain, "en", "a", len(plain)),
        (None, plain, "en", "a", len(plain)), (3, long, "en", "b", len(long)), (4, plain, "en", None, None),
        (4, plain, "en", None, None), (5, " \n\t ", "en", "a", 4), (6, "é" * 50 + " 日本 語", "fr", "b", 55),
        (7, plain + " tail", None, "b", 1), (-9, "one two", "en", "a", 7),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def crowded(odd):
    from pyspark.sql import functions as F
    return odd.withColumns({c: F.lit("own") for c in EXTRA})
