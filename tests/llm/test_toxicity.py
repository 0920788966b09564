import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from orgweave.llm import toxicity as T
from tests.llm.conftest import DOCS, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=4):
    """Plain prose; a fifth is toxic by list words, by obfuscated ones or by coined words that no list has."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        body = words(rng, rng.randrange(40, 160)).split()
        toxic = rng.random() < 0.2
        if toxic:
            kind = rng.randrange(3)
            for _ in range(3 + len(body) // 30):
                bad = [rng.choice(T.INSULTS[:20]), rng.choice(["1d10t", "m0r0n", "l0ser"]),
                       "grumpf" + rng.choice(["a", "en", "ich"])][kind]
                body.insert(rng.randrange(len(body)), bad)
        rows.append((i, " ".join(body), "en", "s", 1))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
        rows[-1] += (toxic,)
    return rows, labels


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    got = {r.doc_id: r for r in T.classify(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    held = [(got[r[0]], r[5]) for r in rows if got[r[0]].held_out]
    caught = np.mean([g.predicted for g, toxic in held if toxic])
    spared = np.mean([1 - g.predicted for g, toxic in held if not toxic])
    assert caught >= 0.95 and spared >= 0.98
    # calibrated: the mean score is near the share of toxic rows
    assert abs(np.mean([g.score for g, _ in held]) - np.mean([t for _, t in held])) < 0.05


def test_held_out_labels_are_never_learnt(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    part = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    assert part != labels
    a, b = (T.classify(docs, spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect() for x in (labels, part))
    assert [r.score for r in a] == [r.score for r in b]


def test_lexicon_counts_equal_a_plain_count(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, int(i % 3 == 0), " ".join(rng.choice(["Alpha", "bravo", "gamma" if i % 3 else "delt-a"]) for _ in range(5)))
            for i in range(60)]
    got = T.learn_lexicons(spark.createDataFrame(rows, "key long, fold long, toxic int, text string"), 2, 0.1, 3.0)
    for folds, lexicon in zip(((0,), (1,), (0, 1)), got, strict=True):
        mine = [r for r in rows if r[1] in folds]
        stems = {s for r in mine for s in T.stems_of(r[3])}
        want = {}
        for s in stems:
            toxic, clean = (sum(s in T.stems_of(r[3]) for r in mine if r[2] == y) for y in (1, 0))
            a, b = (sum(r[2] == y for r in mine) for y in (1, 0))
            ratio = toxic / a / ((clean + 0.5) / b)
            if toxic >= 2 and toxic >= 0.1 * a and ratio >= 3:
                want[s] = np.log(ratio)
        assert lexicon.keys() == want.keys() and all(abs(lexicon[s] - w) < 1e-9 for s, w in want.items())
        assert {"del", "delt"} <= lexicon.keys()


def test_training_rows_are_different_bounded_and_not_held_out(spark):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(2000)] + [(5, f"copy {k % 900}", "en", "s", 1) for k in range(1800)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(2000)], LABELS)
    got = T.training_rows(spark.createDataFrame(rows, DOCS), labels, 200).collect()
    assert len({r.key for r in got}) == len({r.text for r in got}) == len(got)
    for toxic in (0, 1):
        assert 100 <= sum(r.toxic == toxic for r in got) <= 300
    held = {f"text {i}" for i in range(2000) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert not held & {r.text for r in got}


def test_features_see_through_masks():
    lexicon = T.Lexicon({"grum": 3.0})
    plain, masked = T.features("well hello there", lexicon), T.features("you 1d10t and m0r0n and l o s e r", lexicon)
    unmasked = -4
    assert plain[unmasked] == 0 and masked[unmasked] == np.log1p(3)
    assert T.features("you are a GRUMPF", lexicon)[8] == 3.0 and T.features("", lexicon) == [0.0] * T.N_FEATURES
    near, far = (T.features(t, lexicon)[10] for t in ("you idiot", "idiot " + "word " * 20 + "you"))
    assert (near, far) == (1.0, 0.0)
    assert T.Lexicon({}).token("stuuupid!")[0] == T.INSULT | T.DRAWN | T.SPELT
    assert T.Lexicon({}).token("i-d-i-o-t.")[0] & T.SPELT and T.Lexicon({})["plain"] is None


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(T, "MEMO", 50)
    lexicon = T.Lexicon({})
    T.features(" ".join(f"{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst") + " " + "y" * 1000, lexicon)
    assert len(lexicon) <= 50


def test_odd_input(spark, odd, empty, crowded):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (4, 1, 0), (7, None, None), (None, 1, 1), (6, 1, 0), (2, 0, 0)], LABELS)
    got = T.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert {r.score for r in T.classify(odd, labels.where("toxic = 0")).collect()} == {0.0}
    crowd = T.classify(crowded.withColumn("predicted", F.lit("own")), labels)
    assert crowd.count() == odd.count() and dict(crowd.dtypes)["score"] == "double"
    assert T.classify(empty, labels).count() == 0
