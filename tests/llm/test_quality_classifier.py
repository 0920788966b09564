import random
import zlib

import numpy as np

from orgweave.llm import quality_classifier as C
from tests.llm.conftest import DOCS, words


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = words(rng, 120)
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), "spam " * 100,
                               text.replace(" ", "$$$ ")])
        rows.append((i, text, "en", "s", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
        rows[-1] += (good,)
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.classify(docs, marks).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    held = [(r[0], r[5]) for r in rows if got[r[0]].held_out]
    right = np.mean([got[i].predicted == good for i, good in held])
    kept = np.mean([got[i].predicted for i, good in held if good])
    assert right >= 0.95 and kept >= 0.95


def test_negative_labels_and_held_out_rows_are_never_learnt(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([r[:5] for r in rows], DOCS)
    schema = "doc_id long, quality int, toxic int"
    full = C.classify(docs, spark.createDataFrame(labels, schema))
    held = [(i, 1 - q, t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in labels]
    positive = [x for x in held if x[1] == 1]
    part = C.classify(docs, spark.createDataFrame(positive, schema))
    assert [r.score for r in full.orderBy("doc_id").collect()] == [r.score for r in part.orderBy("doc_id").collect()]


def test_prior_estimate():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert 0.6 < C.estimate_prior(positive, mixed) < 0.78


def test_odd_input(spark, odd, empty, crowded):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, None), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = C.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert {r.score for r in C.classify(odd, none).collect()} == {0.5}
    crowd = C.classify(crowded, labels)
    assert crowd.count() == odd.count() and dict(crowd.dtypes)["score"] == "double"
    assert C.classify(empty, labels).count() == 0
