import random
from collections import Counter

import corpus_pipeline as P
from orgweave.llm import jaccard_join, mixing, packing, quality_classifier, quality_rules
from tests.llm import test_jaccard_join, test_packing
from tests.llm.conftest import DOCS, odd_rows, words

SCHEMA = "doc_id long, quality int, toxic int"


def write(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, SCHEMA).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def corpus():
    rng = random.Random(20)
    rows, labels = list(odd_rows()), []
    for i in range(100, 400):
        text = words(rng, rng.randrange(60, 150))
        good = i % 5 > 0
        if not good:
            text = text.replace(" ", " | ")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(1000 + k, rows[30 + k][1] + " more", "en", "s0", 1) for k in range(20)]
    return rows, labels


def test_stages_are_in_order_and_keep_the_columns(spark, tmp_path):
    rows, labels = corpus()
    path = write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({(r.doc_id, r.text) for r in docs.collect()})
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "jaccard_join", "mixing", "packing"]
    rules, scored, unique, mixed = kept
    # base rules by hand: 50 words at least, and no common line here
    by_hand = {(i, t) for i, t, *_ in rows if t and not (lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(
        __import__("tests.llm.test_quality_rules", fromlist=["counts"]).counts(t))}
    assert rules == by_hand
    assert scored < rules and not any(" | " in t for _, t in scored)
    want = test_jaccard_join.brute(sorted(scored, key=str))
    classes = Counter(want[tuple(jaccard_join.text_words(t))][0] for _, t in unique)
    assert set(classes) == {v[0] for v in want.values()} and max(classes.values()) == 1
    assert unique == mixed
    pieces = P.STAGES[-1][1](spark, docs, path).collect()
    test_packing.check(pieces, sorted(mixed, key=str), packing.CAPACITY)
    assert {r.doc_id for r in P.run(spark, path).collect()} == {i for i, _ in mixed}


def test_empty_tables(spark, tmp_path):
    assert P.run(spark, write(spark, tmp_path, [], [])).count() == 0


def test_parameters_are_the_documented_ones():
    assert quality_classifier.THRESHOLD == 0.7 and jaccard_join.THRESHOLD == 0.8 and jaccard_join.WORDS == 5
    assert packing.CAPACITY == 2048 and mixing.PERIOD == 1000
    assert quality_rules.RESULTS[:5] == ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
