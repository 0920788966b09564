import random
from collections import defaultdict
from fractions import Fraction

import numpy as np

from orgweave.llm import jaccard_join as J
from tests.llm.conftest import DOCS, words


def grams(text):
    w = J.text_words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(class id, copy id, links) per row of (doc_id, text)."""
    copies = defaultdict(list)
    for i, t in rows:
        copies[tuple(J.text_words(t))].append(i)
    least = {w: min((i for i in ids if i is not None), default=None) for w, ids in copies.items()}
    keys = list(copies)
    sets = [grams(b" ".join(w).decode()) for w in keys]
    near = defaultdict(set)
    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    label = {}
    for a in range(len(keys)):
        if a not in label:
            todo, part = [a], {a}
            while todo:
                for b in near[todo.pop()] - part:
                    part.add(b)
                    todo.append(b)
            first = min((least[keys[p]] for p in part if least[keys[p]] is not None), default=None)
            label |= dict.fromkeys(part, first)
    return {w: (label[k], least[w], len(near[k])) for k, w in enumerate(keys)}


def near_copies(seed, groups):
    rng = random.Random(seed)
    rows, i = [], 0
    for size, length, edits in groups:
        base = words(rng, length).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(length)] = f"e{rng.random()}"
            rows.append((i, " ".join(own)))
            i += 1
    return rows


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = J.jaccard_classes(docs, **options).collect()
    want = brute(rows)
    text_of = {i: t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.class_id, r.copy_id, r.n_links) == want[tuple(J.text_words(text_of[r.doc_id]))]


def test_equals_all_pairs(spark):
    rows = near_copies(1, [(12, 120, 4), (30, 60, 3), (2, 400, 6), (5, 7, 1), (8, 25, 2), (3, 3, 1)])
    rows += [(i + 500, t.upper().replace(" ", "\n  ")) for i, t in rows[::7]]
    check(spark, rows)


def test_large_group_over_several_blocks(spark):
    check(spark, near_copies(2, [(90, 50, 4), (20, 50, 1)]), part_rows=16)


def test_pruning_keeps_what_may_reach_the_threshold():
    least = J.least_matches(0.8, 1e-9)
    rng = np.random.default_rng(0)
    equal = (rng.random((200_000, J.HASHES)) < 0.8).reshape(-1, J.HASHES // J.STEP, J.STEP).sum(axis=2).cumsum(axis=1)
    assert (equal >= least).all()
    assert least[-1] > 0.6 * J.HASHES  # and most pairs far below go


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in J.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: m for n, m in label.items() if n != m}


def test_intersections_by_product_equal_the_plain_ones():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, 6000).astype(np.uint64)) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert J._common(sets, a, b).tolist() == want
    assert J._common(sets, a[:3], b[:3]).tolist() == want[:3]
    assert Fraction(0.8).limit_denominator(10_000) == Fraction(4, 5)


def test_odd_input(spark, odd, empty, crowded):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows)
    text_of = {i: t for i, t in rows}
    for df in (odd, crowded):
        got = J.jaccard_classes(df).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.class_id, r.copy_id, r.n_links) == want[tuple(J.text_words(text_of[r.doc_id]))]
    assert J.jaccard_classes(empty).count() == 0 and J.one_per_class(empty).count() == 0
    kept = J.one_per_class(crowded)
    assert kept.columns == crowded.columns
    assert len(kept.collect()) == len({v[0] for v in want.values()})
