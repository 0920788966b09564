import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import islice
from math import ceil, floor

import pytest

from orgweave.llm import mixing as M
from tests.llm.conftest import DOCS, words


def test_every_prefix_is_within_a_block_of_its_target():
    rng = random.Random(12)
    for _ in range(40):
        weights = [rng.random() + 0.01 for _ in range(rng.randrange(1, 12))]
        slots = M.weights_to_slots(weights, 100)
        places = M.earliest_deadline_first(slots)
        assert sum(slots) == 100 and sorted(t for p in places for t in p) == list(range(100))
        for n, p in zip(slots, places):
            for t in range(1, 101):
                assert abs(sum(x < t for x in p) - n * t / 100) < 1


def test_phases_place_every_block_once_and_in_its_window():
    rng = random.Random(13)
    for _ in range(30):
        names = [f"s{i}" for i in range(rng.randrange(1, 7))]
        weights = {s: rng.random() + 0.05 for s in names}
        blocks = {s: rng.randrange(0, 400) for s in names}
        plan = M.plan_phases(weights, blocks, 50)
        at = {(s, p, k): x for s, p, k, x in plan.slots}
        taken, when = [], defaultdict(list)
        for s, p, first, n, slot0, k, size in plan.phases:
            for j in range(n):
                slot = slot0 + j // k * size + at[s, p, j % k]
                assert slot0 + floor(j * size / k) <= slot < slot0 + ceil((j + 1) * size / k)
                taken.append(slot)
                when[s].append(first + j)
        assert sorted(taken) == list(range(sum(blocks.values())))
        assert {s: v for s, v in when.items()} == {s: list(range(b)) for s, b in blocks.items() if b}


def test_mix_equals_a_plain_walk(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, rng.randrange(1, 80)), "en", rng.choice(["a", "a", "a", "b", "c"]), 1) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = M.mix(docs, {"a": 1, "b": 2, "c": 1}, block_bytes=1000, period=12).collect()
    assert len(got) == 900 and all(r.release <= r.slot < r.deadline for r in got)
    places = Counter((r.slot, r.place) for r in got)
    assert max(places.values()) == 1
    slots = defaultdict(set)
    for r in got:
        slots[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in slots.values())
    # while all sources last, each prefix holds its share of slots within one block
    last = min(max(r.slot for r in got if r.source == s) for s in "abc")
    for s, share in (("a", 0.25), ("b", 0.5), ("c", 0.25)):
        own = {r.slot for r in got if r.source == s}
        # slots that a long row spans hold no row of their own, so only an upper bound is exact
        for t in range(1, last + 1):
            assert sum(x < t for x in own) - share * t < 1
    stream = M.mixed_stream(docs, weights={"a": 1, "b": 2, "c": 1}, block_bytes=1000, period=12)
    want = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.place))]
    assert [r.doc_id for r in stream.collect()] == want and stream.columns == docs.columns


def fluid_targets(weights, blocks):
    """Exact share of every source after each slot: the sources with blocks left share each slot by weight."""
    w = {s: Fraction(x) for s, x in weights.items()}
    got = dict.fromkeys(blocks, Fraction(0))
    for _ in range(sum(blocks.values())):
        room = Fraction(1)
        while room:
            on = [s for s in blocks if got[s] < blocks[s]]
            total = sum(w[s] for s in on)
            step = min([room / total] + [(blocks[s] - got[s]) / w[s] for s in on])
            for s in on:
                got[s] += step * w[s]
            room -= step * total
        yield dict(got)


def check_walk(weights, blocks):
    served = dict.fromkeys(blocks, 0)
    steps = list(M.walk(weights, blocks))
    assert [x[5] for x in steps] == list(range(sum(blocks.values())))
    for (s, j, _, release, deadline, slot), target in zip(steps, fluid_targets(weights, blocks), strict=True):
        assert j == served[s] and release <= slot < deadline
        served[s] += 1
        assert all(abs(served[x] - target[x]) < 1 for x in blocks)
    assert served == blocks


def test_walk_keeps_to_the_unrounded_target():
    rng = random.Random(15)
    for k in range(25):
        names = [f"s{i}" for i in range(rng.randrange(1, 9))]
        weights = {s: rng.choice([rng.random() + 0.001, 1.0, 0.1, 3e-7]) for s in names}
        check_walk(weights, {s: rng.randrange(0, 60) for s in names} | {"s0": 5})
    assert list(M.walk({}, {})) == []


def test_walk_has_no_period_and_no_source_limit():
    # 0.0004 of the slots: a period of 1000 slots gives none or one, 0.001
    at = [x[5] for x in M.walk({"a": 0.9996, "b": 0.0004}, {"a": 60_000, "b": 40}) if x[0] == "b"]
    last = int(40 / 0.0004)
    assert all(abs(k - t * 0.0004) <= 1.001 for k, t in enumerate(at) if t < min(last, 60_000))
    # a hot source of a third of the bytes beside 1,500 small ones
    sizes = {"hot": 750} | {f"s{i}": 1 for i in range(1500)}
    weights = M.tempered_weights(sizes)
    share = weights["hot"] / sum(weights.values())
    first = [x[0] for x in islice(M.walk(weights, sizes), 1000)]
    assert share > 0.06 and abs(first.count("hot") - 1000 * share) < 1


def test_mix_with_more_than_a_thousand_sources(spark):
    docs = spark.range(2400).selectExpr("id doc_id", "repeat('x', 92) text", "if(id < 1200, 'hot', concat('s', id)) source")
    got = M.mix(docs, block_bytes=100).collect()
    assert sorted(r.slot for r in got) == list(range(2400)) and all(r.release <= r.slot < r.deadline for r in got)
    weights = M.tempered_weights(Counter(r.source for r in got))
    own = {r.slot for r in got if r.source == "hot"}
    share = weights["hot"] / sum(weights.values())
    assert all(abs(sum(x < t for x in own) - share * t) < 1 for t in range(1, 1000, 37))


def test_odd_input(odd, empty, crowded):
    got = M.mix(odd).collect()
    assert len(got) == odd.count() and len({(r.slot, r.place) for r in got}) == len(got)
    crowd = M.mix(crowded)
    assert crowd.count() == odd.count() and dict(crowd.dtypes)["block"] == "bigint" and "x" in crowd.columns
    assert M.mix(empty).count() == 0 and M.mixed_stream(crowded).columns == crowded.columns
    with pytest.raises(ValueError):
        M.mix(odd, {"a": 0.0})
