import random

from orgweave.llm import license_scan as L


def distance(pattern, text):
    """Least edits with which ``pattern`` stands somewhere in ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def scanner():
    return L.NoticeScanner(L.NOTICES, L.BASE, L.EDIT_EVERY)


def edited(rng, text, k):
    for _ in range(k):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1:], text[:i] + "q" + text[i:], text[:i] + "z" + text[i + 1:]])
    return text


def test_labels_equal_the_edit_distance_rule():
    rng, s = random.Random(4), scanner()
    for case in range(120):
        label, notice = rng.choice(L.NOTICES)
        filler = " ".join(rng.choice(["lorem", "ipsum", "license", "the", "of", "terms"]) for _ in range(rng.randrange(12)))
        text = f"{filler} {edited(rng, notice, rng.randrange(0, 10))} {filler}"
        norm = L.normal_text(text)
        want = {n for (n, p), k in zip(s.notices, s.edits) if distance(p, norm) <= k}
        _, matches = s.scan(norm)
        assert {s.notices[i][0] for i, *_ in matches} == want, text


def test_spans_point_into_the_text():
    text = "Head.\n(c) Licensd under the\nApache-License, Versoin 2.0!! All Rights reserved. é"
    row = L.scan_text(text, scanner())
    spans = {(s["label"], text[s["start"]:s["end"]]) for s in row[7]}
    assert ("reserved", "All Rights reserved") in spans
    assert any(label == "apache" and t.startswith("Licensd") and t.endswith("2.0") for label, t in spans)
    assert row[1:6] == (1, 10, 10, "reserved", "apache,reserved")


def test_base_places():
    row = L.scan_text("CC-BY cc by, CC BY-SA; General\nPublic License v3 ccby", scanner())
    assert row[1:4] == (4, 0, 7) and row[4] == "cc-by,gpl" and row[6] == 1.0


def test_odd_input(odd, empty, crowded):
    got = L.scan_licenses(odd).collect()
    assert len(got) == odd.count() and {r.n_words for r in got if r.doc_id in (1, 2, 5)} == {0}
    crowd = L.scan_licenses(crowded)
    assert crowd.count() == odd.count() and dict(crowd.dtypes)["labels"] == "string" and "x" in crowd.columns
    assert L.scan_licenses(empty).count() == 0


def test_weaker_matches_before_and_after_a_better_one():
    text = "all rights reservd all rights reserved all right reserved and all rights reserved"
    spans = [(text[x["start"]:x["end"]], x["edits"]) for x in L.scan_text(text, scanner())[7] if x["label"] == "reserved"]
    assert spans == [("all rights reservd", 1), ("all rights reserved", 0), ("all right reserved", 1),
                     ("all rights reserved", 0)]
    i = next(i for i, (_, x) in enumerate(L.NOTICES) if x == "all rights reserved")
    assert [e for _, _, e in scanner().verify(i, " all rights reservd all rights reserved ")] == [1, 0]
