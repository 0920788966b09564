import random
import re
import zlib
from functools import lru_cache
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from orgweave.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(codes):
    """(cost, audit) by recursion over all edits, with fewer inserts than could ever pay."""
    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(codes) and state in (C.NOTHING, C.ASSISTANT) else []
        if inserts < 2:
            found += [(3 + c, "I" + a) for c, a in [best(i, C.NEXT[state], inserts + 1)]]
        if i < len(codes):
            k = codes[i]
            found += [(4 + c, "D" + a) for c, a in [best(i + 1, state, 0)]]
            if k not in C.GONE:
                more = 3 if k in C.CUT else 0
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(k.lower(), {}).get(state)
                if kept is not None:
                    found += [(more + c, "K" + a) for c, a in [best(i + 1, kept, 0)]]
                found += [(3 + more + c, "R" + a) for c, a in [best(i + 1, C.NEXT[state], 0)]]
        return min(found, default=(10 ** 9, ""))
    return best(0, C.NOTHING, 0)


def all_codes(n):
    return [""] if n == 0 else [a + b for a in "suaxSUA1" for b in all_codes(n - 1)]


def test_every_short_conversation():
    for n in range(4):
        for codes in all_codes(n):
            assert C.audit_of(codes) == brute(codes), codes


def test_long_ones_and_pieces_of_any_size():
    rng = random.Random(1)
    for _ in range(400):
        codes = "".join(rng.choice("suauaxSUAX1230ua") for _ in range(rng.randrange(1, 40)))
        want = brute(codes)
        assert C.audit_of(codes) == want
        size = rng.randrange(1, 12)
        cost, audits = C.joined([C.ways(codes[i:i + size]) for i in range(0, len(codes), size)])
        assert (cost, "".join(audits)) == want, (codes, size)
        # a piece's audit holds its turns and what is inserted before each
        assert [len(a.replace("I", "")) for a in audits] == [len(codes[i:i + size]) for i in range(0, len(codes), size)]


def test_a_long_conversation_takes_linear_time():
    cost, audit = C.audit_of("u" + "uaUa" * 5000)
    assert len(audit) >= 20_000 and cost > 0


def plain_report(rows):
    """The whole contract for the rows of one conversation, in plain Python."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2].encode()).hexdigest()))
    codes, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    for _, role, text in kept:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                 "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        at = "sua".find(role[:1]) if role else -1
        codes += {None: "suax", "truncated": "SUAX"}.get(fault, "1230")[at]
    turns = {r[0] for r in kept} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    roles = [r[1][:1] for r in kept]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit = brute(codes) if kept else (0, "")
    lines, i, state = [], 0, 0
    for letter in audit:
        if letter in "IR":
            state = C.NEXT[state]
            lines.append(C.ROLE[state] + ":" + (kept[i][2] if letter == "R" else ""))
        elif letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[kept[i][1][0]]
            lines.append(f"{kept[i][1]}:{kept[i][2]}")
        i += letter != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            sha256("\n".join(lines).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows, piece_rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = C.with_empty(C.reports(C.damage(df), piece_rows), df)
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in got.collect()} == {k: plain_report(v) for k, v in convs.items()}
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2


def many_rows():
    rng = random.Random(2)
    rows = []
    for conv in range(250):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["system", "tool"]) if rng.random() < 0.1 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn + rng.randrange(2), role, rng.choice(["Yes.", "so", "é!", "Why? ", "end.\n", "one. two", ""])
                         + ("" if rng.random() < 0.3 else f"{turn}.")))
    long = [(900, t, ["user", "assistant"][t % 2], f"text {t}.") for t in range(90)]
    odd = [(None, 0, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b!"), (901, None, "user", "q?"),
           (901, None, "assistant", "r."), (902, 5, "", "x."), (902, 5, "", "x."), (902, 9_000_000_000, "user", None),
           (9_007_199_254_740_993, 1, "user", "big."), (903, 1, "system", "only."), (904, 2, "assistant", "w" * 200_000 + "."),
           (905, 3, "user", " \t\n"), (906, 1, "user", "same."), (906, 1, "user", "same."), (906, 1, "user", "same.")]
    return rows + long + odd


@pytest.mark.parametrize("piece_rows", [1024, 4])
def test_reports_against_plain_python(spark, piece_rows):
    check(spark, many_rows(), piece_rows)


def test_repaired_turns_are_whole(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "there."), (1, 2, "assistant", "yes."),
                                  (1, 3, "tool", "cut"), (2, 0, "assistant", "lone.")], SCHEMA)
    edits = C.edited_turns(rows, C.audits(C.faults(rows)))
    got = [tuple(r)[2:] for r in edits.where("conv_id = 1").orderBy("place").collect()]
    assert got == [("K", "user", "hi."), ("I", "assistant", ""), ("K", "user", "there."), ("K", "assistant", "yes."),
                   ("D", "tool", "cut")]
    assert [r.edit for r in edits.where("conv_id = 2").orderBy("place").collect()] == ["I", "K"]


def test_nothing_left_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.with_empty(C.reports(empty), empty).count() == 0
    rows = spark.createDataFrame([(4, None, None, None)], SCHEMA)
    got = C.with_empty(C.reports(rows.where("false")), rows).collect()
    assert [tuple(r) for r in got] == [(4, 0, 0, 0, 0, 0, 0, "", sha256().hexdigest())]


def test_other_columns_are_left_out(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], SCHEMA)
    crowded = rows.withColumns({c: F.lit("own") for c in ["seq", "fault", "first", "part", "codes", "place", "audit", "cost"]})
    assert C.reports(crowded).collect() == C.reports(rows).collect()
