import random
from collections import defaultdict
from hashlib import sha256

import pytest

from orgweave.llm import chat as C

PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS ", "<</SYS>>", ">>", "\\", "[", "<", " ", "ok", "é", "\n", "", "\\["]


def digests(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in held.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     sha256(loss.encode()).hexdigest())
    return out


def test_any_text_survives():
    rng = random.Random(11)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "a>>b", "x\\", "[INST]"]),
                  "".join(rng.choice(PARTS) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(5))]
        rendered, loss = C.round_trip(turns)
        assert C.read_back(rendered) == turns
        assert [C.unescape(rendered[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_plain_text_is_not_escaped():
    assert C.round_trip([("user", "a < b [1] \\ c"), ("assistant", "x")])[0] == "[INST] a < b [1] \\ c [/INST]<s> x </s>"


@pytest.mark.parametrize("bad", ["x", "[INST] a", "<s> a [/INST]", "[INST][/INST]", "<<SYS a", "[INST] <s> [/INST]"])
def test_the_parser_refuses(bad):
    with pytest.raises(C.Unreadable):
        C.parse(bad)


def test_conversations_and_odd_input(spark, monkeypatch):
    rows = [(1, 1, "assistant", "b" * 70), (1, 0, "user", "a</s>"), (1, 2, "user", None), (1, None, None, "sys"), (2, 0, None, ""),
            (None, 0, "user", "x"), (None, 1, "assistant", "\\["), (3, 0, "assistant", "t"), (3, 0, "assistant", "t"),
            (3, 0, "assistant", "s")] + [(5, i, ("user", "assistant")[i % 2], "word " * 20) for i in range(50)]
    schema = "conv_id long, turn long, role string, text string"
    for most in (1_000_000, 100):  # the second cuts long conversations into parts
        monkeypatch.setattr(C, "PART_CHARS", most)
        parts = C.format_conversations(spark.createDataFrame(rows, schema).unionByName(C.planted(spark)))
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(parts).collect()}
        assert got == digests(rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert parts.where("conv_id = 5").count() > 1
    assert C.digests(C.format_conversations(spark.createDataFrame([], schema))).count() == 0
