r"""Chat formatting with a grammar round trip.

Template: a user turn is ``[INST] text [/INST]``, an assistant turn is
``<s> text </s>``, any other role is ``<<SYS role>> text <</SYS>>``; turns follow
each other without a break. A deterministic parser reads the rendered string
back. Where the recovered turns differ from the source, because a text holds a
control string or an escape, the turns at fault are escaped (a backslash before
every backslash, ``[`` and ``<``) and the string is rendered and parsed again,
until both are identical.

Conversations are put together by sorting the rows of a key and reading them as
a stream, ``PART_CHARS`` characters at a time, so a conversation of any length
needs bounded memory; a long one comes out as several parts in order.

Odd input: a null text is empty, a null role is the empty role, rows with a null
conv_id form one conversation; turns sort by turn (nulls first), then role and
text, so ties and repeated rows have a fixed order and all stay; an empty table
gives no rows; other input columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1_000_000

Turn = tuple[str, str]

# What the parser looks for: an escaped character, or a control string.
_TOKEN = re.compile(r"\\[\\\[<]|\[/?INST\]|</?s>|<<SYS |<</SYS>>|>>")
_ESCAPED = re.compile(r"\\([\\\[<>])")
_OPENS = {"[INST]": "[/INST]", "<s>": "</s>", "<<SYS ": "<</SYS>>"}
_ROLE_OF = {"[INST]": "user", "<s>": "assistant"}


def escape(text: str) -> str:
    return re.sub(r"[\\\[<]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str, escaped: bool) -> str:
    body = escape(text) if escaped else text
    if role == "user":
        return f"[INST] {body} [/INST]"
    if role == "assistant":
        return f"<s> {body} </s>"
    # a role in brackets of its own is escaped at all times, its closing bracket too
    return f"<<SYS {escape(role).replace('>', chr(92) + '>')}>> {body} <</SYS>>"


class Unreadable(ValueError):
    """The rendered string doesn't follow the grammar."""


def parse(rendered: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of every turn's body in a rendered string."""
    turns, at = [], 0
    while at < len(rendered):
        opening = next((o for o in _OPENS if rendered.startswith(o, at)), None)
        if opening is None:
            raise Unreadable(f"no turn opens at {at}")
        at += len(opening)
        role = _ROLE_OF.get(opening)
        if role is None:
            end = at
            while not rendered.startswith(">>", end):
                end += 2 if rendered.startswith("\\", end) else 1
                if end >= len(rendered):
                    raise Unreadable("a role doesn't end")
            role = unescape(rendered[at:end])
            at = end + 2
        for m in _TOKEN.finditer(rendered, at):
            if m[0][0] == "\\" or m[0] == ">>":
                continue
            if m[0] != _OPENS[opening]:
                raise Unreadable(f"{m[0]} inside a turn")
            break
        else:
            raise Unreadable("a turn doesn't end")
        if rendered[at:at + 1] != " " or m.start() - 1 <= at - 1 or rendered[m.start() - 1] != " " or m.start() - at < 2:
            raise Unreadable("a body without its spaces")
        turns.append((role, at + 1, m.start() - 1))
        at = m.end()
    return turns


def read_back(rendered: str) -> list[Turn]:
    return [(role, unescape(rendered[a:b])) for role, a, b in parse(rendered)]


def round_trip(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered string whose parse equals ``turns``, and the loss spans (assistant bodies) in it."""
    rendered = "".join(render_turn(r, t, False) for r, t in turns)
    try:
        same = read_back(rendered) == turns
    except Unreadable:
        same = False
    if not same:
        # the turns that can't be told from their rendering alone are at fault
        faulty = []
        for role, text in turns:
            try:
                faulty.append(read_back(render_turn(role, text, False)) != [(role, text)])
            except Unreadable:
                faulty.append(True)
        rendered = "".join(render_turn(r, t, f) for (r, t), f in zip(turns, faulty, strict=True))
        if read_back(rendered) != turns:
            raise Unreadable("escaped turns don't read back")
    return rendered, [(a, b) for role, a, b in parse(rendered) if role == "assistant"]


def _key(value: object) -> object:
    return None if pd.isna(value) else value


def _sorted_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[Turn]]]:
    """(conv_id, turns) runs of a sorted stream, at most about PART_CHARS characters each."""
    key, turns, size = None, [], 0
    for pdf in batches:
        for conv, role, text in zip(pdf["conv_id"].tolist(), pdf["role"], pdf["text"], strict=True):
            conv = _key(conv)
            if turns and (conv != key or size > PART_CHARS):
                yield key, turns
                turns, size = [], 0
            key = conv
            turns.append((role or "", text or ""))
            size += len(text or "")
    if turns:
        yield key, turns


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_spans; the parts of a conversation stay in one partition, in order."""

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part, out = object(), 0, []
        for conv, turns in _sorted_rows(batches):
            part = part + 1 if conv == last else 0
            last = conv
            formatted, spans = round_trip(turns)
            out.append((conv, part, len(turns), formatted, [{"start": a, "end": b} for a, b in spans]))
            if len(out) >= 500 or len(formatted) > PART_CHARS:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["conv_id", "part", "n_turns", "formatted", "loss_spans"])
        return pdf.assign(conv_id=pd.array([x[0] for x in out], dtype="Int64"))

    turns = rows.select("conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInPandas(
        render, "conv_id long, part int, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the parts as format_conversations leaves them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for pdf in batches:
            for conv, text, spans in zip(pdf["conv_id"].tolist(), pdf["formatted"], pdf["loss_spans"], strict=True):
                conv = _key(conv)
                if state is None or conv != key:
                    if state:
                        out.append((key, *close(state)))
                    key, state = conv, [0, sha256(), 0, sha256(), 0]
                for role, a, b in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{unescape(text[a:b])}\n".encode())
                for s in spans:
                    own = unescape(text[s["start"]:s["end"]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(text)
            if out:
                yield frame(out)
                out = []
        if state:
            yield frame([(key, *close(state))])

    def close(state: list) -> tuple:
        return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def frame(out: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                         "formatted_chars"])
        return pdf.assign(conv_id=pd.array([x[0] for x in out], dtype="Int64"))

    return formatted.mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def planted(spark) -> DataFrame:
    """Conversation -7: both texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(text).alias("text"))
