"""License scan: fuzzy search for short notices.

A notice may stand in a text with up to ``k`` edits. Cut into ``k + 1`` pieces,
one piece at least stands there unchanged (pigeonhole), so an Aho-Corasick pass
over the words of the text finds every place worth a look; the regex library's
bounded-error matching then verifies the window around it and reports the span.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased
in A-Z; they are joined by single spaces before the search, so line breaks and
signs between the words of a notice don't matter.

Odd input: a null or empty text has no word and no label; repeated rows and
null ids get a row each; input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import without, worker_state

# Phrases of the contract and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices as they open well-known public licenses: fixed values.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("epl", "the eclipse public license"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "licensed under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "free and unencumbered software released into the public domain"),
]
EDIT_EVERY = 10  # one edit is allowed per so many characters of a notice

RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
ROW = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
       "spans array<struct<label:string,notice:string,start:int,end:int,edits:int>>")

# what isn't a word character, A-Z to lower case; bytes from 0x80 on stay
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_text(text: str | None) -> str:
    """The words of a text with one space around each."""
    words = (text or "").encode().translate(_FOLD).split()
    return f" {b' '.join(words).decode()} " if words else ""


def pigeonhole(notice: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 parts of a notice."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeScanner:
    """Seeds, patterns and the memo of verified windows of one worker."""

    def __init__(self, notices: list[tuple[str, str]], base: dict[str, str], edit_every: int):
        import ahocorasick
        import regex
        self.notices, self.base = notices, base
        self.edits = [max(1, len(n) // edit_every) for _, n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, notice) in enumerate(notices):
            for offset, piece in pigeonhole(notice, self.edits[i]):
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        phrases = {f" {phrase} ": label for phrase, label in base.items()}
        for key in {*seeds, *phrases}:
            self.automaton.add_word(key, (len(key), phrases.get(key), seeds.get(key, [])))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?:{regex.escape(n, special_only=True)}){{e<={k}}}", regex.BESTMATCH)
                         for (_, n), k in zip(notices, self.edits)]
        self.verify = lru_cache(maxsize=50_000)(self._verify)

    def _verify(self, notice: int, window: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches in a window."""
        # the best match of a stretch need not be its first: what lies before it is searched as well
        found, todo, pattern = [], [(0, len(window))], self.patterns[notice]
        least = len(self.notices[notice][1]) - self.edits[notice]
        while todo:
            lo, hi = todo.pop()
            if hi - lo >= least and (m := pattern.search(window, lo, hi)):
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                todo += [(lo, m.start()), (max(m.end(), m.start() + 1), hi)]
        return sorted(found)

    def scan(self, norm: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Base places (position, label) and verified matches (notice, start, end, edits) in a normal text."""
        places, windows = [], {}
        for end, (size, label, of) in self.automaton.iter(norm):
            start = end + 1 - size
            if label:
                places.append((start, label))
            for i, offset in of:
                k, length = self.edits[i], len(self.notices[i][1])
                lo, hi = max(0, start - offset - k), min(len(norm), start - offset + length + k)
                own = windows.setdefault(i, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                    own[-1][0] = min(own[-1][0], lo)
                else:
                    own.append([lo, hi])
        matches = [(i, lo + a, lo + b, e) for i, own in windows.items() for lo, hi in own
                   for a, b, e in self.verify(i, norm[lo:hi])]
        return places, matches


def _places_in_text(text: str, norm: str, scanner: NoticeScanner, matches: list) -> list[dict]:
    """Spans in the text itself, by way of word numbers."""
    words = [m.span() for m in _WORD.finditer(text)]
    spans = []
    for i, a, b, edits in matches:
        while a < b and norm[a] == " ":
            a += 1
        while b > a and norm[b - 1] == " ":
            b -= 1
        first, last = norm.count(" ", 0, a) - 1, norm.count(" ", 0, b) - 1
        label, notice = scanner.notices[i]
        spans.append({"label": label, "notice": notice, "start": words[max(first, 0)][0],
                      "end": words[max(last, 0)][1], "edits": edits})
    return sorted(spans, key=lambda s: (s["start"], s["end"], s["label"], s["notice"]))


def scan_text(text: str | None, scanner: NoticeScanner) -> tuple:
    norm = normal_text(text)
    if not norm:
        return 0, 0, None, None, "", "", 0.0, []
    places, matches = scanner.scan(norm)
    n_words = norm.count(" ") - 1
    if not places and not matches:
        return n_words, 0, None, None, "", "", 0.0, []
    starts = sorted(norm.count(" ", 0, p) for p, _ in places)
    base = {label for _, label in places}
    labels = base | {scanner.notices[i][0] for i, *_ in matches}
    score = 1.0 if places else max(1 - e / len(scanner.notices[i][1]) for i, _, _, e in matches)
    return (n_words, len(places), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)),
            ",".join(sorted(labels)), score, _places_in_text(text, norm, scanner, matches))


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] | None = None, edit_every: int = EDIT_EVERY,
                  text_col: str = "text") -> DataFrame:
    """Add word counts, places of the base phrases, labels, a score and the spans of fuzzy notices to every row."""
    notices = NOTICES if notices is None else notices
    docs = without(docs, RESULTS)

    @F.pandas_udf(ROW)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = f"notices_{abs(hash((tuple(notices), edit_every)))}"
        scanner = worker_state(key, lambda: NoticeScanner(notices, BASE, edit_every))
        for texts in batches:
            out = pd.DataFrame([scan_text(t, scanner) for t in texts], columns=RESULTS)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    found = docs.withColumn("__llm_found", scan(text_col))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "__llm_found.*")
