"""Token ids of whole texts with a public tokenizer whose pieces end at white space.

Such a tokenizer gives a chunk between white space the same ids wherever it
stands, so ids are looked up per chunk; the chunks that a batch brings for the
first time are encoded together, joined by a separator that no chunk holds.
A chunk of letters, with a sign at its end or without, is most of any text: where the vocabulary
treats letters and signs apart and folds case (tried on probes when it is loaded), the merges are applied to its letters directly.

The memo of a worker outlives its tasks and is bounded in bytes: it has a young
and an old half; when the young one is full it becomes the old one, and what is
still in use moves back. Long chunks are never kept.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
from collections.abc import Iterable
from unicodedata import is_normalized

import numpy as np

from orgweave.llm.common import worker_state

MEMO_BYTES = 128_000_000  # a worker's memo: chunks, ids and about ENTRY_BYTES for the objects of each
ENTRY_BYTES = 220
LONG_CHUNK = 1000  # characters from which a chunk isn't kept
SEPARATOR = "\x01"
SIGNS = ".,;:!?"
PROBES = ["a", "the", "zqxj", "reading", "TheOrder", "Été", "großen", "año", "日本語", "ж", "ſt", "nǅ"]


def _byte_letters() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies, by the byte's Latin-1 character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the worker finds the named vocabulary."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, one bytes object per text."""

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # with plain_specials the strings of special tokens are ordinary text
        self.tokenizer.encode_special_tokens = plain_specials
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.separator = np.array(self._ids(SEPARATOR), dtype="<u4")
        if len(self.separator) != 1:
            raise ValueError("the separator must be one token")
        bare = json.loads(self.tokenizer.to_str())
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}
        self.merges, self.letters = Tokenizer.from_str(json.dumps(bare)), _byte_letters()
        self.signs = {c: np.array(self._ids(c), dtype="<u4").tobytes() for c in SIGNS} | {"": b""}
        # the tokens that end a word
        suffix, vocabulary = bare["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closing[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        # whether letters may be merged directly
        self.direct = bool(suffix) and all(
            self._merged([w.lower()])[w.lower()] + after == np.array(self._ids(w + c), dtype="<u4").tobytes()
            for w in PROBES for c, after in self.signs.items())

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of letters without the detour over normalisation and splitting."""
        found = {}
        for at in range(0, len(words), 100_000):
            part = words[at:at + 100_000]
            text = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in part])
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self.closing[ids]) + 4).tolist()
            if len(ends) != len(part):
                raise ValueError("a word of letters was split")
            raw, last = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                found[w] = raw[last:end]
                last = end
        return found

    def _plain(self, chunk: str) -> tuple[str, str] | None:
        """The word and the sign of a chunk of letters with at most one sign at its end; None for any other chunk."""
        sign = chunk[-1] if chunk[-1:] in self.signs else ""
        word = chunk[:-1] if sign else chunk
        if not word.isalpha():
            return None
        # lower case may depend on neighbours, or give more than letters
        if not word.isascii() and ("Σ" in word or not word.lower().isalpha() or not is_normalized("NFC", word)):
            return None
        return word, sign

    def _learned(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk."""
        if not self.direct:
            return self._encoded(chunks)
        found, plain, rest, words = {}, [], [], {}
        for c in chunks:
            p = self._plain(c)
            if p is None:
                rest.append(c)
                continue
            low = p[0].lower()
            plain.append((c, low, p[1]))
            if low not in words:
                words[low] = self.known.get(low) or self.old.get(low)
        # a word is merged once, whatever its case and the sign after it
        words |= self._merged([w for w, ids in words.items() if ids is None])
        for c, low, sign in plain:
            found[c] = words[low] + self.signs[sign] if sign else words[low]
        return found | self._encoded(rest)

    def _encoded(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk by the whole tokenizer."""
        joined = [c for c in chunks if SEPARATOR not in c and "<|" not in c]
        found = {c: np.array(self._ids(c), dtype="<u4").tobytes() for c in chunks if SEPARATOR in c or "<|" in c}
        for at in range(0, len(joined), 20_000):
            part = joined[at:at + 20_000]
            text = f" {SEPARATOR} ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.separator[0])
            if len(cuts) != len(part) - 1:
                raise ValueError("a chunk holds the separator's id")
            raw, last = ids.tobytes(), 0
            for c, cut in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                found[c] = raw[4 * last:4 * cut]
                last = cut + 1
        return found

    def _keep(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)

    def rest(self) -> None:
        """Give a finished task's buffers back to the system; the memo stays for the next one."""
        import pyarrow
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
            ctypes.CDLL(None).malloc_trim(0)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        rows = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if self.size > MEMO_BYTES // 2:
            self.old, self.known, self.size = self.known, {"": b""}, 0
        new = set()
        for r in rows:
            new.update(r)
        new.difference_update(self.known.keys())
        if self.old:
            self._keep({c: self.old[c] for c in new & self.old.keys()})
            new.difference_update(self.known.keys())
        long = [c for c in new if len(c) > LONG_CHUNK]
        new.difference_update(long)
        if new:
            self._keep(self._learned(list(new)))
        known = self.known
        if long:
            known = known | self._learned(long)
        return [b"".join(map(known.__getitem__, r)) for r in rows]


def encoder(path: str, plain_specials: bool = False) -> ChunkEncoder:
    """The worker's own encoder for a vocabulary file."""
    key = f"encoder_{abs(hash((path, plain_specials)))}"
    return worker_state(key, lambda: ChunkEncoder(path, plain_specials))


def slices(texts: list, most: int = 4_000_000) -> Iterable[slice]:
    """Runs of texts of about ``most`` characters together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))
