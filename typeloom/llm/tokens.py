"""Token ids by the tokenizers library, with a word cache in each Python worker.

Both vocabularies split a text into pieces that never cross a space between two non-space characters,
so a text's ids are the ids of its space-separated chunks in a row. Chunks of plain letters go to the
vocabulary's BPE model directly; any other chunk goes through the tokenizer's whole pipeline.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from typeloom.llm.common import hold_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A worker keeps so many bytes of chunks and ids; longer chunks and tails are not kept.
CACHE_BYTES = 256 << 20
LONG_CHUNK, LONG_TAIL = 64, 4

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"([{_LETTERS}]+)([.,;:!?|]*)")
_SPACES_MEET = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    """Chunk to little-endian unsigned 32-bit ids; a missing chunk is encoded on demand.

    Half of the bytes are those of the chunks met of late, half those met before: when the first half is full
    it takes the place of the second, from which chunks that are met again come back.
    """

    def __init__(self, owner: "Encoder", lead: str, limit: int):
        super().__init__()
        self.owner, self.lead, self.limit, self.held = owner, lead, limit // 2, 0
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk) if self.before else None
        if found is None:
            if chunk[:1] == "\n" and self.lead:  # a line's start: the line feed is a piece of its own
                found = self.owner.line_feed + self.owner.encode_chunk(chunk[1:])
            else:
                found = self.owner.encode_chunk(self.lead + chunk)
        if len(chunk) <= LONG_CHUNK:
            if self.held > self.limit:
                self.before, self.held = dict(self), 0
                self.clear()
            self[chunk] = found
            self.held += 4 * len(chunk) + len(found) + 150  # with the objects and their share of the table
        return found


class Encoder:
    """Whole texts to ids with a vocabulary file of the tokenizers library, add_special_tokens=False."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size()
        probe = self._pipeline("a b"), self._pipeline("ab")
        self.drops_space = self._pipeline("a b") == self._pipeline("a  b")
        self.folds_case = self._pipeline("A") == self._pipeline("a")
        self.letters = _byte_letters()
        self.plain = len(probe[0]) > 0 and sys.byteorder == "little"
        self.first, self.later = _Chunks(self, "", cache_bytes // 8), _Chunks(self, "" if self.drops_space else " ", cache_bytes // 8 * 7)
        self.tails: dict[str, bytes] = {}
        self.line_feed = self._pipeline("\n")

    def _pipeline(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        lead = chunk[:1] == " "
        match = self.plain and _PLAIN.fullmatch(chunk, 1 if lead else 0)
        if not match:
            return self._pipeline(chunk)
        word, tail = match.groups()
        ids = self._letters((" " if lead else "") + (word.lower() if self.folds_case else word))
        if len(tail) > LONG_TAIL:
            ids += self._pipeline(tail)
        elif tail:
            if tail not in self.tails:
                self.tails[tail] = self._pipeline(tail)
            ids += self.tails[tail]
        return ids

    def encode(self, text: str | None) -> bytes:
        """All ids of a text (null: none) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.later.__getitem__, text.replace("\n", " ").split(" ")))
        chunks = _CUT.split(text) if _SPACES_MEET.search(text) else text.replace("\n", " \n").split(" ")
        return self.first[chunks[0]] + b"".join(map(self.later.__getitem__, chunks[1:]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file; kept until the worker serves an operator with another cache."""
    hold_cache("chunks", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Path of a file of the public_tokenizers package, looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)
