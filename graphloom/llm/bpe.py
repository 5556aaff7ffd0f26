"""Ids of a tokenizer file with the tokenizers library, a word at a time where that is the same.

A token never crosses a match of the byte-level pre-tokenizer's pattern. Texts
of Latin letters are cut by the same pattern here; what it matches is encoded
by the library once and looked up afterwards. Of other texts, which Python's
patterns cannot cut, the pieces between spaces that stand before a non-space
are split and encoded by the library once. Such a text with other white space
after a space, and every text with something that might be an added token, goes
to the library whole; so does every text where the file has a normaliser,
another pre-tokenizer or another model.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode

import numpy as np

#: Pieces and parts that a worker remembers before it starts anew.
MOST_PIECES = 900_000

#: Control characters that Python, but not the library, may count as white space.
_ODD = re.compile(r"[\x1c-\x1f\x85]")
#: The byte-level pre-tokenizer's pattern for given letters, digits and spaces; a fixed value of the format.
_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_ASCII = re.compile(_PATTERN.format(L="A-Za-z", N="0-9", S=r"\t-\r "))
#: Up to U+024F and the marks of _OTHER, Unicode has these letters, digits and spaces.
_LATIN = re.compile(_PATTERN.format(L="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", N="0-9\xb2\xb3\xb9\xbc-\xbe", S=r"\t-\r \x85\xa0"))
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
#: Its letters for the 256 bytes, those that are not printed moved up; a fixed value of the format.
_LETTERS = "".join(chr(256 + b if b < 33 else 162 + b if 127 <= b <= 160 else 323 if b == 173 else b) for b in range(256))
_WORKERS: dict[tuple, Encoder] = {}


class _Whole(Exception):
    """The text has to be encoded as a whole."""


class _Parts(dict):
    """Ids of the matches of the pattern seen so far; a new one is encoded when it is asked for."""

    def __init__(self, bpe: Encoder) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, part: str) -> bytes:
        found = self[part] = self.bpe.of_part(charmap_decode(part.encode(), "strict", _LETTERS)[0])
        return found


class _Pieces(dict):
    """Ids of the pieces of texts that are not Latin, as seen so far; a new one is encoded when it is asked for."""

    def __init__(self, bpe: Encoder) -> None:
        super().__init__()
        self.bpe, self.parts = bpe, {}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or _ODD.search(word):
            raise _Whole
        found = self[word] = self.encode(" " + word)
        return found

    def encode(self, piece: str) -> bytes:
        if (cut := latin(piece)) is not None:
            return b"".join(map(self.bpe.parts.__getitem__, cut))
        return b"".join([self.parts.get(x) or self.part(x) for x, _ in self.bpe.split(piece)])

    def part(self, part: str) -> bytes:
        found = self.parts[part] = self.bpe.of_part(part)
        return found


def latin(text: str) -> list[str] | None:
    """The text as the pattern cuts it, or None where it may have other letters, digits or spaces."""
    if text.isascii():
        return _ASCII.findall(text)
    return None if _OTHER.search(text) else _LATIN.findall(text)


def by_pieces(path: str) -> bool:
    """Whether the file is a byte-level BPE whose texts may be cut at spaces before they are encoded."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return plain and made.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")


class Encoder:
    """Encoder of one worker process; ``encode`` returns little-endian ids of ``dtype``."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model, self.cut = self.tokenizer.model, by_pieces(path)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.cut else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [] if special_as_text else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.parts = _Pieces(self), _Parts(self)

    def of_part(self, part: str) -> bytes:
        """Ids of a match of the pattern, in the format's letters."""
        return array(self.code, [x.id for x in self.model.tokenize(part)]).tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.parts) + len(self.pieces) + len(self.pieces.parts) > MOST_PIECES:
            self.pieces, self.parts = _Pieces(self), _Parts(self)
        try:
            if not self.cut or any(x in text for x in self.added):
                raise _Whole
            if (cut := latin(text)) is not None:
                return b"".join(map(self.parts.__getitem__, cut))
            first, *words = text.split(" ")
            if _ODD.search(first) or first[-1:].isspace() and not words:
                raise _Whole
            return self.pieces.encode(first) + b"".join(map(self.pieces.__getitem__, words))
        except _Whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file; made once a process."""
    key = (path, special_as_text)
    if key not in _WORKERS:
        _WORKERS[key] = Encoder(path, special_as_text)
    return _WORKERS[key]
