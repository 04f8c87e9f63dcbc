"""Whole-text token ids from a published vocabulary, with repeated words encoded once."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"

#: A space that is not alone between two non-spaces: there the pre-tokenizer's cut depends on the neighbours.
ODD_SPACE = re.compile(r"^ | $|\s | \s")
#: Fixed value: the byte-level pre-tokenizer's pattern.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
OLD_ALPHABETS = "\u0250"
CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of byte-pair vocabularies: printable bytes stand for themselves, others follow at 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Made values by key: the first ``size`` for good, then the latest few."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.late = make, size, {}

    def __missing__(self, key):
        value = self.late.get(key)
        if value is None:
            value = self.make(key)
            if len(self) < self.size:
                self[key] = value
            else:
                if len(self.late) > self.size // 8:
                    self.late.clear()
                self.late[key] = value
        return value


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts.

    The byte-level pre-tokenizer always cuts before a lone space between two non-spaces, so the ids of a text are those
    of its pieces between such spaces, in turn. A piece that is not in the memory is cut at the pre-tokenizer's pattern
    where all its characters are of the old alphabets, on whose classes all Unicode versions agree, and the library's
    model encodes each part; the library encodes any other piece whole, and whole any text that holds an added
    token's string. The size of the memory changes the speed only.
    """

    def __init__(self, path: str, memory: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.space = self.letters[ord(" ")]
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.known = Memory(self._piece, memory)  # after a space
        self.bare = Memory(self._model, memory // 8)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, part: str) -> bytes:
        """One pre-token."""
        return self._ids(part.encode().decode("latin-1").translate(self.letters))

    def _ids(self, letters: str) -> bytes:
        """One pre-token in the byte-level alphabet."""
        known = self.id_bytes
        return b"".join([known[t.id] for t in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._ids(self.space + piece) if piece.isascii() else self._model(" " + piece)
        if max(piece) >= OLD_ALPHABETS:
            return self._library(" " + piece)
        parts = PRE_TOKEN.findall(" " + piece)
        return b"".join([(self.known[p[1:]] if p[1:].isalpha() and p[0] == " " else self.bare[p]) for p in parts])

    def encode(self, text: str | None) -> bytes:
        """The ids of one text; null and empty texts have none."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self._library(text)
        pieces = text.split(" ")
        lone = text.replace("\n", " ").split(" ") == text.split()  # all white space is single blanks and line ends inside the text
        if not lone and ODD_SPACE.search(text):
            pieces = CLEAN_SPACE.split(text)
        first, pieces[0] = pieces[0], pieces[-1]  # the first has no space before it
        ids = list(map(self.known.__getitem__, pieces))
        ids[0] = self._library(first)
        return b"".join(ids)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
