"""Encoding with public tokenizer files, with the ids of frequent words kept per Python worker."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"

# Fixed patterns of the two vocabularies' pre-tokenisers.
_WORD_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BYTE_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = re.compile("[" + "".join(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_NOT_PLAIN = re.compile(f"[{chr(0x130)}{chr(0x300)}-{chr(0x10FFFF)}]|<\\|")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # a run of these ends a word of letters as a run of its own
_SLICE = 1 << 20  # characters of a text that are split into words at a time

MAX_WORDS, MAX_RUNS = 120_000, 200_000  # entries kept per worker: about 60 MB


def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level models use for each byte: itself if printable, else the next free from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def visible(text: str) -> str:
    if text.isascii() and text.isalpha():  # every byte is its own letter
        return text
    return text.encode().decode("latin-1").translate(_byte_letters())


def slices(text: str) -> Iterator[str]:
    """``text`` in stretches of about ``_SLICE`` characters that end before white space."""
    at = 0
    while len(text) - at > _SLICE:
        cut = _SPACE.search(text, at + _SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class _Runs(dict):
    """Pre-token to the model's ids, as little-endian 32-bit bytes."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, run: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(visible(run))]
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < MAX_RUNS:
            self[run] = ids
        return ids


class WordEncoder(dict):
    """Ids of a text under ``word_bpe_49k.json``, word by word.

    That tokenizer drops white space and has no pattern that spans it, so a
    text's ids are those of its words in turn.  A word of plain letters is cut by
    the fixed pattern and its runs go to the library's model; any other word
    (combining marks, letters beyond U+02FF, a special string) goes to the
    library whole.
    """

    def __init__(self, file: str):
        self.whole = tokenizer(file)
        self.runs = _Runs(self.whole.model)

    def __missing__(self, word: str) -> bytes:
        if not (word.isascii() and "<|" not in word) and _NOT_PLAIN.search(word):
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            runs, low = self.runs, word.lower()
            head = low if low.isalpha() else low.rstrip(_MARKS)
            if head.isalpha():  # letters, then marks: most words
                ids = runs[head] if head is low else runs[head] + runs[low[len(head) :]]
            else:
                ids = b"".join([runs[r] for r in _WORD_RUNS.findall(low)])
        if len(self) < MAX_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids in stretches, as little-endian 32-bit bytes."""
        for part in slices(text):
            words = _SPACE.split(part) if _OTHER_SPACE.search(part) else part.split()
            yield b"".join([self[w] for w in words])


class _RunCounts(dict):
    def __init__(self, model):
        self.model = model

    def __missing__(self, run: str) -> int:
        n = len(self.model.tokenize(visible(run)))
        if len(self) < MAX_RUNS:
            self[run] = n
        return n


class PieceCounter(dict):
    """Token counts under ``byte_bpe_50k.json`` of stretches that start at a proven boundary.

    Between a character that is no white space and a blank that follows, this
    tokenizer always cuts: no alternative of its pattern takes white space
    after anything else, and matching looks ahead only.  So a text is the
    sequence of its stretches that begin with such a blank, each counted alone.
    """

    def __init__(self, file: str):
        self.whole = tokenizer(file)
        self.runs = _RunCounts(self.whole.model)

    def __missing__(self, piece: str) -> int:
        """``piece`` without its leading blank."""
        n = self.count_whole(" " + piece)
        if len(self) < MAX_WORDS:
            self[piece] = n
        return n

    def count_whole(self, text: str) -> int:
        if "<|" in text:
            return len(self.whole.encode(text, add_special_tokens=False))
        runs = self.runs
        return sum([runs[r] for r in _BYTE_RUNS.findall(text)])

    def count(self, text: str) -> int:
        first, *rest = text.split(" ")
        if "" in rest or any(map(_ends_blank, rest)) or not first or first[-1].isspace():
            first, *rest = _joined(first, rest)
        return self.count_whole(first) + sum([self[p] for p in rest])


def _ends_blank(piece: str) -> bool:
    return piece[-1:].isspace()


def _joined(first: str, rest: list[str]) -> list[str]:
    """Join what was split at a blank that follows white space."""
    out = [first]
    for p in rest:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


@lru_cache(4)
def word_encoder(file: str) -> WordEncoder:
    """One per Python worker: workers are used again by later tasks."""
    return WordEncoder(file)


@lru_cache(4)
def piece_counter(file: str) -> PieceCounter:
    return PieceCounter(file)
