"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words kept with their ids by a Python worker; beyond that they are forgotten and encoded anew. Longer ones aren't kept.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64
#: Rows whose ids a worker holds at a time.
PART = 256
_PIECE = re.compile(r" (?=\S)")
_LINES = re.compile(r"((?<=\S)\n+(?=\S))")
#: Signs that end a token of letters and are never part of one with letters or digits.
_SIGNS = ".,;:!?%#*$&|"
_ASCII_MEETS = [" " + x for x in "\t\n\v\f\r\x1c\x1d\x1e\x1f"]
_LATIN_END = "\u0250"
_encoders: dict[str, WordEncoder] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class _Words(dict):
    """Ids of words that follow `before`, as bytes; encoded when first met.

    A word's lines, and letters and the signs after them, are tokens apart: it is put together from theirs.
    """

    def __init__(self, tokenizer, model, before: str, cuts: bool):
        super().__init__()
        self.tokenizer, self.model, self.before, self.cuts, self.letters = tokenizer, model, before, cuts, _byte_letters()
        self.head = before.translate({32: "\u0120"})
        #: Words that nothing stands before, and runs of line ends that a word follows.
        self.first: _Words = self
        self.runs: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(_SIGNS)
        if not self.cuts:
            out = self._whole(word)
        elif stem.isalpha() and (stem.isascii() or max(stem) < _LATIN_END):
            if len(stem) < len(word):
                out = self[stem] + self.first[word[len(stem) :]]
            else:
                raw = self.head + word if word.isascii() else (self.before + word).encode().decode("latin-1").translate(self.letters)
                out = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        elif "\n" in word and len(parts := _LINES.split(word)) > 2 and parts[0] and parts[-1] and not parts[0][0].isspace():
            out = self[parts[0]] + b"".join(self._run(x) if k % 2 == 0 else self.first[x] for k, x in enumerate(parts[1:]))
        else:
            out = self._whole(self.before + word)
        if len(word) <= CACHE_CHARS:
            self[word] = out
        return out

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, lines: str) -> bytes:
        if lines not in self.runs:
            self.runs[lines] = self._whole(lines + "a")[:-4]
        return self.runs[lines]


def _spaces_meet(text: str, rest: list[str]) -> bool:
    """Whether a word that follows a space begins with white space itself."""
    if text.isascii():
        return any(x in text for x in _ASCII_MEETS)
    return any(not x[0].isalnum() and x[0].isspace() for x in rest)


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts.

    With a byte-level BPE file whose pre-tokenizer starts a token at each space that a non-space follows, a text has
    the ids of its pieces, cut there; so a worker encodes a frequent word once. Texts that hold an added token, such as
    <|endoftext|>, and those of other files are encoded whole: the ids are always the library's own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and self.tokenizer.normalizer is None
        model = self.tokenizer.model
        if self.cuts:
            model._resize_cache(0)  # words are kept here
        self.first, self.after = (_Words(self.tokenizer, model, before, self.cuts) for before in ("", " "))
        self.after.first = self.first

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        if not text:
            return b""
        if not self.cuts or any(x in text for x in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        if not all(rest) or (not text.isprintable() and _spaces_meet(text, rest)):
            first, *rest = _PIECE.split(text)
        if len(self.first) + len(self.after) > CACHE_WORDS:
            self.first.clear()
            self.after.clear()
        head = self.first[first] if first else b""
        return head + b"".join(map(self.after.__getitem__, rest))


def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, one for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in parts of PART rows, with the ids of their texts (null: empty), each followed by the end id."""
    words, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        for a in range(0, batch.num_rows, PART):
            part = batch.slice(a, PART)
            yield part, [words.ids(x or "") + end for x in part.column(text).to_pylist()]
