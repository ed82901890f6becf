"""SentencePiece encoding by a streaming Viterbi search, and decoding.

Both kinds of model files are searched as a lattice of pieces with a backpointer for each end that is reached. In a
unigram model a path's worth is the sum of its scores. In a byte-pair model a path holds while each piece may follow
the one before it: two pieces may if merging the text of both, the best score first, gives these two. Merging a whole
text gives the only sequence of which every two neighbours do, so every end has one path, and its ids are the library's.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import numbered_columns, others

SPACE = "▁"
#: Loss of a character without a piece of its own, below the least score of any piece.
UNKNOWN_LOSS = 10.0
#: Characters after which a search that hasn't committed looks for a boundary that all its paths share.
LOOK = 64
CACHE_WORDS, CACHE_PAIRS = 600_000, 2_000_000
#: Stands for a text's beginning where the piece before one is asked for.
NOTHING = -1
_loaded: dict[str, Pieces] = {}


def _numbers(raw: bytes, wanted: int) -> Iterator[bytes | int]:
    """The values of one field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            value: bytes | int = number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            value, at = raw[at : at + size], at + size
        if tag >> 3 == wanted:
            yield value


def by_merging(path: str) -> bool:
    """Whether a model file is of the byte-pair kind; raises for kinds other than that and unigram."""
    with open(path, "rb") as file:
        trainer = next(_numbers(file.read(), 2), b"")
    kind = next(_numbers(trainer, 3), 1)
    if kind not in (1, 2):
        raise ValueError(f"{path} is neither a unigram nor a byte-pair model")
    return kind == 2


class Pieces:
    """The vocabulary of a model file: a tree of its pieces, their scores, and bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: A node: the nodes of further characters, and the id (-1 for none) and score of the piece that ends here.
        self.root: list = [{}, -1, 0.0]
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown = model.unk_id()
        self.merges = by_merging(path)
        self.id_of: dict[str, int] = {}
        self.pieces: dict[int, str] = {}
        self.scores: list[float] = []
        self.fits: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        least, self.longest, self.cuts = 0.0, 1, True
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.scores.append(model.get_score(i))
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            if model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
                continue
            self.bytes_of.append(piece.replace(SPACE, " ").encode())
            node, self.id_of[piece], self.pieces[i] = self.root, i, piece
            for c in piece:
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1], node[2] = i, model.get_score(i)
            least, self.longest = min(least, model.get_score(i)), max(self.longest, len(piece))
            self.cuts &= re.search(f"[^{SPACE}]{SPACE}", piece) is None
        self.unknown_score = least - UNKNOWN_LOSS
        self.after = _Words(self, SPACE)

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by merging: of all neighbours that make a piece the best one first, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.scores[i], k) for k, x in enumerate(zip(parts, parts[1:])) if (i := self.id_of.get(x[0] + x[1])) is not None]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fit(self, before: int, piece: int) -> bool:
        """Whether a piece may follow another one in a byte-pair model."""
        held = self.fits.setdefault(before, {})
        known = held.get(piece)
        if known is None:
            own = [self.pieces[x] for x in (before, piece) if x in self.pieces]
            known = held[piece] = self.merged("".join(own)) == own
            self.pairs += 1
        return known

    def search(self, text: str) -> Iterator[list[int]]:
        """The ids of the best segmentation of text (spaces written as SPACE), in runs, as soon as they are sure.

        best holds, for each end that is reached and lies after the last commit, (score, start, id); of equal scores
        the earlier start wins. In a byte-pair model only pieces that may follow the one before them count. When no piece reaches beyond the current place, or when the paths of all reached ends
        run through one boundary, ids before it are given out and forgotten. Between commits the window holds the
        pieces of at most `longest` characters that are still open and the undecided part before them.
        """
        best: dict[int, tuple[float, int, int]] = {}
        done, score, ahead, last = 0, 0.0, 0, NOTHING
        merges, fit = self.merges, self._fit
        unknown, unknown_score = self.unknown, self.unknown_score
        for at in range(len(text)):
            if at > done:
                here = best.get(at)
                if here is None:
                    continue
                score, last = here[0], here[2]
                if ahead == at:
                    yield self._path(text, best, done, at)
                    best.clear()
                    done = at
                elif at - done >= LOOK and at % LOOK == 0 and (sure := self._shared(best, at, done)) > done:
                    yield self._path(text, best, done, sure)
                    for end in [e for e in best if e <= sure]:
                        del best[end]
                    done = sure
            node, alone = self.root[0].get(text[at]), False
            end = at
            while node is not None:
                end += 1
                further, i, worth = node
                if i >= 0:
                    alone = alone or end == at + 1
                    total, old = score + worth, best.get(end)
                    if old is None and fit(last, i) if merges else old is None or total > old[0]:
                        best[end] = (total, at, i)
                        ahead = max(ahead, end)
                node = further.get(text[end]) if end < len(text) else None
            if not alone:
                total, old = score + unknown_score, best.get(at + 1)
                if old is None or total > old[0]:
                    best[at + 1] = (total, at, unknown)
                    ahead = max(ahead, at + 1)
        if len(text) > done:
            yield self._path(text, best, done, len(text))

    def _short(self, text: str) -> list[int]:
        """What search gives, for a text that isn't longer than its window."""
        size, root = len(text), self.root[0]
        if self.merges:
            return self._short_merged(text)
        scores, back = [-math.inf] * (size + 1), [(0, 0)] * (size + 1)
        scores[0] = 0.0
        for at in range(size):
            score = scores[at]
            if score == -math.inf:
                continue
            node, end, alone = root.get(text[at]), at, False
            while node is not None:
                end += 1
                further, i, worth = node
                if i >= 0:
                    if end == at + 1:
                        alone = True
                    if score + worth > scores[end]:
                        scores[end], back[end] = score + worth, (at, i)
                if end == size:
                    break
                node = further.get(text[end])
            if not alone and score + self.unknown_score > scores[at + 1]:
                scores[at + 1], back[at + 1] = score + self.unknown_score, (at, self.unknown)
        return self._path(text, [(0.0, *b) for b in back], 0, size)

    def _short_merged(self, text: str) -> list[int]:
        """The same in a byte-pair model: the one piece that ends at each place after a path that it may follow."""
        size, root, fits = len(text), self.root[0], self.fits
        back: list = [None] * (size + 1)
        back[0] = (0.0, 0, NOTHING)
        for at in range(size):
            here = back[at]
            if here is None:
                continue
            node, end, alone, known = root.get(text[at]), at, False, fits.setdefault(here[2], {})
            while node is not None:
                end += 1
                further, i, _ = node
                if i >= 0:
                    if end == at + 1:
                        alone = True
                    if back[end] is None:
                        fit = known.get(i)
                        if self._fit(here[2], i) if fit is None else fit:
                            back[end] = (0.0, at, i)
                if end == size:
                    break
                node = further.get(text[end])
            if not alone and back[at + 1] is None:
                back[at + 1] = (0.0, at, self.unknown)
        return self._path(text, back, 0, size)

    @staticmethod
    def _shared(best: dict, at: int, done: int) -> int:
        """The last boundary that the paths of all ends from `at` on share; `done` if there is none."""
        open_ = {e for e in best if e >= at}
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(best[last][1] if last > done else done)
        return open_.pop()

    def _path(self, text: str, best: dict | list, start: int, end: int) -> list[int]:
        out: list[int] = []
        while end > start:
            _, begin, i = best[end]
            if i == self.unknown and self.byte_ids[0] >= 0:
                out += [self.byte_ids[b] for b in reversed(text[begin:end].encode())]
            else:
                out.append(i)
            end = begin
        out.reverse()
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; a space is set before it."""
        if not text:
            return b""
        if not self.cuts or SPACE in text:
            return _joined(self.search(SPACE + text.replace(" ", SPACE)))
        words = text.split(" ")
        if not all(words):  # runs of spaces belong to the word after them
            words = _runs(text)
        if len(self.after) > CACHE_WORDS:
            self.after.clear()
        if self.pairs > CACHE_PAIRS:
            self.fits.clear()
            self.pairs = 0
        return b"".join(map(self.after.__getitem__, words))

    def text(self, ids: bytes) -> str:
        """The text of ids; the space set before it is taken away, broken characters become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1 if raw[:1] == b" " else 0 :].decode(errors="replace")


class _Words(dict):
    """Ids of words, each with a space before it: no piece spans the place before such a space."""

    def __init__(self, pieces: Pieces, before: str):
        super().__init__()
        self.pieces, self.before = pieces, before

    def __missing__(self, word: str) -> bytes:
        text = self.before + word.replace(" ", SPACE)
        out = array("I", self.pieces._short(text)).tobytes() if len(text) <= LOOK else _joined(self.pieces.search(text))
        if len(word) <= 64:
            self[word] = out
        return out


def _runs(text: str) -> list[str]:
    """Words of a text with a space set before it, without the first space of each: further spaces stay before them."""
    return [x[1:] for x in re.findall(r" +[^ ]*", " " + text)]


def _joined(runs: Iterator[list[int]]) -> bytes:
    return np.asarray([i for run in runs for i in run], "<u4").tobytes()


def pieces(path: str) -> Pieces:
    """The vocabulary of a model file, loaded once by each worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _mapped(df: DataFrame, source: str, into: str, kind: pa.DataType, ddl: str, make) -> DataFrame:
    kept = [c for c in others(df, into) if c != source]
    numbered = numbered_columns(df, [*kept, source])
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in numbered.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                *columns, found = batch.slice(a, 1024).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array([change(x) for x in found.to_pylist()], kind)], names=[*batch.schema.names[:-1], "out"])

    return numbered.mapInArrow(run, f"{schema}out {ddl}").toDF(*kept, into)


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with `into`, the ids of each text (binary, little-endian unsigned 32-bit), instead of the text.

    The ids are those that the library gives for a unigram or byte-pair model file that leaves texts as they are (its
    own normaliser isn't applied, so texts come back whole); characters without a piece become their bytes. Null and
    empty texts have no ids; each row is encoded whole and by itself, and a column named `into`, in any case, is replaced. U+2581 counts as a space.
    """
    return _mapped(docs, text, into, pa.binary(), "binary", lambda: lambda x, own=pieces(model): own.ids(x or ""))


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with `into`, the text of their ids, instead of the ids. Null gives ""; an id not in the model fails."""
    return _mapped(rows, ids, into, pa.string(), "string", lambda: lambda x, own=pieces(model): own.text(x or b""))
