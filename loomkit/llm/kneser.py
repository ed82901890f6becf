"""Interpolated modified Kneser-Ney model of order two or three: counted in Spark, kept as sorted arrays, mapped by workers.

The model lies in a folder that all executors share, in pieces whose number follows the texts' size:

- words: sorted 64-bit hashes; a word's number is its place in all pieces together. Beside them its count, and by
  number its continuation count, the total and the back-off weight of what follows it.
- bigrams: sorted 64-bit keys, the first word's number in the high half; beside them adjusted counts, one byte each,
  those of 255 and more in a list of their own.
- trigrams (order three): sorted 64-bit keys of contexts (the two words before), with the total and the back-off weight of what
  follows; sorted 64-bit keys of a context's place and the third word, with counts like those of bigrams.

Workers map the arrays where the folder is a mounted one and read them otherwise. Words that are frequent have their
bigrams and trigrams spread over all pieces, so a piece's size is bounded by `PIECE_BYTES` of text or so.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.sources.store import forget

from .common import filesystem, local_path, mix, others, shared_folder, stored, text_bytes
from .words import texts_at_a_time, word_hashes

#: The token that ends each text, as a hash.
END = np.uint64(0x5DEECE66D1234567)
#: Distinct keys that a task holds before it deals them out, and bytes of text that it looks up at a time.
HELD, AT_A_TIME = 1 << 21, 6 << 20
#: Bytes of text for each piece of the model.
PIECE_BYTES, LEAST_PIECES = 16 << 20, 12
#: The least share of a count that a discount takes, so that no context leaves nothing to words unseen after it.
LEAST_DISCOUNT = 0.1
_WIDE, _LOW = np.uint64(32), np.uint64(2**32 - 1)


def _dealt(key: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of each hash; ascending hashes have ascending pieces."""
    return ((key >> _WIDE) * np.uint64(pieces)) >> _WIDE


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    import zstandard

    planes = [a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (4 * columns)
    return [np.ascontiguousarray(raw[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view("<u4").ravel() for k in range(columns)]


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, with the sums of their values."""
    if not len(keys):
        return [keys, *values]
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[new], *(np.add.reduceat(v[by], new) for v in values)]


def _runs(piece: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of one piece."""
    edges = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(piece)], strict=True) if len(piece) else iter(())


def _write(folder: str, name: str, array: np.ndarray) -> str:
    """Writes an array as a file of its own name and gives its place."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}.npy"
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return f"{folder}/{name}"


def _map(path: str) -> np.ndarray:
    local = local_path(path)
    if local is not None:
        return np.load(local, mmap_mode="r")
    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as source:
        return np.lib.format.read_array(source)


@dataclass
class Model:
    """What the driver knows of a model: places of pieces and a few totals; the arrays stay in the folder."""

    pieces: int
    order: int = 2
    words: list[dict] = field(default_factory=list)
    bigrams: list[dict] = field(default_factory=list)
    trigrams: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    tokens: int = 0
    vocabulary: int = 0
    highest: tuple[float, float, float] = (0.5, 1.0, 1.5)
    discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    lower: tuple[float, float, float] = (0.5, 1.0, 1.5)
    continuations: int = 0
    lower_weight: float = 1.0

    def spread(self) -> float:
        """Words counted more often than this have their followers spread over all pieces."""
        return self.tokens / (4 * self.pieces)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of things counted 1, 2, 3 and 4 times; fixed ones where these are too few."""
    if min(n) <= 0:
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], LEAST_DISCOUNT), k + 1.0) for k in range(3))


def _taken(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.asarray([0.0, *d])[np.minimum(count, 3).astype(np.int64)]


class Arrays:
    """A worker's view of a model: lookups of words, facts by number and bigrams."""

    def __init__(self, model: Model):
        self.model = model
        self.first = np.asarray([w["first"] for w in model.words], np.int64)
        self.rows = {kind: {r["piece"]: r for r in getattr(model, kind)} for kind in ("words", "bigrams", "trigrams", "facts")}
        self.maps: dict[tuple, tuple] = {}

    def held(self, kind: str, piece: int, *names: str) -> tuple[np.ndarray, ...] | None:
        """Arrays of a piece, mapped when first asked for; None where there is no such piece."""
        at = (kind, piece, names)
        if at not in self.maps:
            row = self.rows[kind].get(piece)
            self.maps[at] = None if row is None else tuple(_map(row[n]) for n in names)
        return self.maps[at]

    def count_of(self, numbers: np.ndarray) -> np.ndarray:
        """The counts of words by number; that of a text's start is beyond all."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.full(len(distinct), self.model.tokens, np.int64)
        piece = np.searchsorted(self.first, distinct, "right") - 1
        for a, b in _runs(piece):
            row = self.model.words[int(piece[a])]
            own = distinct[a:b] - row["first"]
            inside = own < row["size"]
            out[a:b][inside] = self.held("words", row["piece"], "counts")[0][own[inside]]
        return out[back]

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word or -1, its count)."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        piece = _dealt(distinct, self.model.pieces)
        for a, b in _runs(piece):
            if (own := self.held("words", int(piece[a]), "hashes", "counts")) is None:
                continue
            table, counts = own
            at = np.minimum(np.searchsorted(table, distinct[a:b]), len(table) - 1)
            hit = table[at] == distinct[a:b]
            number[a:b] = np.where(hit, at + self.rows["words"][int(piece[a])]["first"], -1)
            count[a:b] = np.where(hit, counts[at], 0)
        return number[back], count[back]

    def fact(self, numbers: np.ndarray, *names: str) -> list[np.ndarray]:
        """Facts of words by number; 0 for those without."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = [np.zeros(len(distinct)) for _ in names]
        piece = fact_piece(distinct, self.model)
        for a, b in _runs(piece):
            held = self.held("facts", int(piece[a]), *names)
            if distinct[a] < 0:
                a = a + int(np.searchsorted(distinct[a:b], 0))
            if held is None or a == b:
                continue
            for o, values in zip(out, held, strict=True):
                o[a:b] = values[distinct[a:b] - fact_first(int(piece[b - 1]), self.model)]
        return [o[back] for o in out]

    def bigram_counts(self, left: np.ndarray, right: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """How often each pair of numbers was counted."""
        key = (left.astype(np.uint64) << _WIDE) | right.astype(np.uint64)
        piece = bigram_piece(left, key, spread, self.model.pieces)
        by = np.argsort(piece, kind="stable")
        key, piece = key[by], piece[by]
        found = np.zeros(len(key), np.int64)
        for a, b in _runs(piece):
            if (held := self.held("bigrams", int(piece[a]), "keys", "counts", "large")) is not None:
                found[a:b] = _times(*held, key[a:b])
        out = np.empty_like(found)
        out[by] = found
        return out

    def after(self, first: np.ndarray, second: np.ndarray, third: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, ...]:
        """(how often each triple of numbers was counted, total and weight of its first two words); 0 where unseen."""
        context = (first.astype(np.uint64) << _WIDE) | second.astype(np.uint64)
        piece = trigram_piece(second, context, spread, self.model.pieces)
        by = np.argsort(piece, kind="stable")
        context, third, piece = context[by], third[by], piece[by]
        found = np.zeros((3, len(by)))
        for a, b in _runs(piece):
            if (held := self.held("trigrams", int(piece[a]), "contexts", "totals", "weights", "keys", "counts", "large")) is None:
                continue
            contexts, totals, followers, *rest = held
            at = np.minimum(np.searchsorted(contexts, context[a:b]), len(contexts) - 1)
            hit = np.flatnonzero(contexts[at] == context[a:b])
            at = at[hit]
            found[1, a + hit] = totals[at]
            found[2, a + hit] = np.asarray(self.model.highest) @ followers[:, at] / totals[at]
            found[0, a + hit] = np.where(third[a + hit] < 0, 0, _times(*rest, (at.astype(np.uint64) << _WIDE) | (third[a + hit].astype(np.uint64) & _LOW)))
        out = np.empty_like(found)
        out[:, by] = found
        return tuple(out)


def _times(keys: np.ndarray, counts: np.ndarray, large: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The count of each wanted key."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    own = np.where(keys[at] == wanted, counts[at], 0).astype(np.int64)
    if len(large):
        over = np.flatnonzero(own == 255)
        own[over] = large[np.searchsorted(large[:, 0], at[over]), 1]
    return own


def fact_piece(numbers: np.ndarray, model: Model) -> np.ndarray:
    return numbers * model.pieces // (model.vocabulary + 1)


def fact_first(piece: int, model: Model) -> int:
    """The first number of a piece of facts; the number after the last word stands for a text's start."""
    return -(-piece * (model.vocabulary + 1) // model.pieces)


def bigram_piece(left: np.ndarray, key: np.ndarray, spread: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of each bigram: by its first word, by both where that is frequent."""
    return _dealt(mix(np.where(spread, key, left.astype(np.uint64))), pieces)


def trigram_piece(second: np.ndarray, context: np.ndarray, spread: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of each trigram: by its second word, by the first two where that is frequent."""
    return _dealt(mix(np.where(spread, context, second.astype(np.uint64))), pieces)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes of tokens with an end after each text, number of each text's tokens)."""
    data, offsets = text_bytes(batch.column("text"))
    for a, b in texts_at_a_time(offsets, AT_A_TIME):
        own = offsets[a : b + 1]
        words, counts = word_hashes(data[own[0] : own[-1]], own - own[0])
        yield a, b, np.insert(words, np.cumsum(counts), END), counts + 1


def _pairs(numbers: np.ndarray, sizes: np.ndarray, start: int | bool) -> np.ndarray:
    """The number before each token; `start` before the first of a text."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.cumsum(sizes) - sizes] = start
    return before


def _count_words(pieces: int):
    def deal(held) -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(*map(np.concatenate, zip(*held, strict=True)))
        piece = _dealt(keys, pieces)
        rows = [(int(piece[a]), _packed(keys[a:b] >> _WIDE, keys[a:b] & np.uint64(2**32 - 1), np.minimum(counts[a:b], 2**32 - 1))) for a, b in _runs(piece)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["piece", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, tokens, _ in _tokens(batch):
                held.append(_summed(tokens, np.ones(len(tokens), np.int64)))
                n += len(held[-1][0])
                if n >= HELD:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n >= HELD // 2:
                        yield from deal(held)
                        held, n = [], 0
        if n:
            yield from deal(held)

    return run


def _keep_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x, 3) for x in table.column("data").to_pylist()]
        high, low, counts = (np.concatenate([p[k] for p in parts]).astype(np.uint64) for k in range(3))
        keys, counts = _summed((high << _WIDE) | low, counts.astype(np.int64))
        row = {"piece": table.column("piece")[0].as_py(), "hashes": _write(folder, "words", keys), "counts": _write(folder, "counts", counts), "size": len(keys), "tokens": int(counts.sum())}
        return pa.Table.from_pylist([row], schema=pa.schema([("piece", pa.int32()), ("hashes", pa.string()), ("counts", pa.string()), ("size", pa.int64()), ("tokens", pa.int64())]))

    return run


def _count_bigrams(model: Model):
    def deal(held) -> Iterator[pa.RecordBatch]:
        keys, counts, spread = _summed(*map(np.concatenate, zip(*held, strict=True)))
        rows = _bigram_rows(keys, counts, spread > 0, model)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["piece", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, held, n = Arrays(model), [], 0
        for batch in batches:
            for _, _, tokens, sizes in _tokens(batch):
                numbers, counts = arrays.numbers(tokens)
                left = _pairs(numbers, sizes, model.vocabulary)
                often = _pairs((counts > model.spread()).astype(np.int64), sizes, 1)
                keys = (left.astype(np.uint64) << _WIDE) | numbers.astype(np.uint64)
                held.append(_summed(keys, np.ones(len(keys), np.int64), often))
                n += len(held[-1][0])
                if n >= HELD:
                    yield from deal(held)
                    held, n = [], 0
        if n:
            yield from deal(held)

    return run


def _bigram_rows(keys: np.ndarray, counts: np.ndarray, spread: np.ndarray, model: Model) -> list[tuple[int, bytes]]:
    """(piece, packed bigrams) of ascending keys with their counts."""
    piece = bigram_piece((keys >> _WIDE).astype(np.int64), keys, spread, model.pieces)
    by = np.argsort(piece, kind="stable")
    keys, counts, piece = keys[by], counts[by], piece[by]
    return [(int(piece[a]), _packed(np.diff((keys[a:b] >> _WIDE).astype(np.int64), prepend=0), keys[a:b] & _LOW, counts[a:b])) for a, b in _runs(piece)]


def _folded(context: np.ndarray, third: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Distinct pairs of context and third word, ascending, with their summed counts; more: one value of each pair."""
    if not len(context):
        return [context, third, counts, *more]
    by = np.lexsort((third, context))
    context, third = context[by], third[by]
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (third[1:] != third[:-1])]))
    return [context[new], third[new], np.add.reduceat(counts[by], new), *(m[by][new] for m in more)]


def _count_trigrams(model: Model):
    def deal(held) -> Iterator[pa.RecordBatch]:
        context, third, counts, spread = _folded(*map(np.concatenate, zip(*held, strict=True)))
        second = context & _LOW
        piece = trigram_piece(second, context, spread > 0, model.pieces)
        by = np.argsort(piece, kind="stable")
        context, third, counts, piece = context[by], third[by], counts[by], piece[by]
        rows = []
        for a, b in _runs(piece):
            new = np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]])
            sizes = np.diff(np.flatnonzero(np.concatenate([new, [True]])))
            own = context[a:b][new]
            rows.append((int(piece[a]), _packed(np.diff((own >> _WIDE).astype(np.int64), prepend=0), own & _LOW, sizes), _packed(third[a:b], counts[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["piece", "contexts", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, held, n = Arrays(model), [], 0
        for batch in batches:
            for _, _, tokens, sizes in _tokens(batch):
                numbers, counts = arrays.numbers(tokens)
                left = _pairs(numbers, sizes, model.vocabulary)
                context = (_pairs(left, sizes, model.vocabulary).astype(np.uint64) << _WIDE) | left.astype(np.uint64)
                often = _pairs(counts > model.spread(), sizes, True)
                held.append((context, numbers.astype(np.uint32), np.ones(len(numbers), np.int64), often))
                n += len(numbers)
                if n >= HELD:
                    yield from deal(held)
                    held, n = [], 0
        if n:
            yield from deal(held)

    return run


_COUNTS_DDL = "n1 long, n2 long, n3 long, n4 long"
_COUNTS = [(f"n{k}", pa.int64()) for k in range(1, 5)]
_TRIGRAM_DDL = f"kind int, piece int, contexts string, totals string, weights string, keys string, counts string, large string, {_COUNTS_DDL}, data binary"
_TRIGRAM_SCHEMA = pa.schema([("kind", pa.int32()), ("piece", pa.int32()), *((k, pa.string()) for k in ("contexts", "totals", "weights", "keys", "counts", "large")), *_COUNTS, ("data", pa.binary())])


def _frequencies(counts: np.ndarray) -> dict[str, int]:
    return {f"n{k}": int((counts == k).sum()) for k in range(1, 5)}


def _keep_counts(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> dict[str, str]:
    over = np.flatnonzero(counts >= 255)
    return {"keys": _write(folder, name, keys), "counts": _write(folder, "times", np.minimum(counts, 255).astype(np.uint8)), "large": _write(folder, "large", np.stack([over, counts[over]], 1))}


def _keep_trigrams(folder: str, model: Model):
    """Writes a piece of trigrams, without weights yet; deals out the adjusted counts of the bigrams that end them."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for contexts, data in zip(table.column("contexts").to_pylist(), table.column("data").to_pylist(), strict=True):
            first, second, sizes = _unpacked(contexts, 3)
            third, counts = _unpacked(data, 2)
            own = (np.cumsum(first.astype(np.uint32), dtype=np.uint32).astype(np.uint64) << _WIDE) | second.astype(np.uint64)
            parts.append((np.repeat(own, sizes), third, counts.astype(np.int64)))
        context, third, counts = _folded(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        place = np.repeat(np.arange(len(new), dtype=np.uint64), np.diff([*new, len(context)]))
        stats = [np.add.reduceat(x, new) for x in (counts, *((counts == k).astype(np.int64) for k in (1, 2)), (counts >= 3).astype(np.int64))]
        row = {"kind": 0, "piece": table.column("piece")[0].as_py(), "contexts": _write(folder, "contexts", context[new]), "totals": _write(folder, "totals", stats[0].astype(np.float64)), "weights": _write(folder, "followers", np.stack(stats[1:]).astype(np.uint32))}
        rows = [row | _keep_counts(folder, "trigrams", (place << _WIDE) | third.astype(np.uint64), counts) | _frequencies(counts)]
        # a bigram counts once for each word before it; that after a text's start as often as it is
        second = context & _LOW
        keys, counts = _summed((second << _WIDE) | third.astype(np.uint64), np.where(second == model.vocabulary, counts, 1))
        often = Arrays(model).count_of((keys >> _WIDE).astype(np.int64)) > model.spread()
        rows += [{"kind": 1, "piece": p, "data": data} for p, data in _bigram_rows(keys, counts, often, model)]
        return pa.Table.from_pylist(rows, schema=_TRIGRAM_SCHEMA)

    return run


_BIGRAM_DDL = f"kind int, piece int, keys string, counts string, large string, {_COUNTS_DDL}, data binary"
_BIGRAM_SCHEMA = pa.schema([("kind", pa.int32()), ("piece", pa.int32()), ("keys", pa.string()), ("counts", pa.string()), ("large", pa.string()), *_COUNTS, ("data", pa.binary())])


def _keep_bigrams(folder: str, model: Model):
    """Writes a piece of bigrams; deals out what it says of each word as a context and as a continuation."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x, 3) for x in table.column("data").to_pylist()]
        left = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts]).astype(np.uint64)
        right, counts = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        keys, counts = _summed((left << _WIDE) | right.astype(np.uint64), counts.astype(np.int64))
        row = {"kind": 0, "piece": table.column("piece")[0].as_py()} | _keep_counts(folder, "bigrams", keys, counts)
        rows = [row | _frequencies(counts)]
        left, right = (keys >> _WIDE).astype(np.int64), (keys & _LOW).astype(np.int64)
        for kind, facts in (
            (1, _summed(left, counts, counts == 1, counts == 2, counts >= 3) if len(left) else None),
            (2, _summed(right, np.ones(len(right), np.int64))),
        ):
            own, *values = [facts[0], *(v.astype(np.int64) for v in facts[1:])]
            piece = fact_piece(own, model)
            for a, b in _runs(piece):
                rows.append({"kind": kind, "piece": int(piece[a]), "data": _packed(own[a:b] - fact_first(int(piece[a]), model), *(v[a:b] for v in values))})
        return pa.Table.from_pylist(rows, schema=_BIGRAM_SCHEMA)

    return run


_FACT_DDL = "piece int, continued string, total string, weight string, n1 long, n2 long, n3 long, n4 long, sum long, some long, two long, more long"


def _keep_facts(folder: str, model: Model):
    def run(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        size = fact_first(piece + 1, model) - fact_first(piece, model)
        continued, stats = np.zeros(size, np.int64), np.zeros((4, size), np.int64)
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            own, *values = _unpacked(blob, 5 if kind == 1 else 2)
            if kind == 2:
                continued[own] += values[0]
            else:
                for k in range(4):
                    stats[k, own] += values[k]
        total = stats[0].astype(np.float64)
        weight = np.divide(np.asarray(model.discounts) @ stats[1:], total, out=np.zeros(size), where=total > 0)
        row = {"piece": piece, "continued": _write(folder, "continued", continued.astype(np.uint32)), "total": _write(folder, "total", total), "weight": _write(folder, "weight", weight)}
        row |= {f"n{k}": int((continued == k).sum()) for k in range(1, 5)} | {"sum": int(continued.sum()), "some": int((continued == 1).sum()), "two": int((continued == 2).sum()), "more": int((continued > 2).sum())}
        names = _FACT_DDL.replace(",", "").split()[::2]
        kinds = {"int": pa.int32(), "string": pa.string(), "long": pa.int64()}
        return pa.Table.from_pylist([row], schema=pa.schema([(n, kinds[k]) for n, k in zip(names, _FACT_DDL.replace(",", "").split()[1::2], strict=True)]))

    return run


def train(texts: DataFrame, folder: str | None = None, order: int = 2) -> Model:
    """A model of order two or three of the texts (column text; null: empty), kept in folder, by default a new shared one.

    Tokens are words by white space, A-Z taken as a-z, and an end after each text; starts stand before it. The counts
    of the highest order are those of the texts; a lower one counts the words before it, but after a start as the texts
    do. Only one row for each piece comes to the driver. No texts give an empty model.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = texts.sparkSession
    folder = folder or shared_folder(spark, "model")
    texts = texts.select("text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(max(LEAST_PIECES, -(-size // PIECE_BYTES)), order)
    counted = texts.mapInArrow(_count_words(model.pieces), "piece int, data binary").groupBy("piece")
    rows = stored(counted.applyInArrow(_keep_words(folder), "piece int, hashes string, counts string, size long, tokens long"), "words")
    for row in sorted(rows.collect()):
        model.words.append(row.asDict() | {"first": model.vocabulary})
        model.vocabulary += row["size"]
        model.tokens += row["tokens"]
    forget(rows)
    if not model.words:
        return model
    if model.vocabulary >= 2**32 - 1:
        raise ValueError("more than 2 ** 32 words need wider keys")
    if order == 3:
        counted = texts.mapInArrow(_count_trigrams(model), "piece int, contexts binary, data binary").groupBy("piece")
        triples = stored(counted.applyInArrow(_keep_trigrams(folder, model), _TRIGRAM_DDL), "trigrams")
        model.trigrams = [r.asDict() for r in triples.filter("kind = 0").drop("kind", "data").collect()]
        model.highest = discounts([sum(r[f"n{k}"] for r in model.trigrams) for k in range(1, 5)])
        pairs = triples.filter("kind = 1").select("piece", "data")
    else:
        pairs = texts.mapInArrow(_count_bigrams(model), "piece int, data binary")
    rows = stored(pairs.groupBy("piece").applyInArrow(_keep_bigrams(folder, model), _BIGRAM_DDL), "bigrams")
    if order == 3:
        forget(triples)
    model.bigrams = [r.asDict() for r in rows.filter("kind = 0").drop("kind", "data").collect()]
    model.discounts = discounts([sum(r[f"n{k}"] for r in model.bigrams) for k in range(1, 5)])
    facts = rows.filter("kind > 0").select("kind", "piece", "data").groupBy("piece").applyInArrow(_keep_facts(folder, model), _FACT_DDL)
    facts = stored(facts, "facts")
    model.facts = [r.asDict() for r in facts.collect()]
    forget(facts, rows)
    model.lower = discounts([sum(r[f"n{k}"] for r in model.facts) for k in range(1, 5)])
    model.continuations = sum(r["sum"] for r in model.facts)
    model.lower_weight = sum(d * sum(r[k] for r in model.facts) for d, k in zip(model.lower, ("some", "two", "more"), strict=True)) / model.continuations
    return model


def _mixed(times: np.ndarray, total: np.ndarray, weight: np.ndarray, discount: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """The discounted share of each count, with what its context leaves given to the lower order; that alone where the context is unseen."""
    own = np.divide(np.maximum(times - _taken(times, discount), 0), total, out=np.zeros(len(lower)), where=total > 0)
    return np.where(total > 0, own + weight * lower, lower)


def probabilities(arrays: Arrays, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each token after the one or two before it, its count in the training texts)."""
    model = arrays.model
    if not model.words:
        return np.ones(len(tokens)), np.zeros(len(tokens), np.int64)
    numbers, counts = arrays.numbers(tokens)
    left = _pairs(numbers, sizes, model.vocabulary)
    often = _pairs(counts > model.spread(), sizes, True)
    (continued,) = arrays.fact(numbers, "continued")
    chance = np.maximum(continued - _taken(continued, model.lower), 0) / model.continuations + model.lower_weight / (model.vocabulary + 1)
    total, weight = arrays.fact(left, "total", "weight")
    known = np.flatnonzero((numbers >= 0) & (total > 0))
    times = np.zeros(len(tokens))
    times[known] = arrays.bigram_counts(left[known], numbers[known], often[known])
    chance = _mixed(times, total, weight, model.discounts, chance)
    if model.order == 2:
        return chance, counts
    times, total, weight = arrays.after(_pairs(left, sizes, model.vocabulary), left, numbers, often)
    return _mixed(times, total, weight, model.highest, chance), counts


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, others) without text, with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    score is the log10 probability of the whole text, base_score that of counts plus one; null text is its end
    alone. Every row is scored by itself. Columns of docs named like the result's are replaced.
    """
    columns = others(docs, "text", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in batches:
            for a, b, tokens, sizes in _tokens(batch):
                chance, counts = probabilities(arrays, tokens, sizes)
                starts = np.cumsum(sizes) - sizes
                base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
                base, own = np.add.reduceat(base, starts), np.add.reduceat(np.log10(chance), starts)
                known = np.add.reduceat((counts > 0).astype(np.int64), starts)
                out = [pa.array(sizes, pa.int64()), pa.array(known), pa.array(np.full(b - a, model.tokens, np.int64)), pa.array(base), pa.array(own), pa.array(10 ** (-own / sizes))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), *out], names=[*columns, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(*columns, "text").mapInArrow(run, f"{schema}n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: whether the crc32 of doc_id as text leaves 2 when divided by 7; a null doc_id doesn't. A column of that name is replaced."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
