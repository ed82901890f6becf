"""Removal of long repeated strings by bucket-pointer refinement over a sample of suffixes.

A suffix's bucket at depth d is named by a 64-bit pointer that depends on its first d bytes alone, so that buckets
need no numbering across tasks. Pointers start from single bytes and are refined as the suffix sorter of that name
does: the pointer at depth d + e combines the pointer at depth d with the one at depth e of the suffix d bytes
later, reusing what earlier rounds gave (1, 2, 4 ... 64, then 64 and 36 bytes later again 64: 100).

Only some suffixes are sorted by Spark. Every string of `length` bytes picks one of its q-grams by content, the one
with the least pointer; equal strings pick alike. A picked suffix owns the run of strings that picked it:

1. Initial buckets are those q-grams. A suffix alone in its bucket leaves; so do strings it owns.
2. Suffixes of a bucket are refined by pointers at later offsets, over all the bytes that their strings cover. Of
   those still equal the first stays, the strings of others are repeats. A bucket that doesn't split is done.
3. In buckets that split, runs are cut into pieces of at most `BLOCK` strings, at places counted from the picked
   q-gram. The bucket of such a suffix is named by the bytes common to all strings of a whole piece (depth length -
   BLOCK + 1), and refined as before; a piece alone in its bucket leaves.
4. In buckets that still split, each string is a suffix of its own at depth `length`; all but the first are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, others, text_bytes

LENGTH, GRAM = 100, 32
#: Bytes that are refined at a time, and picked suffixes that a task holds before it emits them.
PIECE, HELD = 1 << 19, 1 << 20
_PLACE = np.uint64((1 << 20) - 1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Strings of a piece in the second round.
BLOCK = 8
#: Kinds of rows: a suffix alone or first of its equals here; a bucket that has split here; strings to sort anew; repeats.
ALONE, SPLIT, STRINGS, REPEAT = 0, 1, 2, 3
_DDL = "bucket long, refined long, doc long, ord int, at long"
_NAMES = ["bucket", "refined", "doc", "ord", "at"]
_NULL_DOC = -(2**63)


def _refine(head: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Pointers of longer suffixes, from those of their heads and of what follows."""
    out = head[: len(later)] * _C1
    out += later
    out ^= out >> np.uint64(32)
    out *= _C2
    return out


def pointers(data: np.ndarray, depths: tuple[int, ...], seed: int = 1) -> list[np.ndarray]:
    """The bucket pointers at the given depths (powers of two, ascending) of all suffixes of data that are so long."""
    now, depth, out = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)[data], 1, []
    while True:
        if depth in depths:
            out.append(now)
        if depth >= depths[-1]:
            return out
        now = _refine(now, now[depth:])
        depth *= 2


def picked(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(initial bucket, refined pointer, first string, strings after it, place of the q-gram in it) of each picked suffix.

    The piece holds whole texts or parts of one, from starts to ends; strings don't cross them.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    short, long = pointers(data, (GRAM, 2 * GRAM))
    grams, low = length - GRAM + 1, short & ~_PLACE
    low |= _PLACE - np.arange(len(short), dtype=np.uint64)
    width = 1
    while 2 * width <= grams:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < grams:
        low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :])
    valid = np.ones(len(low), bool)
    for a, b in zip(np.maximum(starts, ends - length + 1).tolist(), ends.tolist(), strict=True):
        valid[a:b] = False
    strings = np.flatnonzero(valid)
    if not len(strings):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    gram = (_PLACE - (low[strings] & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    last = np.concatenate([first[1:], [len(gram)]]) - 1
    at, begin, stop = gram[first], strings[first], strings[last] + length
    size = stop - begin
    return short[at], _whole(long, begin, size, at - begin), begin, strings[last] - begin, at - begin


def _whole(long: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Pointers at depth `size` (2 * GRAM to 6 * GRAM), told apart by size and place."""
    refined = _refine(_refine(long[begin], long[begin + (size - 2 * GRAM) // 2]), long[begin + size - 2 * GRAM])
    return mix(refined + (size.astype(np.uint64) << np.uint64(20)) + place.astype(np.uint64))


def _at(start: np.ndarray, span: np.ndarray, place: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """start (31 bits), span (20), place (7) and kind (2) in one number that ascends with start."""
    return (start << 29) | (span << 9) | (place << 2) | kind


def _batches(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=_NAMES)


def _repeats(doc: np.ndarray, order: np.ndarray, start: np.ndarray, span: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of repeated strings; runs that touch or overlap become one."""
    if not len(doc):
        return
    by = np.lexsort((start, order, doc))
    doc, order, start, span = doc[by], order[by], start[by], span[by]
    new_doc = np.concatenate([[True], (doc[1:] != doc[:-1]) | (order[1:] != order[:-1])])
    stop = start + span
    base = np.cumsum(new_doc) * (1 << 32)  # keeps the running maximum inside a document
    reach = np.maximum.accumulate(stop + base) - base
    first = np.flatnonzero(np.concatenate([[True], new_doc[1:] | (start[1:] > reach[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    doc, order, start, span = doc[first], order[first], start[first], reach[last] - start[first]
    parts = span // (1 << 20) + 1
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    doc, order, start, span = (np.repeat(x, parts) for x in (doc, order, start, span))
    start, span = start + (inside << 20), np.minimum(span - (inside << 20), (1 << 20) - 1)
    yield from _batches(mix(doc.view(np.uint64)).view(np.int64), np.zeros(len(doc), np.int64), doc, order.astype(np.int32), _at(start, span, np.zeros_like(start), REPEAT))


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, texts) of pieces: many short texts, or parts of a long one that share length - 1 bytes."""
    held, size = [], 0
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        if b - a < length:
            continue
        if b - a > PIECE:
            for at in range(a, b - length + 1, PIECE):
                yield at, min(at + PIECE + length - 1, b), np.asarray([k])
            continue
        if held and (size + b - a > PIECE or held[-1] != k - 1):
            yield int(offsets[held[0]]), int(offsets[held[-1] + 1]), np.asarray(held)
            held, size = [], 0
        held.append(k)
        size += b - a
    if held:
        yield int(offsets[held[0]]), int(offsets[held[-1] + 1]), np.asarray(held)


def _sorted_rows(bucket, refined, doc, order, start, span, place, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of one task's suffixes: of each bucket one row, if it hasn't split here; in the last round of each class."""
    by = np.lexsort((start, order, doc, refined, bucket))
    bucket, refined, doc, order, start, span, place = (x[by] for x in (bucket, refined, doc, order, start, span, place))
    new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    new_class = new_bucket | np.concatenate([[True], refined[1:] != refined[:-1]])
    same_place = ~new_class & np.concatenate([[False], (doc[1:] == doc[:-1]) & (order[1:] == order[:-1]) & (start[1:] == start[:-1])])
    group = np.cumsum(new_bucket) - 1
    splits = (np.bincount(group, weights=new_class) > 1)[group] & (not last)
    old = ~new_class & ~same_place
    yield from _repeats(doc[old], order[old], start[old], span[old])
    for keep, kind in ((new_class & ~splits, ALONE), (new_class & splits, STRINGS)):
        key = bucket[keep] if kind == ALONE else mix(doc[keep].view(np.uint64))
        yield from _batches(key.view(np.int64), refined[keep].view(np.int64) * (kind == ALONE), doc[keep], order[keep].astype(np.int32), _at(start[keep], span[keep], place[keep], kind))
    marks = bucket[new_bucket & splits].view(np.int64)
    none = np.zeros(len(marks), np.int64)
    yield from _batches(marks, none, none, none.astype(np.int32), none + SPLIT)


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc, order = (batch.column(c).to_numpy() for c in ("doc", "ord"))
            for a, b, texts in _pieces(data, offsets, length):
                starts, ends = np.maximum(offsets[texts], a) - a, np.minimum(offsets[texts + 1], b) - a
                bucket, refined, begin, span, place = picked(data[a:b], ends, starts, length)
                own = texts[np.searchsorted(starts, begin, "right") - 1]
                held.append((bucket, refined, doc[own], order[own].astype(np.int64), begin + a - offsets[own], span, place))
                n += len(begin)
                if n >= HELD:
                    yield from _sorted_rows(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from _sorted_rows(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _sort_again(length: int, block: int):
    """Runs of strings as suffixes of at most `block` strings each; repeats found so far go with them."""
    core = length - block + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts = np.diff(batch.column("found").offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            at = batch.column("found").flatten().to_numpy()
            start, span, place, kind = at >> 29, (at >> 9) & ((1 << 20) - 1), (at >> 2) & 127, at & 3
            row = np.repeat(np.arange(batch.num_rows), counts)
            doc, order = (batch.column(c).to_numpy().astype(np.int64)[row] for c in ("doc", "ord"))
            old = kind == REPEAT
            yield from _repeats(doc[old], order[old], start[old], span[old])
            todo = np.flatnonzero(~old)
            sizes = span[todo] + length
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1, [len(todo)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = todo[a:b]
                if not len(own):
                    continue
                size = span[own] + length
                piece = np.cumsum(size) - size  # where each run's bytes begin among those of all
                inside = np.arange(size.sum()) - np.repeat(piece, size)
                raw = data[np.repeat(offsets[row[own]] + start[own], size) + inside]
                # strings by their distance before the q-gram: those of one multiple of block are a suffix
                gram = start[own] + place[own]
                far, near = place[own] // block, (place[own] - span[own]) // block
                parts = far - near + 1
                which = np.repeat(np.arange(len(own)), parts)
                k = np.repeat(far, parts) - (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                first = np.maximum(gram[which] - (k + 1) * block + 1, start[own][which])
                last = np.minimum(gram[which] - k * block, (start[own] + span[own])[which])
                begin = first - start[own][which] + piece[which]
                (long,) = pointers(raw, (2 * GRAM,))
                head = gram[which] - k * block - start[own][which] + piece[which]
                bucket = mix(_refine(long[head], long[head + core - 2 * GRAM]))
                if block > 1:
                    refined = _whole(long, begin, last - first + length, head - begin)
                else:
                    (long,) = pointers(raw, (2 * GRAM,), seed=2)
                    refined = mix(_refine(long[head], long[head + core - 2 * GRAM]))
                rows = own[which]
                held.append((bucket, refined, doc[rows], order[rows], first, last - first, gram[which] - first))
                n += len(first)
                if n >= HELD:
                    yield from _sorted_rows(*map(np.concatenate, zip(*held, strict=True)), last=block == 1)
                    held, n = [], 0
        if n:
            yield from _sorted_rows(*map(np.concatenate, zip(*held, strict=True)), last=block == 1)

    return run


def _cut(length: int, columns: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes, texts = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found"), strict=True):
                raw = (text or "").encode()
                sizes.append(len(raw))
                if not found.is_valid or not len(found.values):
                    spans.append([])
                    kept.append(raw)
                    texts.append(text or "")
                    continue
                at = found.values.to_numpy()
                start = at >> 29
                stop = start + ((at >> 9) & ((1 << 20) - 1)) + length
                by = np.argsort(start, kind="stable")
                start, stop = start[by], np.maximum.accumulate(stop[by])
                new = np.concatenate([[True], start[1:] > stop[:-1]])
                first, last = start[new], stop[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(stop) - 1]])]
                spans.append([{"start": a, "stop": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                edges = [0, *np.stack([first, last], 1).ravel().tolist(), len(raw)]
                parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept.append(b"".join(parts))
                texts.append("".join(x.decode(errors="ignore") for x in parts))
            more = [pa.array(texts, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary()), *more],
                names=[*columns, "n_bytes", "spans", "kept", *["text"] * with_text],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """docs (doc_id long, text string, others) without text, with n_bytes, spans (array of start, stop; bytes) and kept (binary).

    Removed is each byte of a string of `length` UTF-8 bytes that also starts earlier: in a smaller doc_id or in the
    same text before. Null text counts as empty, null doc_id as smallest. Rows that repeat a doc_id are ordered by
    text; rows repeated whole count as one and share their result. Columns named like the result's, doc, ord or found go.
    length must be from 64 to 128. With with_text
    the column text comes back too, without what was removed and without the halves of characters cut in two.
    """
    if not 2 * GRAM <= length <= 4 * GRAM:
        raise ValueError("length must be from 64 to 128")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_DOC)).alias("doc")
    columns = others(docs, "text", "doc", "ord", "found", "n_bytes", "spans", "kept")
    twice = docs.groupBy(doc).count().filter("count > 1").limit(1).count()
    order = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.asc_nulls_first("doc_id"), "text")) if twice else F.lit(0)
    texts = docs.select(doc, order.alias("ord"), *columns, "text")
    rows = texts.select("doc", "ord", "text").mapInArrow(_sample(length), _DDL)
    for block in (BLOCK, 1):
        found = texts.join(_by_doc(_settled(rows)).hint("shuffle_hash"), ["doc", "ord"])
        rows = found.mapInArrow(_sort_again(length, block), _DDL)
    place = F.rank().over(Window.partitionBy("bucket", "refined").orderBy("doc", "ord", "at"))
    repeats = rows.repartition("bucket").withColumn("place", place).filter(f"at & 3 = {REPEAT} or place > 1")
    out = texts.join(_by_doc(repeats).hint("shuffle_hash"), ["doc", "ord"], "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    schema += ", n_bytes long, spans array<struct<start:int,stop:int>>, kept binary" + ", text string" * with_text
    return out.mapInArrow(_cut(length, columns, with_text), schema)


def _settled(rows: DataFrame) -> DataFrame:
    """Rows that stay: repeats, and the first of equals where the bucket splits. A task sends one row of a bucket at most."""
    equal = Window.partitionBy("bucket", "refined").orderBy("doc", "ord", "at")
    bucket = Window.partitionBy("bucket")
    kind = F.col("at").bitwiseAND(3)
    alone = F.when(kind == ALONE, F.col("refined"))
    placed = rows.repartition("bucket").withColumn("place", F.rank().over(equal)).withColumns({
        "low": F.min(alone).over(bucket), "high": F.max(alone).over(bucket), "split": F.max(kind == SPLIT).over(bucket),
    })
    again = placed.filter((kind == REPEAT) | (kind == STRINGS) | ((kind == ALONE) & ((F.col("place") > 1) | (F.col("low") != F.col("high")) | F.col("split"))))
    new = F.when((kind == ALONE) & (F.col("place") > 1), REPEAT).when(kind == ALONE, STRINGS).otherwise(kind)
    return again.withColumn("at", (F.col("at") - kind + new).cast("long"))


def _by_doc(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "ord").agg(F.collect_list("at").alias("found"))
