"""Phrase collocations: words ranked by frequency, pairs of ranks counted in tiles, frequent pairs ranked and paired again."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.sources.store import forget

from .common import filesystem, stored, text_bytes
from .terms import places, span_bytes, span_hashes, spans
from .words import texts_at_a_time

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text, or of ranks, that are counted together; arrays of some 20 times that are held meanwhile.
PART = 1 << 22
#: Ranks of a tile's side, and the pairs from which a tile is counted in a dense array.
SIDE, DENSE = 1024, 1 << 16
_BREAKS = list(b".,;:!?\n\x0b\x0c\r")
_INSIDE = np.ones(256, bool)
_INSIDE[[32, 9, *_BREAKS]] = False
_BREAK = np.zeros(256, bool)
_BREAK[_BREAKS] = True


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, bytes, offsets of texts, starts and ends of words) of some texts of one language at a time."""
    for batch in batches:
        langs = batch.column("lang").fill_null("und")
        for lang in langs.unique().to_pylist():
            data, offsets = text_bytes(batch.column("text").filter(pc.equal(langs, lang)))
            for a, b in texts_at_a_time(offsets, PART):
                part = data[offsets[a] : offsets[b]]
                starts, stops, _ = spans(part, offsets[a : b + 1] - offsets[a], _INSIDE)
                yield lang, part, offsets[a : b + 1] - offsets[a], starts, stops


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of some texts at a time; the null word counts all."""
    for lang, data, _, starts, stops in _texts(batches):
        _, first, counts = np.unique(span_hashes(data, starts, stops), return_index=True, return_counts=True)
        order = np.argsort(first)
        joined, ends = span_bytes(data, starts[first[order]], stops[first[order]])
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(joined)).cast(pa.string())
        words, counts = pa.concat_arrays([words, pa.nulls(1, pa.string())]), np.append(counts[order], len(starts))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(words)), words, pa.array(counts)], names=["lang", "word", "f"])


class Words:
    """A language's frequent words: ranks by frequency, and the hashes that find them."""

    def __init__(self, words: pa.Array, f: np.ndarray) -> None:
        data, offsets = text_bytes(words)
        hashes = span_hashes(data, offsets[:-1], offsets[1:])
        order = np.lexsort((hashes, -f))
        self.words, hashes = words.take(pa.array(order)), hashes[order]
        self.rank_of = np.argsort(hashes)
        self.hashes = hashes[self.rank_of]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, self.hashes)
        return np.where(at >= 0, self.rank_of[at] if len(self.rank_of) else -1, -1)


class Pairs:
    """A level's frequent pairs of a language: ranks by frequency of codes that hold a rank of the level below and a word's."""

    def __init__(self, codes: np.ndarray, f: np.ndarray) -> None:
        self.codes = codes[np.lexsort((codes, -f))]
        self.rank_of = np.argsort(self.codes)
        self.sorted = self.codes[self.rank_of]

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        at = places(codes, self.sorted)
        return np.where(at >= 0, self.rank_of[at] if len(self.rank_of) else -1, -1)


@lru_cache(maxsize=8)
def _known(path: str) -> dict:
    """The tables of each language in a stored level, as arrays: about 12 bytes and a word for a frequent word, 24 for a pair."""
    fs, inner = filesystem(path)
    table = pq.read_table(inner, filesystem=fs)
    name = "word" if "word" in table.column_names else "code"
    langs, out = table.column("lang"), {}
    for lang in langs.unique().to_pylist():
        own = table.filter(pc.equal(langs, lang))
        f = own.column("f").to_numpy()
        out[lang] = Words(own.column(name).combine_chunks(), f) if name == "word" else Pairs(own.column(name).to_numpy(), f)
    return out


def _ranked(batches: Iterator[pa.RecordBatch], words_at: str) -> Iterator[pa.RecordBatch]:
    """Runs of two and more frequent words, as their ranks, with -1 after each; a break of pieces or a rare word ends a run."""
    known = _known(words_at)
    for lang, data, offsets, starts, stops in _texts(batches):
        if lang not in known or not len(starts):
            continue
        ranks = known[lang].ranks(span_hashes(data, starts, stops))
        marks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_BREAK[data], out=marks[1:])
        text = np.searchsorted(offsets, starts, "right")
        together = (ranks[1:] >= 0) & (ranks[:-1] >= 0) & (marks[starts[1:]] == marks[stops[:-1]]) & (text[1:] == text[:-1])
        before, after = np.concatenate([[False], together]), np.concatenate([together, [False]])
        keep = before | after
        last = keep & ~after
        out = np.full(int(keep.sum() + last.sum()), -1, np.int32)
        at = np.cumsum(keep + np.concatenate([[0], last[:-1]]))[keep] - 1
        out[at] = ranks[keep]
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([out.tobytes()], pa.binary())], names=["lang", "ranks"])


def tiled(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the distinct pairs (i, j) of ranks, code = i * 2 ** 32 + j.

    Pairs fall into tiles of SIDE x SIDE ranks. A tile with many is addressed directly, one cell for each pair, and
    counted by bincount; the pairs of all other tiles are sorted and counted as one list.
    """
    tile = ((i // SIDE) << 32) | (j // SIDE)
    order = np.argsort(tile, kind="stable")
    i, j, tile = i[order], j[order], tile[order]
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(tile)))
    codes, counts, sparse = [], [], np.ones(len(tile), bool)
    for a, n in zip(first[sizes >= DENSE].tolist(), sizes[sizes >= DENSE].tolist(), strict=True):
        cells = np.bincount((i[a : a + n] % SIDE) * SIDE + j[a : a + n] % SIDE, minlength=SIDE * SIDE)
        full = np.flatnonzero(cells)
        codes.append(((i[a] // SIDE * SIDE + full // SIDE) << 32) | (j[a] // SIDE * SIDE + full % SIDE))
        counts.append(cells[full])
        sparse[a : a + n] = False
    rest, times = np.unique((i[sparse] << 32) | j[sparse], return_counts=True)
    return np.concatenate([*codes, rest]), np.concatenate([*counts, times])


def _pair_counts(batches: Iterator[pa.RecordBatch], levels: list[str]) -> Iterator[pa.RecordBatch]:
    """(lang, code, f) of the pairs of the next level: a frequent phrase of the last one, and the word after it, if the phrase that begins a word later is frequent too."""
    known = [_known(x) for x in levels]

    def counted(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(parts).astype(np.int64)
        phrase, last = words, words
        for level in known:
            code = np.where((phrase[:-1] >= 0) & (last[1:] >= 0), (phrase[:-1] << 32) | last[1:], -1)
            phrase, last = level[lang].ranks(code) if lang in level else np.full(len(code), -1), last[1:]
        if len(levels):
            ok = (phrase[:-1] >= 0) & (phrase[1:] >= 0)
        else:
            ok = (words[:-1] >= 0) & (words[1:] >= 0)
        codes, counts = tiled(phrase[:-1][ok], last[1:][ok])
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "f"])

    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            lang, ranks = batch.column("lang")[k].as_py(), np.frombuffer(batch.column("ranks")[k].as_buffer(), np.int32)
            held.setdefault(lang, []).append(ranks.copy())
            if 4 * sum(map(len, held[lang])) >= PART:
                yield counted(lang, held.pop(lang))
    for lang, parts in held.items():
        yield counted(lang, parts)


def _named(batches: Iterator[pa.RecordBatch], words_at: str, levels: list[str]) -> Iterator[pa.RecordBatch]:
    """The codes of the level above `levels` as phrases, words joined by spaces."""
    words, known = _known(words_at), [_known(x) for x in levels]
    for batch in batches:
        out = []
        for lang, code in zip(batch.column("lang").to_pylist(), batch.column("code").to_pylist(), strict=True):
            ranks = [code & 0xFFFFFFFF]
            code >>= 32
            for level in reversed(known):
                code = int(level[lang].codes[code])
                ranks.append(code & 0xFFFFFFFF)
                code >>= 32
            out.append(" ".join(words[lang].words[k].as_py() for k in [code, *reversed(ranks)]))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.string()), batch.column("f")], names=["lang", "phrase", "f"])


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of 1 to `longest` words found `least` times and more, and (lang, n) of all words; both stored.

    docs: lang string (null: `und`), text string (null: empty). Words are counted within tasks first. A phrase of k + 1
    words can only be frequent if both phrases of k words in it are, so each level pairs the ranks of those with the
    ranks of words; tasks count pairs in tiles, Spark adds up the tasks' counts by pair. Tasks read the frequent words
    and phrases from files in the shared folder, 20 to 40 bytes each; there is at most one for each `least` words.
    """
    docs = docs.select("lang", "text")
    every = docs.mapInArrow(_word_counts, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    every = stored(every.filter(F.col("word").isNull() | (F.col("f") >= least)), "words")
    words = stored(every.filter(F.col("word").isNotNull()), "words")
    n = every.filter(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    words_at = words.stored_at
    ranked = stored(docs.mapInArrow(lambda x: _ranked(x, words_at), "lang string, ranks binary"), "ranks")
    found, levels = [words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")], []
    for size in range(2, longest + 1):
        own = list(levels)
        level = ranked.mapInArrow(lambda x, y=own: _pair_counts(x, y), "lang string, code long, f long").groupBy("lang", "code").agg(F.sum("f").alias("f"))
        level = stored(level.filter(F.col("f") >= least), "pairs")
        named = level.mapInArrow(lambda x, y=own: _named(x, words_at, y), "lang string, phrase string, f long")
        found.append(named.select("lang", "phrase", F.lit(size).alias("words"), "f"))
        levels.append(level.stored_at)
        if level.isEmpty():
            break
    out = stored(reduce(DataFrame.unionByName, found), "phrases"), stored(n, "sizes")
    forget(ranked, every, words)
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank int, phrase, a, l, r, n, score): each language's phrases of two words and more whose parts attract each other most.

    a, l, r: how often the phrase and the two parts of its weakest cut occur, n: all words. score = floor(1000 * a * n /
    (l * r)), in decimals of 38 digits; of equal cuts the first counts. A phrase goes if a longer frequent one holds it and
    is as frequent. Null and empty texts have no words, a null lang counts as `und`, rows repeated count each. Other
    columns are not returned. A language has rows if it has such phrases; `top` of each are given, by score, a and phrase.
    """
    phrases, n = phrase_counts(docs, least, longest)
    split = F.split("phrase", " ")
    many = phrases.filter("words > 1").withColumn("_w", split)
    part = lambda a, size: F.array_join(F.slice("_w", a, size), " ")
    inner = many.filter("words > 2").select("lang", "f", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase")).distinct()
    kept = many.join(inner, ["lang", "phrase", "f"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "_w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    f = lambda name, side: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(f("l", "left"), ["lang", "left"]).join(f("r", "right"), ["lang", "right"]).join(n, "lang")
    whole = "CAST(CAST(1000 AS decimal(4,0)) * CAST(a AS decimal(16,0)) AS decimal(19,0)) * CAST(n AS decimal(19,0)) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))"
    scored = cuts.withColumn("score", F.expr(whole))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
