"""Ranked lexical search: sums of short posting lists as one bounded list among the long ones, read document by document with skips."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.sources.store import forget

from .common import stored, text_bytes
from .terms import places, span_hashes, spans
from .words import texts_at_a_time

TOP = 50
#: Terms of the items that are searched together: about so many go to every task, 8 bytes each.
ITEM_TERMS = 1 << 17
#: Bytes of text of a block of the index.
BLOCK = 1 << 24
#: Documents of a block that are looked at together, and the share of a block's documents up to which a list is short.
WINDOW, SHORT = 2048, 1 / 16
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_INDEX = "n_docs long, n_terms long, ids binary, known binary, sizes binary, terms binary, counts binary, docs binary, tfs binary"


def _column_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes of the terms of these texts, number of each text's), some texts at a time."""
    data, offsets = text_bytes(column)
    for a, b in texts_at_a_time(offsets, BLOCK):
        own = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        starts, stops, counts = spans(part, own, _INSIDE)
        yield a, b, span_hashes(part, starts, stops), counts


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every item with the hashes of its distinct terms; items without terms go."""
    for batch in batches:
        for a, b, hashes, counts in _column_hashes(batch.column("text")):
            ends = np.cumsum(counts)
            own = [np.unique(hashes[e - n : e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            some = pa.array(counts > 0)
            blobs = pa.array([x.tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a).filter(some), blobs.filter(some), pa.array([len(x) for x in own]).filter(some)], names=["item_id", "terms", "n"])


def _index(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents: ids in ascending order (nulls last), sizes, and the postings of the vocabulary's terms."""
    known = vocabulary.value
    for batch in batches:
        for a, b, hashes, counts in _column_hashes(batch.column("text")):
            ids = batch.column("doc_id").slice(a, b - a)
            has = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((ids, ~has))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = places(hashes, known)
            hit = at >= 0
            doc = np.repeat(place, counts)[hit]
            cells, tf = np.unique(at[hit] * len(order) + doc, return_counts=True)
            term, doc = cells // max(1, len(order)), cells % max(1, len(order))
            terms, df = np.unique(term, return_counts=True)
            arrays = [ids[order], has[order], counts[order].astype(np.int64), terms.astype(np.int32), df.astype(np.int32), doc.astype(np.int32), tf.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())]), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=[c.split()[0] for c in _INDEX.split(", ")])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.frombuffer(counts, np.int32).astype(np.int64))], names=["term", "df"])


class Best:
    """The best documents of an item so far: highest score first, then smaller id, rows without id last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """The least score that may still enter; ties may."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        ok = scores >= self.floor
        if ok.any():
            scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores[ok]), (self.ids, ids[ok]), (self.known, known[ok])))
            order = np.lexsort((ids, ~known, -scores))[: self.top]
            self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def _summed(docs: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct documents in order with the sums of their parts."""
    order = np.argsort(docs, kind="stable")
    docs, parts = docs[order], parts[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return docs[first], np.add.reduceat(parts, first) if len(first) else parts


def search_block(lists: list[tuple[np.ndarray, np.ndarray, int]], n: int, best: Best, ids: np.ndarray, known: np.ndarray) -> None:
    """Adds a block's documents to an item's best.

    lists: (documents in order, their parts of the score, the largest part) of each term; n: the block's documents.
    Lists of up to SHORT of the documents are summed term at a time into one list of accumulators, with the largest sum
    as its bound. It and the long lists are then read in windows of documents. Lists whose bounds together stay below
    the floor name no candidates: a document on them alone can't enter. Of the others' documents those go on whose sum
    and the bounds still open reach the floor; they are looked up list by list, highest bound first, skipping all between.
    """
    few = [x for x in lists if len(x[0]) <= SHORT * n]
    rows = [x for x in lists if len(x[0]) > SHORT * n]
    if few:
        docs, parts = _summed(np.concatenate([x[0] for x in few]), np.concatenate([x[1] for x in few]))
        rows.append((docs, parts, int(parts.max())))
    rows.sort(key=lambda x: x[2])
    bounds = np.cumsum([0, *(x[2] for x in rows)])  # bounds[k]: the most that the first k lists give together
    if bounds[-1] < best.floor:
        return
    edges = np.arange(0, n + WINDOW, WINDOW)
    cuts = [np.searchsorted(x[0], edges) for x in rows]
    for w in range(len(edges) - 1):
        idle = int(np.searchsorted(bounds, best.floor, "left")) - 1  # lists that name no candidates
        if idle >= len(rows):
            return
        named = [(rows[k][0][cuts[k][w] : cuts[k][w + 1]], rows[k][1][cuts[k][w] : cuts[k][w + 1]]) for k in range(max(0, idle), len(rows))]
        docs, sums = _summed(np.concatenate([x[0] for x in named]), np.concatenate([x[1] for x in named]))
        for k in range(idle - 1, -1, -1):
            ok = sums + bounds[k + 1] >= best.floor
            docs, sums = docs[ok], sums[ok]
            if not len(docs):
                break
            own, parts = rows[k][0][cuts[k][w] : cuts[k][w + 1]], rows[k][1][cuts[k][w] : cuts[k][w + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                sums = sums + np.where(own[at] == docs, parts[at], 0)
        best.add(sums, ids[docs], known[docs])


def _search(batches: Iterator[pa.RecordBatch], asked, documents: int, total: int, top: int) -> Iterator[pa.RecordBatch]:
    """Every item's best documents of a partition; the floor that a block leaves holds for the next."""
    items, weights = asked.value
    found = [Best(top) for _ in items]
    for batch in batches:
        for row in batch.to_pylist():
            ids, known, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["sizes"], np.int64)
            terms, docs, tf = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
            df = np.frombuffer(row["counts"], np.int32).astype(np.int64)
            if not len(terms):
                continue
            m = 50 + (50 * sizes * documents) // total
            parts = np.repeat(weights[terms], df) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
            ends = np.cumsum(df)
            most = np.maximum.reduceat(parts, ends - df)
            where = np.full(len(weights), -1, np.int64)
            where[terms] = np.arange(len(terms))
            for own, best in zip(items, found, strict=True):
                at = where[own]
                at = at[at >= 0]
                at = at[most[at] > 0]
                if len(at):
                    search_block([(docs[ends[k] - df[k] : ends[k]], parts[ends[k] - df[k] : ends[k]], int(most[k])) for k in at.tolist()], len(ids), best, ids, known)
    for k, best in enumerate(found):
        if len(best.scores):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), k, np.int32)), pa.array(best.ids, mask=~best.known), pa.array(best.scores)], names=["number", "doc_id", "score"])


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank int, doc_id, score long): the `top` best documents of each item, by the sum of its terms' weights.

    docs: doc_id long, text string; items: item_id, text string. Terms are runs of letters and digits of ASCII and of
    all other characters beyond it, A-Z as a-z, compared by 64-bit hashes; a term counts once for an item. Scores are
    integers (the README's formula), so they are the same however documents are dealt; equal scores go by doc_id.
    Null and empty texts have no terms: such documents aren't counted, such items have no rows. Rows without doc_id
    count and are ranked after others of their score. Rows repeated in docs are documents of their own; rows repeated
    in items are ranked as often as they stand there. Other columns are not returned.

    Items are taken in parts of about ITEM_TERMS terms, which go to every task. For each part the documents become an
    index of blocks, each with the postings of the part's terms; a task searches its blocks for all items, keeps the
    best of each, and so gives out at most `top` rows for each item, which meet in one window for each item.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    asked = stored(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms binary, n long"), "items")
    parts = -(-(asked.agg(F.sum("n")).first()[0] or 0) // ITEM_TERMS)
    numbered = asked.withColumn("part", F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(1, parts))))
    done = []
    for part in range(parts):
        rows = numbered.filter(F.col("part") == part).select("item_id", "terms").collect()  # about ITEM_TERMS terms
        own = [np.frombuffer(r.terms, np.uint64) for r in rows]
        if not own:
            continue
        vocabulary = np.unique(np.concatenate(own))
        sent = spark.sparkContext.broadcast(vocabulary)
        index = stored(docs.mapInArrow(lambda x, v=sent: _index(x, v), _INDEX), "index")
        documents, total = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        counts = index.select("terms", "counts").mapInArrow(_document_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each term of the part
        weights = np.zeros(len(vocabulary), np.int64)
        for r in counts:
            weights[r.term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
        asks = spark.sparkContext.broadcast(([places(x, vocabulary) for x in own], weights))
        found = index.mapInArrow(lambda x, a=asks, n=documents, t=total: _search(x, a, n, t, top), "number int, doc_id long, score long")
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), "ranked")
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], f"number int, item_id {kind}")
        done.append(best.join(names, "number").select("item_id", "rank", "doc_id", "score"))
        forget(index)
    forget(asked)
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
