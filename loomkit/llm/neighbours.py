"""Approximate nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block of the index, and queries that meet it in one task.
BLOCK, QUERY_BLOCK = 8192, 4096
#: Projections, in sets of orthogonal lines; how many of them must collide.
PROJECTIONS, COLLISIONS = 128, 109
#: Half width of a window for radius 1 on unit vectors, over the root of their length; first radius, and its growth from round to round.
WIDTH, RADIUS, GROWTH = 1.5, 0.75, 1.07
#: Distance between the sorted arrays of neighbouring projections, above the reach of any window.
GAP = 1e3


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Every row times a power of two, so that its largest component is near 1 and no square over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


class CollisionIndex:
    """Sorted projections of the unit vectors of one block."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        size, rng = vectors.shape[1], np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.standard_normal((size, min(size, PROJECTIONS))))[0] for _ in range(-(-PROJECTIONS // size))]
        self.lines = np.concatenate(turns, axis=1)[:, :PROJECTIONS]
        places = (self.vectors / self.norms[:, None]) @ self.lines
        order = np.argsort(places, axis=0, kind="stable")
        #: All sorted arrays in one: those of line j lie between `GAP` * j - 1 and `GAP` * j + 1 or so.
        self.values = (np.take_along_axis(places, order, axis=0) + GAP * np.arange(PROJECTIONS)).T.ravel()
        #: The place of every vector in each sorted array.
        self.ranks = np.empty((PROJECTIONS, len(vectors)), np.uint16)
        np.put_along_axis(self.ranks, order.T, np.arange(len(vectors), dtype=np.uint16)[None], axis=1)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the vectors verified for a query; rows of skip take no part.

        Windows around the query grow with a radius on every projection; a vector that collides in COLLISIONS of them
        is verified. The search ends when k vectors verified lie within the radius, or when the windows hold the block.
        """
        n = len(self.vectors)
        query = scaled(query[None])[0]
        norm = np.sqrt((query * query).sum())
        centre = (query / norm) @ self.lines + GAP * np.arange(PROJECTIONS)
        first = n * np.arange(PROJECTIONS)
        radius, seen = RADIUS, np.zeros(n, bool)
        seen[skip] = True
        rows, cosines = [np.zeros(0, np.int64)], [np.zeros(0)]
        while True:
            wide = radius * WIDTH / np.sqrt(len(query))
            low, high = (np.clip(np.searchsorted(self.values, centre + x) - first, 0, n) for x in (-wide, wide))
            # a vector collides where its place lies in the window; below its start the difference wraps round to a large number
            inside = self.ranks - low.astype(np.uint16)[:, None] < (high - low).astype(np.uint16)[:, None]
            whole = (high - low == n).all()
            fresh = np.flatnonzero((whole | (inside.view(np.uint8).sum(axis=0, dtype=np.uint8) >= COLLISIONS)) & ~seen)
            if len(fresh):
                seen[fresh] = True
                rows.append(fresh)
                cosines.append((self.vectors[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm))
            near = sum(int((c >= 1 - radius * radius / 2).sum()) for c in cosines)
            if near >= k or whole:
                return np.concatenate(rows), np.concatenate(cosines)
            radius *= GROWTH


def usable(vectors: DataFrame) -> DataFrame:
    """One row of each vec_id whose embedding is not null, has no null or non-finite component, and isn't all zero."""
    value = F.col("embedding")
    whole = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.cast("array<double>").alias("embedding"))
    kept = kept.filter(F.col("vec_id").isNotNull() & whole & F.exists(value, lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query its k nearest vectors found, by cosine: query_id, rank, vec_id, score.

    vectors and queries: vec_id long, embedding array of numbers. Null, zero or not finite vectors take no part;
    of rows with one vec_id one is used; a query never finds its own vec_id; ties go to smaller vec_ids; vectors
    meet queries of their own length only. Blocks of the index and blocks of queries meet in tasks of bounded
    size, each row of the index in one block: the queries are held against all rows, so the work is that of both.
    """
    base, asked = usable(vectors), usable(queries)
    blocks = max(1, -(-vectors.count() // BLOCK))
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = lambda df, own, n, other, m: df.withColumns({"dim": F.size("embedding"), own: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    left = deal(base, "block", blocks, "asked", groups)
    right = deal(asked, "asked", groups, "block", blocks)

    def meet(own: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if own.num_rows and wanted.num_rows:
            matrix = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            ids = own.column("vec_id").to_numpy()
            index = CollisionIndex(matrix(own))
            for query_id, query in zip(wanted.column("vec_id").to_pylist(), matrix(wanted), strict=True):
                rows, score = index.search(query, k, np.flatnonzero(ids == query_id))
                best = np.lexsort((ids[rows], -score))[:k]
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[rows[best]].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["dim", "block", "asked"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
