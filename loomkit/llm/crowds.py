"""Links within crowds: documents of which most share most of their shingles, joined on the shingles that are rarest there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Sets that ask together, and sets that they are held against together.
ASK, MET = 64, 2048

def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for k in range(batch.num_rows):
            shingles = np.frombuffer(batch.column("shingles")[k].as_py(), np.int64)
            repeated = [pa.array(np.full(len(shingles), batch.column(c)[k].as_py(), np.int64)) for c in ("node", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(shingles), *repeated, pa.array(np.full(len(shingles), len(shingles), np.int32))], names=["shingle", "node", "component", "n"])


def links_between(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, per_cent: int) -> pa.Table:
    """(a, b): links between components among sets held together.

    Each asking set counts what it has in common with all others at once, by their shingles in one sorted array; a link
    is given out only if its ends aren't joined yet, so there are fewer than sets.
    """
    sizes = np.asarray([len(x) for x in sets], np.int64)
    _, of = np.unique(component, return_inverse=True)
    out: list[tuple[int, int]] = []
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, holder = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    parent = list(range(int(of.max(initial=-1)) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(asks).tolist():
        low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        span = high - low
        at = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
        common = np.bincount(holder[at], minlength=len(sets))
        for k in np.flatnonzero(100 * common >= per_cent * (sizes + sizes[i] - common)).tolist():
            x, y = root(of[i]), root(of[k])
            if x != y:
                parent[x] = y
                out.append((node[i].item(), node[k].item()))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def cross_links(sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): links of at least `per_cent` between sets of different components; enough of them to join what is linked.

    sets: node long, component long, shingles binary. Shingles are ordered by how many of the sets hold them, rarest
    first. Of sets of n <= m shingles that are alike, `overlap` = ceil(p * (n + m) / (100 + p)) are common, so their first
    common shingle is among the smaller's first n - ceil(2 p n / (100 + p)) + 1 and the larger's first m - ceil(p m / 100) + 1.
    A template's shingles are frequent and come last: in a crowd below the threshold they aren't among the smaller's.

    Sets that meet at a shingle are grouped by the component that holds most of it, its top: those of other components
    ask, ASK together, and are held against the sets they may be like, MET together, by counting. So the members of a
    group of copies never meet each other, and no pairs are rows. A shingle of one component alone joins nothing.
    """
    both = 100 + per_cent
    rows = sets.mapInArrow(_spread, "shingle long, node long, component long, n int")
    held = rows.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("component") != F.max("component")).alias("mixed")).filter("df > 1")
    own = rows.join(held, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle", "mixed"))).alias("s"))
    # shingles that no other set holds come first and aren't listed
    listed = F.transform("s", lambda x, i: F.struct(x["shingle"].alias("shingle"), x["mixed"].alias("mixed"), (F.col("n") - F.size("s") + i).alias("place")))
    small, large = F.col("n") - F.ceil(F.col("n") * (2 * per_cent) / both), F.col("n") - F.ceil(F.col("n") * per_cent / 100)
    first = F.filter(F.slice(listed, 1, F.greatest(large - F.col("n") + F.size("s") + 1, F.lit(0)).cast("int")), lambda x: x["mixed"])
    dealt = stored(own.select("node", "component", F.explode(first).alias("x"), small.alias("_small")).select("node", "component", "x.shingle", (F.col("x.place") <= F.col("_small")).alias("small")), "crowd")
    most = dealt.groupBy("shingle", "component").agg(F.count("*").alias("k"), F.max("small").alias("s")).groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.count("*").alias("_c"), F.max("s").alias("_s")).filter("_c > 1 and _s")
    marked = dealt.join(most.select("shingle", "top"), "shingle").withColumn("few", F.col("component") != F.col("top"))
    # of two sets that meet one must hold the shingle as a smaller one: the asking set (kind 1) or the one it asks (kind 2)
    asking = marked.filter("few").select("top", F.when(F.col("small"), 1).otherwise(2).alias("kind"), "node", "component").distinct()
    kinds = marked.groupBy("shingle").agg(F.max(F.col("few") & F.col("small")).alias("_1"), F.max(F.col("few") & ~F.col("small")).alias("_2"))
    kind = F.explode(F.array_compact(F.array(F.when(F.col("_1"), 1), F.when(F.col("_2") & F.col("small"), 2))))
    asked = marked.join(kinds, "shingle").select("top", kind.alias("kind"), "node", "component").distinct()
    parts = lambda df, name, size: df.groupBy("top", "kind").agg(F.ceil(F.count("*") / size).alias(name))
    counts = parts(asking, "asks", ASK).join(parts(asked, "met", MET), ["top", "kind"])
    hashed, numbers = F.xxhash64("node"), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)
    groups = [
        asking.join(counts, ["top", "kind"]).select("top", "kind", F.pmod(hashed, "asks").alias("ask"), F.explode(numbers("met")).alias("part"), "node", "component", F.lit(True).alias("asking")),
        asked.join(counts, ["top", "kind"]).select("top", "kind", F.explode(numbers("asks")).alias("ask"), F.pmod(hashed, "met").alias("part"), "node", "component", F.lit(False).alias("asking")),
    ]
    met = groups[0].unionByName(groups[1]).join(sets.select("node", "shingles"), "node")
    return met.groupBy("top", "kind", "ask", "part").applyInArrow(lambda t: _asked(t, per_cent), "a long, b long")


def _asked(table: pa.Table, per_cent: int) -> pa.Table:
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    return links_between(table.column("node").to_numpy(), table.column("component").to_numpy(), sets, table.column("asking").to_numpy(), per_cent)
