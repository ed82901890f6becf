"""Near-duplicate documents: an LSH forest of MinHash signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.operators.components import connected_components
from loomkit.sources.store import forget

from . import crowds
from .common import mix, stored, text_bytes
from .words import shingle_sets, texts_at_a_time

SHINGLE, PER_CENT = 5, 75
#: Trees of the forest, and the values that two documents share at the least in a tree to meet there.
TREES, DEPTH = 20, 3
#: Rows of a region that meet; one with more is deepened. Its rows are then ordered by so many turns of their values.
CROWD, TURNS = 512, 4
#: Shingles of a region that meet: sets are held by one task.
SHINGLES = 1 << 22
#: Share of equal signature values that a candidate needs: about four standard deviations below 0.75.
FLOOR = 0.52
#: Rows that a task looks at together.
HELD = 1 << 15
_VALUES = TREES * DEPTH
_TREE = np.uint64(31)
_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**32, _VALUES, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**32, _VALUES, dtype=np.uint32) | np.uint32(1)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of MinHash values for each text that has shingles."""
    have = sizes[sizes > 0]
    starts = np.cumsum(have) - have
    high = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(have), _VALUES), np.uint32)
    for k in range(_VALUES):
        out[:, k] = np.minimum.reduceat((high ^ _XOR[k]) * _TIMES[k], starts)
    return out


def regions(sig: np.ndarray) -> np.ndarray:
    """The region of each signature in each tree: a hash of the tree's first values, the tree's number in its low bits."""
    out = np.empty((len(sig), TREES), np.uint64)
    for t in range(TREES):
        key = np.full(len(sig), t + 1, np.uint64)
        for k in range(DEPTH):
            key = mix(key + sig[:, t * DEPTH + k])
        out[:, t] = (key & ~_TREE) | np.uint64(t)
    return out


def _set_keys(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each text's whole set; 0 where it is empty."""
    keys = []
    have = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[have]
    for salt in (1, 2):
        key = np.zeros(len(sizes), np.uint64)
        if have.any():
            key[have] = mix(np.add.reduceat(mix(sets + np.uint64(salt)), starts) + sizes[have].astype(np.uint64))
        keys.append(key.view(np.int64))
    return keys[0], keys[1]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for a, b in texts_at_a_time(offsets):
        own = offsets[a : b + 1]
        yield a, b, *shingle_sets(data[own[0] : own[-1]], own - own[0], SHINGLE)


def _rows(values: np.ndarray, have: np.ndarray) -> pa.Array:
    """The rows of values as bytes, null where a text has none."""
    out = np.full(len(have), None, object)
    out[have] = [r.tobytes() for r in values]
    return pa.array(out, pa.binary())


_PROFILE = ["doc_id", "own", "n_shingles", "key1", "key2", "low", "regions"]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, sets, sizes in _parts(batch):
            key1, key2 = _set_keys(sets, sizes)
            sig = signatures(sets, sizes) if len(sets) else np.zeros((0, _VALUES), np.uint32)
            have = sizes > 0
            kept = [batch.column(c).slice(a, b - a) for c in ("doc_id", "own")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), pa.array(key1), pa.array(key2), _rows(sig.astype(np.uint8), have), _rows(regions(sig), have)], names=_PROFILE)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of every node in every tree."""
    for batch in batches:
        if batch.num_rows:
            found = np.frombuffer(b"".join(batch.column("regions").to_pylist()), np.int64)
            node = np.repeat(batch.column("node").to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(node)], names=["region", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of regions with more than one row, those of crowds once for each turn; rows come in order of region.

    A partition may end inside a region, so what lies at its ends is given out in any case.
    """

    def out(region: np.ndarray, node: np.ndarray, at_edge: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], region[1:] != region[:-1]])
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run]
        crowd = (size > CROWD) | (at_edge & (size > CROWD // 4))
        keep = (size > 1) | at_edge
        copies = np.where(crowd, TURNS, 1)[keep]
        turn = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(x[keep], copies)) for x in (region, node, crowd)] + [pa.array(turn.astype(np.int32))], names=["region", "node", "crowd", "turn"])

    region = node = np.zeros(0, np.int64)
    first = True
    for batch in batches:
        region, node = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((region, "region"), (node, "node")))
        if len(region) < HELD or region[0] == region[-1] and len(region) < 64 * HELD:
            continue
        cut = int(np.searchsorted(region, region[-1])) or len(region)  # a region beyond all bounds goes out in parts
        edge = np.zeros(cut, bool) | (cut == len(region))
        edge |= first & (region[:cut] == region[0])
        yield out(region[:cut], node[:cut], edge)
        region, node, first = region[cut:], node[cut:], cut == len(region)
    if len(region):
        yield out(region, node, (region == region[-1]) | (first & (region == region[0])))


def _possible(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be alike enough."""
    return 100 * np.minimum(n, m) >= PER_CENT * np.maximum(n, m)


def deepened(prefix: np.ndarray, n: np.ndarray, crowd: int = CROWD, shingles: int = SHINGLES) -> np.ndarray:
    """The first row of every group of rows that meet; rows are sorted by their values.

    prefix: how many values a row has in common with the one before it, 0 where a region begins. A group with too many
    rows or shingles is cut where the common prefix is shortest, again and again, so its depth grows until it is small;
    rows whose values are all the same are cut into equal parts.
    """
    starts = np.flatnonzero(prefix == 0).tolist()
    ends = [*starts[1:], len(prefix)]
    total = np.concatenate([[0], np.cumsum(n)])
    out, todo = [], list(zip(starts, ends, strict=True))
    while todo:
        a, b = todo.pop()
        if b - a <= 2 or (b - a <= crowd and total[b] - total[a] <= shingles):
            out.append(a)
            continue
        inside = prefix[a + 1 : b]
        least = inside.min()
        cuts = np.flatnonzero(inside == least) + a + 1
        if least == _VALUES:
            cuts = np.asarray([(a + b) // 2])
        edges = [a, *cuts.tolist(), b]
        todo += zip(edges[:-1], edges[1:], strict=True)
    return np.sort(np.asarray(out, np.int64))


def _met(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, group of each row) of rows that come sorted by region, turn and values; groups are as deep as they must be.

    A region that goes beyond HELD rows is cut where the common prefix of two rows is shortest.
    """
    held: dict[str, np.ndarray] = {}
    for batch in (*batches, None):
        if batch is not None and batch.num_rows:
            new = {c: batch.column(c).to_numpy() for c in names}
            new["place"] = np.frombuffer(b"".join(batch.column("place").to_pylist()), np.uint8).reshape(-1, _VALUES)
            held = {c: np.concatenate([held[c], new[c]]) for c in new} if held else new
        rows = len(held["node"]) if held else 0
        if not rows or (batch is not None and rows < HELD):
            continue
        place = held["place"]
        differs = place[1:] != place[:-1]
        prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), _VALUES)
        prefix = np.concatenate([[0], np.where((held["region"][1:] == held["region"][:-1]) & (held["turn"][1:] == held["turn"][:-1]), np.maximum(prefix, 1), 0)])
        cut = rows
        if batch is not None:
            later = prefix[rows // 2 :]
            cut = rows // 2 + int(len(later) - 1 - later[::-1].argmin())
        first = deepened(prefix[:cut], held["n"][:cut])
        group = np.zeros(cut, np.int64)
        group[first[1:]] = 1
        yield {c: x[:cut] for c, x in held.items()}, np.cumsum(group)
        held = {c: x[cut:] for c, x in held.items()}


def _alike(rows: dict[str, np.ndarray], group: np.ndarray, apart: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, equal values) of candidates within groups, by their distance in the order; of different `apart` only."""
    n, node, place = rows["n"], rows["node"], rows["place"]
    b, step = np.arange(len(group)), 0
    while True:
        step += 1
        b = b[b >= step]
        b = b[group[b] == group[b - step]]
        if not len(b):
            return
        for part in np.array_split(b, len(b) // HELD + 1):
            a, c = part - step, part
            ok = (node[a] != node[c]) & _possible(n[a], n[c])
            if apart is not None:
                ok &= apart[a] != apart[c]
            a, c = a[ok], c[ok]
            same = (place[a] == place[c]).sum(axis=1)
            ok = same >= FLOOR * _VALUES
            if ok.any():
                yield a[ok], c[ok], same[ok]


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row the candidate of its group that is most like it."""
    for rows, group in _met(batches, ["region", "turn", "node", "n"]):
        most, other = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for a, b, same in _alike(rows, group):
            for x, y in ((a, b), (b, a)):
                better = same > most[x]
                most[x[better]], other[x[better]] = same[better], rows["node"][y[better]]
        has = most > 0
        yield pa.RecordBatch.from_arrays([pa.array(rows["node"][has]), pa.array(other[has]), pa.array(most[has].astype(np.int32))], names=["node", "other", "same"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a candidate of another component in their group, which is named by its region, turn and first node."""
    for rows, group in _met(batches, ["region", "turn", "node", "n", "component"]):
        flagged = np.zeros(len(group), bool)
        for a, b, _ in _alike(rows, group, rows["component"]):
            flagged[a] = flagged[b] = True
        name = mix(rows["region"].view(np.uint64) + mix(rows["turn"].astype(np.uint64)))
        name = mix(name ^ rows["node"][np.searchsorted(group, group)].view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(name[flagged]), pa.array(rows["node"][flagged]), pa.array(rows["component"][flagged])], names=["meeting", "node", "component"])


def _across(table: pa.Table) -> pa.Table:
    """Links between components, by full sets, of the rows of one group: all but the largest component's ask."""
    own = table.column("component").to_numpy()
    _, of, counts = np.unique(own, return_inverse=True, return_counts=True)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    return crowds.links_between(table.column("node").to_numpy(), own, sets, of != counts.argmax(), PER_CENT)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, sets, sizes in _parts(batch):
            key, _ = _set_keys(sets, sizes)
            own = pa.array(key == batch.column("node").slice(a, b - a).to_numpy())  # another row with the same key is none of these
            ends = np.cumsum(sizes)
            blobs = [sets[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key).filter(own), pa.array(blobs, pa.binary()).filter(own)], names=["node", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            linked.append(100 * common >= PER_CENT * (len(both) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])


def _places(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """shared with n and place: the low bytes of a node's values, the tree's first values first, then the others from where the turn begins."""
    tree, rest = F.col("region").bitwiseAND(int(_TREE)) * DEPTH, _VALUES - DEPTH
    both = shared.join(nodes.select("node", "n", "low").hint("merge"), "node")
    twice = F.concat("low", "low")
    turn = (F.col("turn") * (rest // TURNS)).cast("int")
    later = F.substring(twice, (tree + DEPTH + 1).cast("int"), F.lit(rest))
    later = F.concat(F.substring(later, turn + 1, F.lit(rest)), F.substring(later, F.lit(1), turn))
    return both.select("region", "turn", "crowd", "node", "n", F.concat(F.substring("low", (tree + 1).cast("int"), F.lit(DEPTH)), later).alias("place"))


def _in_order(placed: DataFrame) -> DataFrame:
    """Rows sorted by region, turn and place; only crowds are dealt to several tasks, by their places."""
    dealt = placed.repartitionByRange("region", "turn", F.when(F.col("crowd"), F.col("place")))
    return dealt.sortWithinPartitions("region", "turn", "place", "node").drop("crowd")


def _full_sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes asked for, from their texts; stored."""
    asked = nodes.join(asked.hint("merge"), "node", "left_semi").select("node", "own")
    texts = docs.join(asked.hint("merge"), "own").groupBy("own", "node").agg(F.any_value("text").alias("text"))  # dealt by own already
    return stored(texts.mapInArrow(_sets, "node long, shingles binary"), "sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links, by their full sets."""
    left, right = (sets.select(F.col("node").alias(end), F.col("shingles").alias(side)).hint("merge") for end, side in (("a", "left"), ("b", "right")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm, "a long, b long")


def _crowds_linked(crowded: DataFrame, sets: DataFrame, links: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and components with those that deepened regions may have torn apart, found by rare shingles.

    crowded: region, node of the regions with a crowd; only those in which components differ are looked at.
    """
    of = crowded.join(components.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    torn = of.groupBy("region").agg((F.min("component") != F.max("component")).alias("torn")).filter("torn").select("region")
    inside = stored(of.join(torn.hint("merge"), "region", "left_semi").select("node", "component").distinct(), "torn")
    if not inside.isEmpty():
        more = stored(links.unionByName(crowds.cross_links(sets.join(inside.hint("merge"), "node"), PER_CENT)), "links")
        forget(links, components)
        links, components = more, connected_components(more)
    forget(inside)
    return links, components


def row_key() -> Column:
    """A hash of a row's doc_id and text."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(docs: DataFrame, with_own: bool = False) -> DataFrame:
    """docs (doc_id long, text string) with n_shingles, component_id and kept.

    Documents are linked if 75 per cent of the distinct five-word shingles of both are common to them (words by white
    space, A-Z as a-z); null, empty and blank texts have none and are linked with nothing. component_id is the
    smallest doc_id reachable by links, kept whether it is the row's own. Texts with equal sets are one node. Every
    tree of the forest orders the nodes by their signatures; nodes that share a tree's first values are a region.

    1. A region with more than CROWD rows is deepened, one more value at a time, until what is left together is small;
       it is so in TURNS orders of the values, for pairs that one order tears apart. In what is left all rows meet by
       their signatures, and each has its best candidate confirmed on full sets.
    2. Rows of the other regions with a candidate in another component meet there again, now all by their full sets.
    3. A pair can be torn apart in all orders of a crowd that is nearly as alike as the pair. So the rows of crowds whose
       components differ are held against each other where they share a shingle that is rare among them (crowds.cross_links), which misses no link.

    Two documents at exactly 0.75 miss each other in all trees with a chance of 2e-5.

    Rows repeated whole are one node, and all kept or none; a null doc_id is no candidate for component_id, and rows
    of a component without any other are all kept. Other columns are not returned; with_own gives `own`, the row_key().
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("own", row_key())
    profile = stored(docs.mapInArrow(_profile, "doc_id long, own long, n_shingles long, key1 long, key2 long, low binary, regions binary"), "profile")
    key = ["key1", "key2", "n_shingles"]
    some = profile.filter("n_shingles > 0").groupBy(*key).agg(F.min("own").alias("own"), F.min("doc_id").alias("doc_id"), F.any_value("low").alias("low"), F.any_value("regions").alias("regions"))
    nodes = stored(some.select(F.col("key1").alias("node"), "key2", F.col("n_shingles").alias("n"), "doc_id", "own", "low", "regions"), "nodes")
    members = stored(profile.select("doc_id", "own", *key), "rows")
    forget(profile)
    forest = nodes.mapInArrow(_forest, "region long, node long").repartitionByRange("region", "node").sortWithinPartitions("region", "node")
    shared = stored(forest.mapInArrow(_shared, "region long, node long, crowd boolean, turn int"), "shared")
    placed = stored(_places(shared, nodes), "placed")
    forget(shared)
    best = _in_order(placed).mapInArrow(_best, "node long, other long, same int").groupBy("node").agg(F.max_by("other", F.struct("same", "other")).alias("other"))
    pairs = stored(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")
    full = placed.filter("crowd").select("region").distinct()
    crowded = stored(placed.filter("turn = 0").select("region", "node").join(full.hint("merge"), "region", "left_semi"), "crowded")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    sets = _full_sets(docs, nodes, asked)
    links = stored(_linked(pairs, sets), "links")
    components = connected_components(links)
    again = placed.filter("not crowd").join(components.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    opened = stored(_in_order(again).mapInArrow(_open, "meeting long, node long, component long"), "open")
    forget(placed, pairs, components)
    across = opened.join(sets.hint("merge"), "node").groupBy("meeting").applyInArrow(_across, "a long, b long")
    every = stored(links.unionByName(across), "links")
    forget(opened, links)
    every, components = _crowds_linked(crowded, sets, every, connected_components(every))
    forget(crowded, sets)
    of = nodes.select("node", "key2", "doc_id").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = stored(of.join(least, "component").select(F.col("node").alias("key1"), "key2", "component_id"), "members")
    forget(nodes, every, components)
    out = members.join(of, ["key1", "key2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", *["own"] * with_own, "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
