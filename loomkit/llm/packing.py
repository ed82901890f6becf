"""Packing of token ids into sequences by bounded-space online best fit."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoded

SIZE, WINDOWS = 1024, 64
#: Leftover windows that one task merges.
MERGE = 4096
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("used", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, used long, ids binary"


class OpenWindows:
    """At most `limit` windows of `size`; place() gives (window, offset) and the window that it closed, if any."""

    def __init__(self, size: int, limit: int, first: int):
        self.size, self.limit, self.next = size, limit, first
        self.free: list[tuple[int, int]] = []  # (free ids, window), ascending

    def place(self, length: int) -> tuple[int, int, int | None]:
        closed = None
        k = bisect.bisect_left(self.free, (length, -1))
        if k < len(self.free):
            left, window = self.free.pop(k)
        else:
            if len(self.free) == self.limit:
                closed = self.free.pop(0)[1]  # the fullest
            left, window = self.size, self.next
            self.next += 1
        if left > length:
            bisect.insort(self.free, (left - length, window))
        else:
            closed = window if closed is None else closed
        return window, self.size - left, closed


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, windows: int = WINDOWS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document of docs, packed into sequences of at most `size` ids.

    docs: doc_id long, text string (null: empty; other columns are ignored). A document's ids, end_id last, are
    cut into pieces of `size`, each a sequence of its own, and a rest. Each task keeps `windows` open windows and
    places each rest best-fit; when none fits, the fullest window is emitted and a new one opened. What stays open
    at the tasks' ends is merged: `MERGE` windows of all tasks at a time, the fullest first, again best-fit.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (binary,
    little-endian unsigned 32-bit). Rows with equal doc_id are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = OpenWindows(size, windows, TaskContext.get().partitionId() << 36)
        rest: dict[int, list[tuple]] = {}
        for batch, texts in encoded(batches, tokenizer, end_id):
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                n = len(own) // 4
                for at in range(0, n, size):
                    piece = own[4 * at : 4 * (at + size)]
                    row = [doc_id, at, len(piece) // 4, zlib.crc32(piece), n, None, 0, False, size, piece if with_ids else None]
                    if row[2] == size:
                        row[5] = held.next
                        held.next += 1
                        rows.append(row)
                        continue
                    row[5], row[6], closed = held.place(row[2])
                    rest.setdefault(row[5], []).append(row)
                    if closed is not None:
                        rows += rest.pop(closed)
            if rows:
                yield _batch(rows)
        for kept in rest.values():
            used = sum(r[2] for r in kept)
            for r in kept:
                r[7], r[8] = True, used
        if rows := [r for kept in rest.values() for r in kept]:
            yield _batch(rows)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("used", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        ids, used, group = (rows.column(c).to_numpy() for c in ("sequence_id", "used", "group"))
        held = OpenWindows(size, len(rows) or 1, 0)
        new, shift, placed = [], [], {}
        for window, length in zip(ids.tolist(), used.tolist(), strict=True):
            if window not in placed:
                placed[window] = held.place(length)[:2]
            new.append(placed[window][0])
            shift.append(placed[window][1])
        # a merged sequence takes the id of the first window put in it, which no other has
        names: dict[int, int] = {}
        for window, n in zip(ids.tolist(), new, strict=True):
            names.setdefault(n, window)
        out = rows.drop_columns(["group"])
        out = out.set_column(out.schema.get_field_index("sequence_id"), "sequence_id", pa.array([names[n] for n in new], pa.int64()))
        return out.set_column(out.schema.get_field_index("offset"), "offset", pa.array(rows.column("offset").to_numpy() + np.asarray(shift, np.int64), pa.int64()))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = stored(slim.mapInArrow(online, _DDL), "packed")
    columns = [c for c in placed.columns if c not in ("open", "used", *([] if with_ids else ["ids"]))]
    left = placed.filter("open")
    groups = max(1, -(-left.filter("offset = 0").count() // MERGE))
    dealt = left.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
    merged = dealt.groupBy("group").applyInArrow(merge, _DDL)
    return placed.filter(~F.col("open")).select(*columns).unionByName(merged.select(*columns))


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
