"""Token files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds documents in ascending doc_id order. Layout: data frames; a skippable frame with the index (for each
data frame: documents, ids, first and last doc_id); a skippable frame with the seek table of the public seekable
format (for each frame before it: compressed size, size, low 32 bits of the XXH64 of the content; then the number
of frames, a descriptor byte and the magic number). A data frame holds: number of documents, width of an id in
bytes (unsigned 32-bit each), doc_ids (signed 64-bit), numbers of ids (unsigned 32-bit), a byte for each document
that is 1 where its doc_id is null (then stored as the least signed 64-bit number), ids. All little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, shared_folder, stored
from .tokens import encoded

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(2**63)
FRAME_IDS = 1 << 17
#: Bytes of text for each file.
FILE_BYTES = 32 << 20
_ENTRY, _INDEX = struct.Struct("<III"), struct.Struct("<IQqq")


class FrameWriter:
    """Writes documents to an open binary file, frame by frame."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS, level: int = 1):
        import zstandard

        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.entries, self.index = [], []
        self.docs, self.nulls, self.sizes, self.parts, self.held = [], [], [], [], 0
        self.n_docs = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids))
        self.parts.append(ids.astype(f"<u{self.width}").tobytes())
        self.held += len(ids)
        if self.held >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.docs:
            return
        body = b"".join([struct.pack("<II", len(self.docs), self.width), np.asarray(self.docs, "<i8").tobytes(), np.asarray(self.sizes, "<u4").tobytes(), bytes(self.nulls), *self.parts])
        frame = self.press.compress(body)
        self.out.write(frame)
        self.entries.append((len(frame), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
        self.index.append((len(self.docs), self.held, self.docs[0], self.docs[-1]))
        self.n_docs += len(self.docs)
        self.n_ids += self.held
        self.docs, self.nulls, self.sizes, self.parts, self.held = [], [], [], [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(_INDEX.pack(*x) for x in self.index)
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        self.out.write(index)
        self.entries.append((len(index), 0, 0))
        seek = b"".join(_ENTRY.pack(*x) for x in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEK_END)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class FrameReader:
    """Reads such a file; only the frames asked for are fetched and decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - frames * 12, frames * 12)
        self.entries = list(_ENTRY.iter_unpack(table))
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        at, length = int(self.starts[frames - 1]), self.entries[-1][0]
        self.index = list(_INDEX.iter_unpack(self._at(at + 8, length - 8)))

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, k: int) -> tuple[list[int | None], list[np.ndarray]]:
        """(doc_ids, ids of each) of data frame k, after its checksum."""
        import xxhash
        import zstandard

        packed, size, check = self.entries[k]
        body = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        n, width = struct.unpack_from("<II", body)
        docs = np.frombuffer(body, "<i8", n, 8).tolist()
        sizes = np.frombuffer(body, "<u4", n, 8 + 8 * n)
        nulls = body[8 + 12 * n : 8 + 13 * n]
        ids = np.frombuffer(body, f"<u{width}", int(sizes.sum()), 8 + 13 * n)
        return [None if gone else d for d, gone in zip(docs, nulls, strict=True)], np.split(ids, np.cumsum(sizes)[:-1]) if n else []

    def documents(self, wanted: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of the wanted doc_ids, from the frames whose range holds one of them."""
        want = np.unique(np.asarray(wanted, np.int64))
        for k, (_, _, first, last) in enumerate(self.index):
            if np.searchsorted(want, last, "right") > np.searchsorted(want, first, "left"):
                docs, ids = self.frame(k)
                for doc_id, own in zip(docs, ids, strict=True):
                    if doc_id is not None and want[min(np.searchsorted(want, doc_id), len(want) - 1)] == doc_id:
                        yield doc_id, own


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Writes the ids of every text as token files in folder (by default a new shared one).

    docs: doc_id long, text string (null: empty; other columns are ignored). There is a file for each FILE_BYTES of
    text, and some for every core. Each document's ids are followed by end_id; files and documents in them ascend by doc_id, equal ids by text, null ids first. Returns the
    manifest: part int, path string, n_docs long, n_ids long, and first_id long, the ids in files before it.
    A task that runs twice writes two files; the manifest names one. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        out = writer = None
        for batch, ids in encoded(batches, tokenizer, end_id):
            if batch.num_rows and out is None:
                fs.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
                out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                writer = FrameWriter(out, width, frame_ids)
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                writer.add(doc_id, np.frombuffer(own, "<u4"))
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ordered.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, ids (binary, unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                at = row["first_id"]
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    for k in range(len(reader.index)):
                        docs, ids = reader.frame(k)
                        sizes = np.asarray([len(x) for x in ids], np.int64)
                        starts = at + np.cumsum(sizes) - sizes
                        at += int(sizes.sum())
                        raw = [x.astype("<u4").tobytes() for x in ids]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(docs, pa.int64()), "start": starts, "n_tokens": sizes,
                            "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()), "ids": pa.array(raw, pa.binary()),
                        })

    return manifest.repartition(max(1, manifest.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
