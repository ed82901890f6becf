"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.sources.store import shared_folder, stored

__all__ = ["SEPARATORS", "filesystem", "local_path", "mix", "numbered_columns", "others", "shared_folder", "stored", "table", "text_bytes"]

#: A word is a run of anything but these six ASCII characters.
SEPARATORS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or of a plain path; None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or plain path; Hadoop's names of S3 are known."""
    from pyarrow import fs

    local, uri = local_path(uri), _S3.sub("s3://", uri)
    return (fs.LocalFileSystem(), os.path.abspath(local)) if local is not None else fs.FileSystem.from_uri(uri)


_S3 = re.compile(r"^s3[an]://")


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df, but for those named like the given ones, in any case."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]


def numbered_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns under the names _0, _1 and so on, which Python functions over batches take whatever theirs are."""
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"_{k}") for k, c in enumerate(columns)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array, joined, and its n + 1 offsets into them; null counts as empty."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
