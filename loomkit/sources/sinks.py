"""Writing corpora, derived tables, split maps and the score ledger."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.config import LabelSet

_LOG = "log"


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in UTF-8, a file for each partition; null fields are left out."""
    df.write.mode("overwrite").json(path)


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become; nothing was changed."""


def replace_table(df: DataFrame, path: str, bad: DataFrame | None = None, base: int | None = None) -> int:
    """Writes df as the next version of the table at path and gives its number; raises, and changes nothing, if `bad` has a row.

    A version is a directory of files and an entry in the log, named by its number, that is only made if there is none.
    base: the version that df was made from (by default the latest as the call begins); if another writer has
    committed since, the call raises Conflict and removes its files, and the caller reads again. Old versions stay
    for those who read them, until vacuum(). A writer that dies leaves files that no entry names, for vacuum() too.
    """
    if bad is not None and not bad.isEmpty():
        raise ValueError("the table breaks its rules; nothing was written")
    spark = df.sparkSession
    number = 1 + (latest_version(spark, path) if base is None else base)
    name = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fs, where = _files(spark, path)
    fresh, entry = where(f"{path}/{_LOG}.{uuid.uuid4().hex}"), where(f"{path}/{_LOG}/{number:020d}")
    out = fs.create(fresh)
    out.write(name.encode())
    out.close()
    fs.mkdirs(where(f"{path}/{_LOG}"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    try:  # a rename that never goes over a file that is there
        if latest_version(spark, path) >= number:
            raise Conflict(f"version {number} of {path} has been written meanwhile")
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, entry, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except (Conflict, Py4JJavaError) as error:
        fs.delete(fresh, False)
        fs.delete(where(f"{path}/{name}"), True)
        if isinstance(error, Conflict) or "FileAlreadyExists" in str(error):
            raise Conflict(f"version {number} of {path} has been written meanwhile") from None
        raise
    return number


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the table's last version, 0 if there is none."""
    return max(_log(spark, path), default=0)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, by default the last; its files stay until vacuum(), whatever is committed meanwhile."""
    log = _log(spark, path)
    fs, where = _files(spark, path)
    number = max(log, default=0) if version is None else version
    if number not in log:
        raise ValueError(f"{path} has no version {number}")
    entry = fs.open(where(log[number][0]))
    try:
        name = bytes(entry.readAllBytes()).decode()
    finally:
        entry.close()
    return spark.read.parquet(f"{path}/{name}")


def vacuum(spark: SparkSession, path: str, seconds: float) -> int:
    """Deletes versions that were replaced more than `seconds` ago, and files of that age that no entry names; gives their number.

    `seconds` is the longest that a reader or a writer may take.
    """
    fs, where = _files(spark, path)
    log, before = _log(spark, path), (time.time() - seconds) * 1000
    if not log:
        return 0
    numbers = sorted(log)
    gone = [n for n, later in zip(numbers, numbers[1:], strict=False) if log[later][1] <= before]
    kept = set()
    for n in numbers:
        if n not in gone:
            entry = fs.open(where(log[n][0]))
            kept.add(bytes(entry.readAllBytes()).decode())
            entry.close()
    old = [f for f in fs.listStatus(where(path)) if f.getPath().getName() != _LOG and f.getPath().getName() not in kept]
    old = [f.getPath() for f in old if f.getModificationTime() <= before]
    for n in gone:
        fs.delete(where(log[n][0]), False)
    for f in old:
        fs.delete(f, True)
    return len(old)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path
    return where(path).getFileSystem(spark._jsc.hadoopConfiguration()), where


def _log(spark: SparkSession, path: str) -> dict[int, tuple[str, int]]:
    """The log's entries: (path, time of commit in milliseconds) by number."""
    fs, where = _files(spark, path)
    if not fs.exists(where(f"{path}/{_LOG}")):
        return {}
    found = [f for f in fs.listStatus(where(f"{path}/{_LOG}")) if f.getPath().getName().isdigit()]
    return {int(f.getPath().getName()): (f.getPath().toString(), f.getModificationTime()) for f in found}


def write_split_map(splits: DataFrame, path: str) -> None:
    """(id, split) as a table with a directory for each side."""
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def ledger_row(report: DataFrame, per_label: DataFrame, tag: str, labels: LabelSet) -> DataFrame:
    """One row: timestamp (UTC), tag, metrics with six decimals, and f1_<label> for every label of the set."""
    name = lambda x: "f1_" + x.lower().replace(" ", "_")
    f1 = per_label.agg(*[F.round(F.max(F.when(F.col("label") == x, F.col("f1"))), 6).alias(name(x)) for x in labels.labels])
    rounded = [F.round(c, 6).alias(c) for c in ("score", "macro_f1", "pem", "sentence_accuracy")]
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return report.select(now.alias("timestamp"), F.lit(tag).alias("tag"), *rounded, "num_samples", "num_sentences").crossJoin(f1)


def append_ledger(row: DataFrame, path: str) -> None:
    """Appends a ledger row; each file has a header."""
    row.write.mode("append").option("header", True).csv(path)
