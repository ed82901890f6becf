"""Structured Streaming over append-only attempt logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegralType

from loomkit.config import LabelSet
from loomkit.functions.normalize import single_label

CELL = ["member", "id", "sent_index"]
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch's changes are files that a restart copies, not entries that it puts again one by one
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    # else every put and removal reads its key once more, only to count keys
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def normalized(raw: DataFrame, labels: LabelSet) -> DataFrame:
    """Raw outputs (member, id, sent_index, seq, raw, others) as predictions; works on streams and tables alike."""
    return raw.withColumn("_l", single_label(F.col("raw"), labels)).withColumns({"label": F.col("_l.label"), "parsed_ok": F.col("_l.parsed_ok")}).drop("raw", "_l")


def _least(df: DataFrame, keys: list, names: list[str], deal: list[str] | None = None) -> DataFrame:
    """Of each group of keys the row of least seq, null first; names: the labels there are; deal: keys by which rows are dealt first.

    Labels go by their hashes: columns of fixed width are aggregated by hash, others sorted.
    """
    whole = isinstance(df.schema["seq"].dataType, IntegralType)
    order = F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))) if whole else F.struct("seq")
    others = [c for c in df.columns if c not in (*CELL, "_ts")]
    rows = df.withColumn("label", F.xxhash64("label"))
    out = (rows.repartition(*deal) if deal else rows).groupBy(*keys).agg(*[F.min_by(c, order).alias(f"_{i}") for i, c in enumerate(others)])
    held = {c: F.col(f"_{i}") for i, c in enumerate(others)}
    held["label"] = F.coalesce(*[F.when(held["label"] == F.xxhash64(F.lit(x)), x) for x in names], F.lit(None).cast("string"))
    return out.select(*CELL, *[held[c].alias(c) for c in others])


def ingest(raw: DataFrame, labels: LabelSet, path: str, checkpoint: str, available_now: bool = True, ts: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Streams raw outputs into the table at path, of which outputs() gives the row of least seq of each (member, id, sent_index).

    Rows may come in any order and repeat: a batch appends its rows without a shuffle and without reading the table, and
    outputs() merges the batches, so the work of a batch is that of its own rows however long the table is. Each batch
    writes under a directory of its number, so a repeated batch writes the same rows to the same place.

    With a time column `ts` repeats don't come to the table: the stream's state keeps the least seq of each cell within each
    `late` of time, gives a cell out again with rows of it, and forgets it when the watermark has passed. Rows later
    than the watermark are dropped, and late_rows() counts them. That state lies in RocksDB, on the executors' disks. It knows labels
    by their hashes, so a label that is dropped from the set between two runs becomes null in cells given out again.
    """
    rows = normalized(raw, labels)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    if ts is not None:
        names = list(dict.fromkeys([*labels.labels, labels.default]))
        rows = _least(rows.withColumn("_ts", F.col(ts)).withWatermark("_ts", late), [F.window("_ts", late).alias("_w"), *CELL], names)
    writer = rows.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
    conf = raw.sparkSession.conf
    before = {k: conf.get(k, None) for k in _STATE}
    try:  # a query keeps the settings that it starts with
        for k, v in _STATE.items():
            conf.set(k, v)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """The table that ingest() keeps: of each cell the row of least seq.

    Rows are dealt by id before any are held: a small file of the table has millions, of which hardly two share a cell.
    """
    table = spark.read.parquet(path).drop("batch")
    names = [r.label for r in table.select("label").distinct().collect()]  # of a label set
    return _least(table, CELL, names, deal=["id"])


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream's states have dropped because the watermark had passed them, in the batches that Spark remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def rolling_mix(stream: DataFrame, labels: LabelSet, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """For each window and member the number of rows, of minority labels, and of each label."""
    counts = [F.count_if(F.col("label") == x).alias(f"n{i}") for i, x in enumerate(labels.labels)]
    by = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "member")
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("label") != labels.default).alias("minority"), *counts).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "member", "n", "minority", *[f"n{i}" for i in range(len(labels.labels))])
