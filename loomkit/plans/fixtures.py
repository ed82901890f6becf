"""Labelled sentences, predictions and logs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkit.config import SENTENCES

_SUP, _UCM, _UE, _SO, _CON = SENTENCES.labels


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(x: Column, n: int) -> Column:
    return x % F.lit(n)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sent_index, l_partkey, l_suppkey, types): order lines as sentences of their order."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    place = F.row_number().over(Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")) - 1
    c = _remainder(F.col("l_partkey") * 31 + F.col("id") * 17 + F.col("sent_index") * 13, 100)
    types = (
        F.when(c < 86, F.array(F.lit(_SUP))).when(c < 90, F.array(F.lit(_SO))).when(c < 93, F.array(F.lit(_UE), F.lit(_SO)))
        .when(c < 96, F.array(F.lit(_UCM))).when(c < 98, F.array(F.lit(_CON))).otherwise(F.array(F.lit(_UE)))
    )
    return lines.withColumn("sent_index", place).select("id", "sent_index", "l_partkey", "l_suppkey", types.alias("types"))


def predictions(spark: SparkSession, sf_dir: str, members: int = 5) -> DataFrame:
    """(member, id, sent_index, label, conf): members that err in their own ways, with gaps."""
    s = sentences(spark, sf_dir).withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(members))))
    m, i, k = F.col("member"), F.col("id"), F.col("sent_index")
    e = _remainder(i * (m * 2 + 1) + k * 7 + m * 11, 20)
    q = _remainder(F.col("l_suppkey") + m, 4)
    label = F.when(e < 15, F.get("types", F.lit(0))).when(e < 18, _SUP).when(q == 0, _CON).when(q == 1, _SO).when(q == 2, _UCM).otherwise(_UE)
    r = _remainder(i + m * 37 + k * 3, 1000)
    conf = F.when(r < 950, -r / F.lit(1000.0).cast("double"))
    return s.filter(_remainder(i + m + k, 97) != 0).select("member", "id", "sent_index", label.alias("label"), conf.alias("conf"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("int").alias("n"))


def dirty_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions with seq, and rows that repeat a cell, miss the range, have no group or no known label; each prediction gives one to four."""
    i, k = F.col("id"), F.col("sent_index")
    row = lambda seq, id_, place, label: F.struct(id_.alias("id"), place.alias("sent_index"), label.alias("label"), F.lit(seq).alias("seq"))
    rows = F.array(
        row(0, i, k, F.when(_remainder(i, 107) == 0, "unknown").otherwise(F.col("label"))), F.when(_remainder(i + k, 89) == 0, row(1, i, k, F.lit(_CON))),
        F.when(_remainder(i, 101) == 0, row(2, i, k + 1000, F.col("label"))), F.when(_remainder(i, 103) == 0, row(3, -i, k, F.col("label"))),
    )
    made = predictions(spark, sf_dir).select("member", "conf", F.explode(rows).alias("r")).filter("r is not null")
    return made.select("member", "r.id", "r.sent_index", "r.label", "conf", "r.seq")


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, id, sent_index, raw, label, conf): labels wrapped in seven shapes of model output."""
    p = predictions(spark, sf_dir)
    json = F.concat(F.lit('{"label": "'), F.col("label"), F.lit('"}'))
    shape = _remainder(F.col("id"), 7)
    raw = (
        F.when(shape == 0, json).when(shape == 1, F.concat(F.lit("My answer: "), json)).when(shape == 2, F.lower("label"))
        .when(shape == 3, F.concat(F.lit("the answer is "), F.col("label"))).when(shape == 4, F.lit('{"label": "nonsense"}')).when(shape == 5, F.lit(""))
        .otherwise(F.concat(F.lit("<analysis>w w w</analysis>\n"), json))
    )
    return p.select("member", "id", "sent_index", raw.alias("raw"), "label", "conf")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, status, seq, ts): events as an attempt log."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "api_error").when(F.col("event_type") == "view", "misaligned").when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "purchase", "cannot_justify").otherwise("gave_up")
    return e.select(F.col("user_id").alias("task"), status.alias("status"), F.col("event_id").alias("seq"), "ts")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key): documents and their distinct lines of 20 characters and more."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    return d.select("id", F.trim("line").alias("key")).filter(F.length("key") >= 20).distinct()
