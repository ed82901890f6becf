"""Corpus pipeline: quality rules, near-duplicates, repeated passages, packing; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkit.llm import near, packing, quality, repeats
from loomkit.llm.common import stored
from loomkit.llm.tokens import public_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule passes; null and empty texts fail, rows that repeat each have their own verdict, columns beyond the documents' go."""
    return quality.passing(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; rows without doc_id as near.py says."""
    kept = near.near_duplicates(docs, with_own=True).filter("kept").select(F.col("doc_id").alias("_id"), F.col("own").alias("_own"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (near.row_key() == F.col("_own")), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier; characters cut in two go whole, and documents of which nothing is left, or that had no text. Of rows repeated whole the first keeps its text; rows without doc_id come first."""
    out = repeats.remove_repeats(docs.select(*COLUMNS), with_text=True)
    return out.filter(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids, with their ids; a null or empty text is its end id alone, rows that repeat are packed each."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", pack_tokens)]
#: A tokenizer and whole-corpus grouping are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
