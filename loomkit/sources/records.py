"""Reading records, predictions and logs from JSON lines and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.operators.densify import keep_one

#: Schemas as DDL. Captions may hold a string or a list of strings; they are read as text and parsed where used.
RECORD = (
    "id string, claim_text string, evidence_bundle array<struct<type:string,img_path:string,image_caption:string,table_caption:string,caption:string>>, "
    "sentence_label array<struct<sentence:string,types:array<string>>>"
)
#: The same with evidence as it stands, whatever its captions are: read them with variant_caption().
VARIANT_RECORD = "id string, claim_text string, evidence_bundle variant, sentence_label array<struct<sentence:string,types:array<string>>>"
PREDICTION = "id string, sent_index int, label string, raw string, logprob double, min_logprob double, sum_logprob double, n_tokens int, parsed_ok boolean"
SUBMISSION = "id string, labels array<string>"
ATTEMPT = "record_id string, sent_idx int, k int, try int, attempt int, status string, raw string, ts double, dur_s double"


def scan(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines; blank lines are skipped, a broken line fails (FAILFAST) or goes (DROPMALFORMED)."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def evidence_items(records: DataFrame, *keep: str) -> DataFrame:
    """(keep, place, item): every evidence item of VARIANT_RECORD rows as a variant; rows without a list of evidence give none."""
    return records.select(*keep, F.posexplode(F.try_variant_get("evidence_bundle", "$", "array<variant>")).alias("place", "item"))


def caption_shapes(items: DataFrame, field: str) -> DataFrame:
    """(shape, n): what kinds of value the items hold in a caption field, null for none, and how many do."""
    return items.groupBy(F.schema_of_variant(F.try_variant_get("item", f"$.{field}", "variant")).alias("shape")).agg(F.count("*").alias("n"))


def scan_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that may have broken lines or not exist yet."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) is None:
        return spark.createDataFrame([], schema)
    return scan(spark, path, schema, "DROPMALFORMED")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of text files with its number from 0, in file order.

    A part's lines are read one after the other, so their numbers within it are distances from its first one, and the
    parts' offsets are added; lines are neither shuffled nor sorted, and no task holds a whole file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m"), "value")
    parts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("_m").alias("_f"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("file", "block", (before - F.col("_f")).alias("_b"))  # a row for each part, which the scan lists on the driver as well
    return raw.join(F.broadcast(offsets), ["file", "block"]).select("file", (F.col("_m") + F.col("_b")).alias("line"), "value")


def scan_strict(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with file and line, broken lines with file and line) of JSON lines."""
    schema = T.StructType.fromDDL(schema)
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    read = F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("file", "line", "value", F.explode(F.array(read)).alias("_r"))  # as rows, a line is parsed once, not for each field
    good = parsed.filter(F.col("_r._corrupt").isNull()).select("file", "line", *[F.col(f"_r.{f.name}") for f in schema.fields])
    return good, parsed.filter(F.col("_r._corrupt").isNotNull()).select("file", "line", "value")


def with_ids(records: DataFrame, ordinal: str = "line", form: str = "track1-%06d") -> DataFrame:
    """records with an id everywhere: their own, or one made from the 0-based ordinal where it is null or empty."""
    return records.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.format_string(form, F.col(ordinal))))


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def last_of(df: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """The last row of each key, as a map filled in file order would hold."""
    return keep_one(df, keys, [order], last=True)


def renamed(member: Column, names: dict[str, str]) -> Column:
    """Members by the names that `names` gives them, others by their own."""
    return F.coalesce(*[F.when(member == k, F.lit(v)) for k, v in names.items()], member)


def members(spark: SparkSession, glob: str, schema: str, names: dict[str, str] | None = None, stem: str = r"([^/]+?)(\.[^./]*)?$") -> DataFrame:
    """Files of many members with the column member, the file's stem or the name that `names` gives it.

    stem: a pattern of paths whose first group is the member; with another one a member may have many files.
    """
    member = F.regexp_extract(F.col("_metadata.file_path"), stem, 1)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(glob).select(renamed(member, names or {}).alias("member"), "*")


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def split_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, split) of a file that holds one JSON object {id: split}."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "split"))


def sentences(records: DataFrame, default: str | None = None) -> DataFrame:
    """(id, sent_index, sentence, types) of records; empty types become [default] if one is given."""
    out = records.select("id", F.posexplode("sentence_label").alias("sent_index", "s")).select("id", "sent_index", F.coalesce("s.sentence", F.lit("")).alias("sentence"), F.coalesce("s.types", F.array().cast("array<string>")).alias("types"))
    return out if default is None else out.withColumn("types", F.when(F.size("types") == 0, F.array(F.lit(default))).otherwise(F.col("types")))


def per_target(rows: DataFrame, fallback: Column) -> DataFrame:
    """A row for each distinct gold label in order; rows without labels take the fallback."""
    targets = F.when(F.size("types") > 0, F.array_distinct("types")).otherwise(F.array(fallback))
    return rows.select("*", F.posexplode(targets).alias("target_index", "target"))


def evaluation_records(records: DataFrame, splits: DataFrame, side: str) -> DataFrame:
    """Records of a side: id, claim_text, evidence_bundle, sentences."""
    chosen = records.join(splits.filter(F.col("split") == side).select("id"), "id", "left_semi")
    return chosen.select("id", "claim_text", "evidence_bundle", F.transform("sentence_label", lambda s: F.coalesce(s["sentence"], F.lit(""))).alias("sentences"))
