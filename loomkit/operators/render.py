"""Training corpora in messages form. Texts around the data are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.labels import captions
from loomkit.functions.normalize import fitted, sanitized


@dataclass(frozen=True)
class Template:
    """Texts around the data. The headings, which prompts must share with those that models were trained on."""

    system: str = "You check claims against evidence."
    definitions: str = "Labels and their meaning."
    claim: str = "Claim paragraph:\n"
    target: str = "TARGET sentence to classify:\n"
    sentences: str = "Sentences to classify (output exactly one label per sentence, in order):\n"
    candidates: str = "Sentences with candidate labels:\n"
    image: str = "<image>"
    root: str = ""


def evidence_block(evidence: Column, template: Template) -> Column:
    """Lines for each item: kind, number, a mark for its image, and its caption if there is one."""
    def item(e: Column, i: Column) -> Column:
        head = F.concat(F.lit("["), F.upper(F.coalesce(e["type"], F.lit("image"))), F.lit(" "), (i + 1).cast("string"), F.lit("]"))
        mark = F.when(F.coalesce(e["img_path"], F.lit("")) != "", F.concat(F.lit(" "), F.lit(template.image))).otherwise("")
        text = captions(e, "image_caption", "table_caption")
        return F.concat(head, mark, F.when(text != "", F.concat(F.lit("\nCaption: "), text)).otherwise(""))

    return F.array_join(F.concat(F.array(F.lit("Evidence:")), F.transform(F.coalesce(evidence, F.array().cast(_EVIDENCE)), item)), "\n")


_EVIDENCE = "array<struct<type:string,img_path:string,image_caption:string,table_caption:string>>"


def images(evidence: Column, template: Template) -> Column:
    paths = F.transform(F.filter(evidence, lambda e: F.coalesce(e["img_path"], F.lit("")) != ""), lambda e: F.concat(F.lit(template.root), e["img_path"]))
    return F.when(F.size(paths) > 0, paths)


def label_json(label: Column) -> Column:
    """{"label": "..."} with a space after the colon."""
    return F.concat(F.lit('{"label": '), F.regexp_replace(F.to_json(F.array(label)), r"^\[|\]$", ""), F.lit("}"))


def _messages(user: Column, assistant: Column | None, template: Template) -> Column:
    turns = [("system", F.lit(template.system)), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def _user(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *[x for p in parts for x in (p, F.lit(""))][:-1])


def sentence_corpus(samples: DataFrame, template: Template, rationale: str | None = None) -> DataFrame:
    """(channel, sent_index, messages, images) from channel, sent_index, claim_text, sentence, label, evidence."""
    user = _user([F.lit(template.definitions), evidence_block(F.col("evidence"), template), F.concat(F.lit(template.claim), "claim_text"), F.concat(F.lit(template.target), "sentence")])
    answer = label_json(F.col("label"))
    if rationale:
        answer = F.when(F.col(rationale).isNotNull(), F.concat(F.lit("<analysis>"), sanitized(F.col(rationale)), F.lit("</analysis>\n"), answer)).otherwise(answer)
    return samples.select("channel", "sent_index", _messages(user, answer, template).alias("messages"), images(F.col("evidence"), template).alias("images"))


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(s, F.lit("")))), "\n")


def group_corpus(records: DataFrame, template: Template) -> DataFrame:
    """(channel, messages, images): one sample for each record; records: id, claim_text, sentences, labels, evidence."""
    user = _user([F.lit(template.definitions), evidence_block(F.col("evidence"), template), F.concat(F.lit(template.claim), "claim_text"), F.concat(F.lit(template.sentences), _numbered(F.col("sentences")))])
    quoted = F.transform("labels", lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
    answer = F.concat(F.lit('{"labels": ['), F.array_join(quoted, ", "), F.lit("]}"))
    return records.select(F.col("id").alias("channel"), _messages(user, answer, template).alias("messages"), images(F.col("evidence"), template).alias("images"))


def corrector_corpus(records: DataFrame, template: Template, default: str) -> DataFrame:
    """As group_corpus, each sentence tagged with its candidate label (column candidates, fitted to the sentences)."""
    tagged = F.zip_with("sentences", fitted(F.coalesce("candidates", F.array().cast("array<string>")), F.size("sentences"), default), lambda s, c: F.concat(F.coalesce(s, F.lit("")), F.lit(" [candidate: "), c, F.lit("]")))
    return group_corpus(records.withColumn("sentences", tagged), template)


def prompts_only(corpus: DataFrame, gold: Column) -> DataFrame:
    """The corpus without assistant turns, with gold; samples with fewer than three messages or without gold go."""
    kept = corpus.withColumn("gold", gold).filter((F.size("messages") >= 3) & F.col("gold").isNotNull())
    return kept.withColumn("messages", F.filter("messages", lambda m: m["role"] != "assistant"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from rows (conv_id, turn, role, text), in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def enrich_captions(records: DataFrame, cache: DataFrame, tag: str = "[OCR] ") -> DataFrame:
    """records (id, evidence) with the cache's texts (img_path, text) appended to items' captions, and `changed`.

    The image caption takes it if the item is an image or has that field, else the table caption. Captions are
    arrays of strings. Items keep their order and further fields; empty texts change nothing, nor do records without items.
    """
    items = records.select("id", F.posexplode("evidence").alias("pos", "e")).withColumn("img_path", F.col("e.img_path"))
    texts = cache.filter(F.trim("text") != "").dropDuplicates(["img_path"])
    met = items.join(texts, "img_path", "left")
    extra = F.array(F.concat(F.lit(tag), F.col("text")))
    to_image = (F.coalesce(F.col("e.type"), F.lit("image")) == "image") | F.col("e.image_caption").isNotNull()
    grown = lambda name, here: F.when(F.col("text").isNotNull() & here, F.concat(F.coalesce(F.col(f"e.{name}"), F.array().cast("array<string>")), extra)).otherwise(F.col(f"e.{name}")).alias(name)
    item = F.col("e").withField("image_caption", grown("image_caption", to_image)).withField("table_caption", grown("table_caption", ~to_image))
    by = met.select("id", "pos", item.alias("e"), F.col("text").isNotNull().alias("hit")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("_e"), F.count_if("hit").alias("changed"))
    rebuilt = by.select("id", F.transform("_e", lambda x: x["e"]).alias("_new"), "changed")
    both = records.join(rebuilt, "id", "left")
    return both.withColumns({"evidence": F.coalesce("_new", "evidence"), "changed": F.coalesce("changed", F.lit(0))}).drop("_new")


def attach_rationales(rows: DataFrame, units: DataFrame, side: str = "train") -> DataFrame:
    """rows (id, sent_index, split) with the array `rationales` of their units, on one side of the split only."""
    by = units.groupBy(F.col("record_id").alias("id"), F.col("sent_idx").alias("sent_index")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rationale"))), lambda x: x["rationale"]).alias("_r"))
    return rows.join(by, ["id", "sent_index"], "left").withColumn("rationales", F.when(F.col("split") == side, F.col("_r"))).drop("_r")


def gold_export(records: DataFrame, splits: DataFrame, side: str = "dev") -> DataFrame:
    """Records of one side with their ids and gold labels."""
    return records.join(splits.filter(F.col("split") == side).select("id"), "id", "left_semi").select("id", "claim_text", "evidence_bundle", "sentence_label")


def without_private(df: DataFrame, mark: str = "_") -> DataFrame:
    """df without its bookkeeping columns, whose names begin with `mark`."""
    return df.drop(*[c for c in df.columns if c.startswith(mark)])


def few_images(corpus: DataFrame, most: int = 2) -> DataFrame:
    """Samples with no more images than that."""
    return corpus.filter(F.coalesce(F.size("images"), F.lit(0)) <= most)
