"""Curation of generated rationales kept in append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.functions.normalize import acceptance, clean_rationale, n_words, unit_key, verdict_split
from loomkit.operators.densify import keep_one


def todo(work: DataFrame, log: DataFrame, keys: list[str], terminal: list[str]) -> DataFrame:
    """Work without a row of terminal status in the log."""
    return work.join(log.filter(F.col("status").isin(*terminal)).select(*keys).distinct(), keys, "left_anti")


def throughput(log: DataFrame, ts: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per minute between first and last time (seconds); null for one row or no span."""
    span = (F.max(ts) - F.min(ts)).alias("_s")
    by = log.groupBy(*keys).agg(F.count("*").alias("n"), span)
    return by.select(*keys, "n", F.when((F.col("n") >= 2) & (F.col("_s") > 0), F.col("n") / (F.col("_s") / 60.0)).alias("per_minute"))


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, entry): entries `i) ...` with lines that follow, up to FINAL; (key only rows that aren't aligned go).

    A row is kept if its indices are 1..n without repeats and FINAL names n labels by |||.
    """
    blank = r"[ \t\x0B\f\r]*"
    parts = F.split(F.col(text), rf"(?imd)^{blank}FINAL{blank}:", 2)
    line = F.concat(F.lit(":"), F.substring_index(F.get("parts", F.lit(1)), "\n", 1))
    rows = texts.select(key, parts.alias("parts")).filter(F.size("parts") > 1)
    rows = rows.select(key, F.concat(F.lit("\n"), F.get("parts", F.lit(0))).alias("body"), F.split(F.regexp_extract(line, r":(.*)$", 1), r"\|\|\|").alias("final"))
    index = F.regexp_extract_all("body", F.lit(rf"(?md)^{blank}(\d+)\)"), F.lit(1)).cast("array<int>")
    aligned = rows.filter((F.size("final") > 1) & (F.sort_array(index) == F.sequence(F.lit(1), F.size("final"))))
    # before the first number stands what belongs to no entry
    out = aligned.select(key, "final", F.posexplode(F.split("body", rf"(?md)^(?={blank}\d+\))")).alias("_p", "e")).filter("_p > 0")
    out = out.select(key, "final", "e", F.regexp_extract("e", rf"^{blank}(\d+)\)", 1).cast("int").alias("index"))
    entry = F.rtrim(F.regexp_replace(F.regexp_replace("e", rf"^{blank}\d+\){blank}", ""), r" *(?:\r?\n *)+", " "))
    return out.select(key, "index", entry.alias("entry"), F.trim(F.get("final", F.col("index") - 1)).alias("final"))


def judged_entries(entries: DataFrame, labels, default_verdict: Column) -> DataFrame:
    """entries (entry, target_label, gold_types, ...) with verdict, rationale, words, reason, hits and accepted."""
    cut = entries.withColumn("_v", verdict_split(F.col("entry")))
    cut = cut.withColumns({"verdict": F.coalesce(F.col("_v.verdict"), default_verdict), "rationale": clean_rationale(F.col("_v.rationale"), labels)})
    cut = cut.withColumn("n_words", n_words(F.col("rationale"))).withColumn("reason", acceptance(F.col("verdict"), F.col("target_label"), F.col("n_words")))
    return cut.drop("_v").withColumns({"accepted": F.col("reason").isNull(), "hit_target": F.col("verdict") == F.col("target_label"), "hit_anyof": F.array_contains("gold_types", F.col("verdict"))})


def build_units(accepted: DataFrame, sentences: DataFrame) -> DataFrame:
    """Units of accepted rows that have a sentence (record_id, sent_idx), once for each unit key, the first by seq."""
    keyed = accepted.join(sentences, ["record_id", "sent_idx"]).withColumn("unit_key", unit_key(F.col("record_id"), F.col("sent_idx"), F.col("source"), F.col("rationale")))
    return keep_one(keyed, ["unit_key"], ["seq"])


def consistent_units(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Units whose target is still the sentence's target, equal texts of a sentence once."""
    now = targets.select("record_id", "sent_idx", F.col("target_label").alias("_now"))
    same = units.join(now, ["record_id", "sent_idx"]).filter(F.col("target_label") == F.col("_now")).drop("_now")
    return keep_one(same, ["record_id", "sent_idx", "rationale"], ["seq"])


def merge_audit(units: DataFrame, audit: DataFrame) -> DataFrame:
    """units with verified and outcome by their last final mark; dropped ones stay with outcome dropped.

    audit: unit_key, seq, phase, outcome (pass, rewritten, dropped), note, new_rationale. Without a mark a unit is
    kept unverified; a rewritten one takes its new text.
    """
    final = keep_one(audit.filter("phase = 'final'"), ["unit_key"], ["seq"], last=True)
    out = units.join(final.select("unit_key", "outcome", "note", "new_rationale"), "unit_key", "left")
    return out.withColumns({
        "rationale": F.when(F.col("outcome") == "rewritten", F.coalesce("new_rationale", "rationale")).otherwise(F.col("rationale")),
        "verified": F.coalesce(F.col("outcome").isin("pass", "rewritten"), F.lit(False)), "outcome": F.coalesce("outcome", F.lit("unverified")),
    }).drop("new_rationale")


def label_only(sentences: DataFrame, merged: DataFrame, log: DataFrame) -> DataFrame:
    """Sentences without a surviving unit, with the reason: a drop note, cannot_justify, gave_up or no_unit."""
    keys = ["record_id", "sent_idx"]
    rest = sentences.join(merged.filter("outcome <> 'dropped'").select(*keys).distinct(), keys, "left_anti")
    notes = merged.filter("outcome = 'dropped'").groupBy(*keys).agg(F.max(F.coalesce("note", F.lit("dropped"))).alias("_note"))
    marks = log.groupBy(*keys).agg(F.bool_or(F.col("status") == "cannot_justify").alias("_c"), F.bool_or(F.col("status") == "gave_up").alias("_g"))
    reason = F.coalesce(F.col("_note"), F.when(F.col("_c"), "cannot_justify"), F.when(F.col("_g"), "gave_up"), F.lit("no_unit"))
    return rest.join(notes, keys, "left").join(marks, keys, "left").withColumn("reason", reason).drop("_note", "_c", "_g")


def coverage(units: DataFrame, sentences: DataFrame) -> DataFrame:
    """For each target label: sentences, covered ones, those with many rationales, mean words."""
    keys = ["record_id", "sent_idx"]
    per = units.groupBy(*keys).agg(F.count("*").alias("k"), F.avg(n_words(F.col("rationale"))).alias("w"))
    return sentences.join(per, keys, "left").groupBy("target_label").agg(F.count("*").alias("sentences"), F.count("k").alias("covered"), F.count_if(F.col("k") > 1).alias("many"), F.avg("w").alias("mean_words"))


def status_counts(log: DataFrame, keys: tuple[str, ...] = ("status",)) -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("n"))


def last_terminal(log: DataFrame, keys: list[str], terminal: list[str], order: str) -> DataFrame:
    """The last terminal status of each task."""
    return log.filter(F.col("status").isin(*terminal)).groupBy(*keys).agg(F.max_by("status", order).alias("status"))


def first_verdicts(audit: DataFrame, units: DataFrame) -> DataFrame:
    """For each target label the units verified and the share that passed at the first try."""
    first = audit.filter("phase = 'verify'").groupBy("unit_key").agg(F.min_by("verdict", "seq").alias("verdict"))
    by = units.join(first, "unit_key").groupBy("target_label")
    return by.agg(F.count("*").alias("verified"), F.avg((F.col("verdict") == "PASS").cast("double")).alias("passed"))


def acceptance_by_class(judged: DataFrame) -> DataFrame:
    """For each target label: entries, accepted ones, and those that hit the target or any gold label."""
    counts = [F.count_if(F.col(c)).alias(c) for c in ("accepted", "hit_target", "hit_anyof")]
    return judged.groupBy("target_label").agg(F.count("*").alias("entries"), *counts)
