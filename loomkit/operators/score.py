"""Scores: any-of credit, macro-F1, whole-group match, confusion and error reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomkit.config import LabelSet
from loomkit.operators.densify import place, spread

CELL = ["id", "sent_index"]


def credited(gold: DataFrame, preds: DataFrame, labels: LabelSet, missing: bool = False) -> DataFrame:
    """gold (id, sent_index, types) with label, hit and y_true (the label if hit, else the first gold label).

    An unknown label counts as the default; cells without a prediction are left out, or default if `missing` is set.
    """
    return _with_hits(gold.join(preds, CELL, "left" if missing else "inner"), labels)


def _with_hits(joined: DataFrame, labels: LabelSet) -> DataFrame:
    label = F.when(F.col("label").isin(*labels.labels), F.col("label")).otherwise(labels.default)
    out = joined.withColumn("label", label).withColumn("hit", F.array_contains("types", F.col("label")))
    return out.withColumn("y_true", F.when(F.col("hit"), F.col("label")).otherwise(F.get("types", F.lit(0))))


#: The bit of a gold mask that says that the list of labels, or one in it, is null.
UNKNOWN = 62


def masked(gold: DataFrame, labels: LabelSet) -> DataFrame:
    """(id, sent_index, mask, lead): gold's labels as bits by their place in the set, and the first one's place (-1: none of the set)."""
    holds = sum((F.when(F.array_contains("types", name), F.lit(1 << i)).otherwise(0) for i, name in enumerate(labels.labels)), F.lit(0)).cast("long")
    mask = F.when(F.col("types").isNull() | F.exists("types", lambda t: t.isNull()), holds.bitwiseOR(F.lit(1 << UNKNOWN))).otherwise(holds)
    head = F.get("types", F.lit(0))
    return gold.select(*CELL, mask.alias("mask"), F.when(head.isNotNull(), place(head, labels)).alias("lead"))


def credited_members(gold: DataFrame, raw: DataFrame, labels: LabelSet, members: list, order: str = "seq", missing: bool = True) -> DataFrame:
    """(member, id, sent_index, label, hit, y_true): gold credited with each member's assembled labels, which are places in the set.

    The same as credited() after assemble(), with one shuffle of raw; report() and per_label() take either. Cells without a
    row count as default, or are left out if `missing` isn't set.
    """
    rows = spread(raw, masked(gold, labels), labels, members, order, ("mask", "lead"))
    rows = rows if missing else rows.filter(F.col("place").isNotNull())
    rows = rows.withColumn("label", F.when(F.col("place") >= 0, F.col("place")).otherwise(labels.labels.index(labels.default)))
    found, unknown = F.getbit("mask", "label") == 1, F.getbit("mask", F.lit(UNKNOWN)) == 1
    rows = rows.withColumn("hit", F.when(found, True).when(unknown, None).otherwise(False))
    return rows.select("member", *CELL, "label", "hit", F.when(F.col("hit"), F.col("label")).otherwise(F.col("lead")).alias("y_true"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0).cast("double"))


def _counts(labels: LabelSet, scored: DataFrame) -> dict[str, Column]:
    """tp, fp and fn of each label, by its place in the set."""
    out, places = {}, isinstance(scored.schema["label"].dataType, T.IntegerType)
    for i, name in enumerate(range(len(labels.labels)) if places else labels.labels):
        true, said = F.col("y_true") == name, F.col("label") == name
        out |= {f"tp{i}": F.count_if(true & said), f"fp{i}": F.count_if(~true & said), f"fn{i}": F.count_if(true & ~said)}
    return out


def per_label(scored: DataFrame, labels: LabelSet, keys: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, support and predicted of every label of the set, also of absent ones."""
    wide = scored.groupBy(*keys).agg(*[c.alias(name) for name, c in _counts(labels, scored).items()])
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, n in enumerate(labels.labels)])
    long = wide.select(*keys, F.inline(rows))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return long.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "support": tp + fn, "predicted": tp + fp})


def macro_f1(scored: DataFrame, labels: LabelSet, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and macro_f1 alone, without the groups' counts that report() needs."""
    return per_label(scored, labels, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def report(scored: DataFrame, labels: LabelSet, keys: tuple[str, ...] = ()) -> DataFrame:
    """macro_f1, pem (share of groups with all sentences hit), score, sentence_accuracy, num_samples, num_sentences.

    Groups are counted first, then added up, so scored is read once; if it lies by id already, only sums are shuffled.
    """
    counts = _counts(labels, scored)
    groups = scored.groupBy(*keys, "id").agg(F.every("hit").alias("all"), F.count("*").alias("n"), F.count_if("hit").alias("hits"), *[c.alias(name) for name, c in counts.items()])
    wide = groups.groupBy(*keys).agg(
        F.avg(F.col("all").cast("double")).alias("pem"), (F.sum("hits") / F.sum("n")).alias("sentence_accuracy"),
        F.count("*").alias("num_samples"), F.sum("n").alias("num_sentences"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts],
    )
    f1 = [_ratio(2 * F.col(f"tp{i}"), 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")) for i in range(len(labels.labels))]
    out = wide.withColumn("macro_f1", reduce(Column.__add__, f1) / len(f1))
    return out.select(*keys, ((F.col("macro_f1") + F.col("pem")) / 2).alias("score"), "macro_f1", "pem", "sentence_accuracy", "num_samples", "num_sentences")


def constant(gold: DataFrame, labels: LabelSet) -> DataFrame:
    """gold scored as if every label were the default."""
    return _with_hits(gold.withColumn("label", F.lit(labels.default)), labels)


def confusion(scored: DataFrame, labels: LabelSet, primary: Column) -> DataFrame:
    """Counts of (primary gold label, predicted label), one row for each gold label, a column for each predicted one."""
    counts = [F.count_if((F.col("_p") == g) & (F.col("label") == n)).alias(f"c{i}_{j}") for i, g in enumerate(labels.labels) for j, n in enumerate(labels.labels)]
    wide = scored.withColumn("_p", primary).agg(*counts)
    rows = F.array(*[F.struct(F.lit(g).alias("gold"), *[F.col(f"c{i}_{j}").alias(n) for j, n in enumerate(labels.labels)]) for i, g in enumerate(labels.labels)])
    return wide.select(F.inline(rows))


def diagnostic(scored: DataFrame, labels: LabelSet) -> DataFrame:
    """Precision and recall by the second rule: a miss of a label counts only where the prediction isn't gold either."""
    counts = []
    for i, name in enumerate(labels.labels):
        has, said = F.array_contains("types", name), F.col("label") == name
        counts += [F.count_if(has & said).alias(f"tp{i}"), F.count_if(~has & said).alias(f"fp{i}"), F.count_if(has & ~said & ~F.col("hit")).alias(f"fn{i}")]
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, n in enumerate(labels.labels)])
    return scored.agg(*counts).select(F.inline(rows)).withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def error_kind(labels: LabelSet) -> Column:
    """FALSE_ALARM, MISSED_MINORITY or WRONG_MINORITY for a row that isn't hit; null for a hit."""
    gold, said = F.get("types", F.lit(0)) == labels.default, F.col("label") == labels.default
    return F.when(F.col("hit"), None).when(gold & ~said, "FALSE_ALARM").when(~gold & said, "MISSED_MINORITY").when(~gold & ~said, "WRONG_MINORITY").otherwise("OTHER")


def errors(scored: DataFrame, labels: LabelSet, keys: tuple[str, ...] = ()) -> DataFrame:
    return scored.withColumn("kind", error_kind(labels)).filter("kind is not null").groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def recall_by(scored: DataFrame, labels: LabelSet, bucket: Column) -> DataFrame:
    """Minority-gold rows by bucket: support, misses, recall, and the bucket's share of all misses."""
    rows = scored.withColumn("bucket", bucket).filter(F.exists("types", lambda t: t != labels.default))
    by = rows.groupBy("bucket").agg(F.count("*").alias("support"), F.count_if(~F.col("hit")).alias("misses"))
    total = by.agg(F.sum("misses").alias("_all"))  # a row; buckets are few
    return by.crossJoin(F.broadcast(total)).select("bucket", "support", "misses", (1 - _ratio(F.col("misses"), F.col("support"))).alias("recall"), _ratio(F.col("misses"), F.col("_all")).alias("share"))


def label_counts(preds: DataFrame, labels: LabelSet, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of every label, 0 for absent ones."""
    wide = preds.groupBy(*keys).agg(*[F.count_if(F.col("label") == n).alias(f"n{i}") for i, n in enumerate(labels.labels)])
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"n{i}").alias("n")) for i, n in enumerate(labels.labels)])))


def soft_bottleneck(rows: DataFrame, loss: str, keys: list[str], beta: float) -> DataFrame:
    """For each group (log of the mean of exp(beta * loss)) / beta, in a form that doesn't overflow; the mean for beta 0."""
    if beta == 0:
        return rows.groupBy(*keys).agg(F.avg(loss).alias("s"))
    parts = rows.groupBy(*keys).agg(F.max(loss).alias("_m"), F.collect_list(loss).alias("_l"))
    size = F.size("_l")
    total = F.aggregate("_l", F.lit(0.0).cast("double"), lambda a, x: a + F.exp(beta * (x - F.col("_m"))))
    return parts.select(*keys, (F.col("_m") + F.log(total / size) / beta).alias("s"))


def blended_loss(rows: DataFrame, loss: str, keys: list[str], beta: float, weight: float) -> DataFrame:
    """(1 - weight) * mean loss + weight * mean of the groups' soft bottlenecks."""
    mean = rows.agg(F.avg(loss).alias("mean"))
    groups = soft_bottleneck(rows, loss, keys, beta).agg(F.avg("s").alias("bottleneck"))
    return mean.crossJoin(groups).select("mean", "bottleneck", ((1 - weight) * F.col("mean") + weight * F.col("bottleneck")).alias("loss"))


def masked_mean(tokens: Column, opener: str = "{") -> Column:
    """Mean loss of response tokens from the last one with the opener on (all of them without one); 0 if there are none.

    tokens: array<struct<tok, loss, is_resp>>.
    """
    at = F.array_max(F.transform(tokens, lambda t, i: F.when(t["is_resp"] & F.contains(t["tok"], F.lit(opener)), i).otherwise(0)))
    span = F.filter(tokens, lambda t, i: t["is_resp"] & (i >= at))
    return F.aggregate(span, F.lit(0.0).cast("double"), lambda a, t: a + t["loss"]) / F.greatest(F.size(span), F.lit(1))
