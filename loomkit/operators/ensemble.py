"""Unions, gates, vetoes and trims of many members' predictions in long form (member, id, sent_index, label, conf)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.config import LabelSet
from loomkit.operators.split import running_total, spread_order

CELL = ["id", "sent_index"]


def tally(preds: DataFrame, labels: LabelSet) -> DataFrame:
    """For each cell the number of members that fire each minority label: columns v0, v1 ... in the set's order."""
    counts = [F.count_if(F.col("label") == name).alias(f"v{i}") for i, name in enumerate(labels.minority)]
    return preds.groupBy(*CELL).agg(*counts)


def _best(scores: list[Column], passes: list[Column], names: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """The name with the largest score of those that pass; ties by order; null if none passes."""
    options = [F.when(ok, F.struct(s.alias("s"), F.lit(-order.index(n)).alias("o"), F.lit(n).alias("n"))) for s, ok, n in zip(scores, passes, names, strict=True)]
    return F.array_max(F.array(*options))["n"]


def pooled_union(cells: DataFrame, preds: DataFrame, labels: LabelSet, k: int = 1) -> DataFrame:
    """Cells where at least k members fire any minority label take the label with most votes, others the default."""
    if k < 1:
        raise ValueError("k must be at least 1")
    v = [F.col(f"v{i}") for i in range(len(labels.minority))]
    best = _best(v, [x > 0 for x in v], labels.minority, labels.pooled)
    joined = cells.select(*CELL).join(tally(preds, labels), CELL, "left")
    total = reduce(lambda a, b: a + b, v)
    return joined.select(*CELL, F.when(total >= k, best).otherwise(labels.default).alias("label"), F.coalesce(total, F.lit(0)).alias("votes"))


def _class_label(labels: LabelSet, thresholds: dict[str, int], default_k: int) -> Column:
    v = [F.col(f"v{i}") for i in range(len(labels.minority))]
    passes = [x >= max(1, thresholds.get(n, default_k)) for x, n in zip(v, labels.minority, strict=True)]
    return _best(v, passes, labels.minority, labels.by_class)


def class_union(cells: DataFrame, preds: DataFrame, labels: LabelSet, thresholds: dict[str, int], default_k: int = 1) -> DataFrame:
    """As pooled_union, but a label counts only with as many votes as its own threshold, 1 at least."""
    joined = cells.select(*CELL).join(tally(preds, labels), CELL, "left")
    return joined.select(*CELL, F.coalesce(_class_label(labels, thresholds, default_k), F.lit(labels.default)).alias("label"))


def asymmetric_union(cells: DataFrame, base: DataFrame, sources: DataFrame, labels: LabelSet, thresholds: dict[str, int], default_k: int = 1) -> DataFrame:
    """The base's minority labels stay; elsewhere the sources' class union. origin: kept, added or none."""
    joined = cells.select(*CELL).join(base.select(*CELL, F.col("label").alias("_base")), CELL, "left").join(tally(sources, labels), CELL, "left")
    added = _class_label(labels, thresholds, default_k)
    return _overlay(joined, added, labels)


def confident_union(cells: DataFrame, base: DataFrame, sources: DataFrame, labels: LabelSet, floors: dict[str, float]) -> DataFrame:
    """As asymmetric_union; a source fires only with a confidence of its label's floor at least.

    A label without a floor fires at any confidence, also without one; the most confident label is taken.
    """
    conf = F.coalesce(F.col("conf"), F.lit(float("-inf")))
    tops = [F.max(F.when((F.col("label") == n) & (conf >= floors.get(n, float("-inf"))), conf)).alias(f"c{i}") for i, n in enumerate(labels.minority)]
    fired = sources.groupBy(*CELL).agg(*tops)
    joined = cells.select(*CELL).join(base.select(*CELL, F.col("label").alias("_base")), CELL, "left").join(fired, CELL, "left")
    c = [F.col(f"c{i}") for i in range(len(labels.minority))]
    return _overlay(joined, _best(c, [x.isNotNull() for x in c], labels.minority, labels.by_class), labels)


def _overlay(joined: DataFrame, added: Column, labels: LabelSet) -> DataFrame:
    keeps = F.coalesce(F.col("_base") != labels.default, F.lit(False))
    label = F.when(keeps, F.col("_base")).otherwise(F.coalesce(added, F.lit(labels.default)))
    return joined.select(*CELL, label.alias("label"), F.when(keeps, "kept").when(added.isNotNull(), "added").otherwise("none").alias("origin"))


def overlay_counts(overlaid: DataFrame, labels: LabelSet) -> DataFrame:
    """Cells kept and added for each minority label that has any."""
    return overlaid.filter(F.col("label") != labels.default).groupBy("label").agg(F.count_if(F.col("origin") == "kept").alias("kept"), F.count_if(F.col("origin") == "added").alias("added"))


def support(preds: DataFrame, members: DataFrame) -> DataFrame:
    """preds with the number of members that give the same label in the cell."""
    agree = members.groupBy(*CELL, "label").agg(F.count("*").alias("support"))
    return preds.join(agree, [*CELL, "label"], "left").withColumn("support", F.coalesce("support", F.lit(0)))


def trim(preds: DataFrame, members: DataFrame, labels: LabelSet, most: dict[str, int]) -> DataFrame:
    """Labels of `most` that no more members support than it says become the default; flipped tells which."""
    limit = F.coalesce(*[F.when(F.col("label") == n, F.lit(k)) for n, k in most.items() if n != labels.default], F.lit(-1))
    flipped = F.col("support") <= limit
    return support(preds, members).select(*CELL, F.when(flipped, labels.default).otherwise(F.col("label")).alias("label"), F.col("label").alias("was"), "support", flipped.alias("flipped"))


def flips(trimmed: DataFrame, labels: LabelSet) -> DataFrame:
    """For each minority label of trim()'s rows: cells, and those that became the default."""
    return trimmed.filter(F.col("was") != labels.default).groupBy("was").agg(F.count("*").alias("n"), F.count_if("flipped").alias("flips"))


def union_added(union: DataFrame, members: DataFrame, labels: LabelSet) -> DataFrame:
    """For each minority label of a union: cells, and those where members disagreed."""
    kinds = members.groupBy(*CELL).agg(F.count_distinct("label").alias("_k"))
    by = union.filter(F.col("label") != labels.default).join(kinds, CELL).groupBy("label")
    return by.agg(F.count("*").alias("cells"), F.count_if(F.col("_k") > 1).alias("added"))


def veto_lone(preds: DataFrame, labels: LabelSet, gate: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Groups with one minority label alone lose it; with a gate only if its confidence is known and below the gate."""
    minority = F.col("label") != labels.default
    lone = F.count_if(minority).over(Window.partitionBy(*keys, "id")) == 1
    hit = lone & minority if gate is None else lone & minority & F.coalesce(F.col("conf") < gate, F.lit(False))
    return preds.withColumn("vetoed", hit).withColumn("label", F.when(F.col("vetoed"), labels.default).otherwise(F.col("label")))


def suppress(preds: DataFrame, labels: LabelSet, tau: Column | float) -> DataFrame:
    """Minority labels with a known confidence below tau become the default."""
    tau = F.lit(tau) if isinstance(tau, float) else tau
    weak = (F.col("label") != labels.default) & F.coalesce(F.col("conf") < tau, F.lit(False))
    return preds.withColumn("suppressed", weak).withColumn("label", F.when(F.col("suppressed"), labels.default).otherwise(F.col("label")))


def confidence_percentiles(preds: DataFrame, labels: LabelSet, store, percents: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """(percent, tau): the minority confidences at those ranks, nearest rank, halves to even."""
    values = preds.filter((F.col("label") != labels.default) & F.col("conf").isNotNull()).groupBy("conf").agg(F.count("*").alias("n"))
    values = store(values, "values")
    summed = running_total(values, spread_order(values, "conf"), F.col("n"), store, ties=("conf",))
    places = F.array(*[F.struct(F.lit(p).alias("percent"), F.bround(F.lit(p / 100.0).cast("double") * (F.col("total") - 1)).cast("long").alias("place")) for p in percents])
    at = summed.select("conf", "n", "before", F.inline(places))
    return at.filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))).select("percent", F.col("conf").alias("tau"))


def threshold_sweep(preds: DataFrame, labels: LabelSet, taus: DataFrame) -> DataFrame:
    """preds for each tau of a small table (name, tau), suppressed; and as they are under the name base."""
    base = preds.select(F.lit("base").alias("variant"), *preds.columns, F.lit(False).alias("suppressed"))
    each = preds.crossJoin(F.broadcast(taus.select(F.col("name").alias("variant"), F.col("tau").cast("double").alias("_tau"))))
    return base.unionByName(suppress(each, labels, F.col("_tau")).select("variant", *preds.columns, "suppressed"))


def blend(main: DataFrame, aux: DataFrame, weights: dict[str, float], regime: str = "regime", otherwise: float = 0.0) -> DataFrame:
    """The best label of main + W * aux for each cell; both hold (cell, label, p), W goes by main's regime column."""
    w = F.coalesce(*[F.when(F.col(regime) == k, F.lit(float(v))) for k, v in weights.items()], F.lit(otherwise))
    both = main.join(aux.select(*CELL, "label", F.col("p").alias("_q")), [*CELL, "label"], "left")
    scored = both.withColumn("_s", F.col("p") + w * F.coalesce("_q", F.lit(0.0)))
    return scored.groupBy(*CELL).agg(F.max_by("label", F.struct("_s", "label")).alias("label"))


def agreement(preds: DataFrame, anchor: DataFrame) -> DataFrame:
    """Share of the anchor's cells where each member gives its label."""
    both = preds.join(anchor.select(*CELL, F.col("label").alias("_a")), CELL)
    return both.groupBy("member").agg(F.avg((F.col("label") == F.col("_a")).cast("double")).alias("agreement"), F.count("*").alias("cells"))
