"""Dense predictions: every sentence of the reference has one valid label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.config import LabelSet

CELL = ["id", "sent_index"]


def grid(sizes: DataFrame) -> DataFrame:
    """(id, sent_index) for each of n sentences; sizes: id, n. Groups without sentences give no cell."""
    return sizes.filter("n > 0").select("id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("sent_index"))


def keep_one(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by order."""
    by = [(F.desc_nulls_last(c) if last else F.asc_nulls_first(c)) for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def rejects(raw: DataFrame, sizes: DataFrame) -> DataFrame:
    """raw rows that can't be placed, with reason: unknown_id, or index_out_of_range (also below 0)."""
    joined = raw.join(sizes.select("id", "n"), "id", "left")
    reason = F.when(F.col("n").isNull(), "unknown_id").when((F.col("sent_index") < 0) | (F.col("sent_index") >= F.col("n")), "index_out_of_range")
    return joined.withColumn("reason", reason).filter("reason is not null").drop("n")


def assemble(raw: DataFrame, cells: DataFrame, labels: LabelSet, order: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """cells (id, sent_index) with label, conf and origin.

    raw: id, sent_index, label, conf and an order column; `keys` (as a member) may be prepended to both. Of rows for
    one cell the first counts; a label outside the set and a missing cell become the default, with origin
    invalid or missing. What has no cell is dropped; rejects() lists it.

    raw is dealt by id, which is among the keys of all that follows: the choice of the first, the joins with cells and
    gold, and groups need no further shuffle of rows.
    """
    on = [*keys, *CELL]
    first = keep_one(raw.repartition("id"), on, [order]).select(*on, F.col("label").alias("_label"), F.col("conf").cast("double").alias("conf"), F.lit(True).alias("_there"))
    out = cells.select(*on).join(first, on, "left")
    valid = F.coalesce(F.col("_label").isin(*labels.labels), F.lit(False))
    origin = F.when(F.col("_there").isNull(), "missing").when(~valid, "invalid").otherwise("given")
    return out.select(*on, F.when(valid, F.col("_label")).otherwise(labels.default).alias("label"), "conf", origin.alias("origin"))


def place(label: Column, labels: LabelSet) -> Column:
    """A label's place in the set, -1 for null and what isn't in it."""
    return F.coalesce(*[F.when(label == name, F.lit(i)) for i, name in enumerate(labels.labels)], F.lit(-1))


def spread(raw: DataFrame, cells: DataFrame, labels: LabelSet, members: list, order: str = "seq", carry: tuple[str, ...] = ()) -> DataFrame:
    """(member, id, sent_index, *carry, place, conf): every cell for each of the members, with the first raw row's label by its place in the set.

    place is -1 for a label outside the set and null for a missing row. raw: member, id, sent_index, label, conf and an
    order column of whole numbers, null first; cells: id, sent_index, each once, and numbers to carry. The same rows as assemble() gives,
    but raw and cells are dealt by id together and no rows are joined or sorted: a member's label is a column of its cell
    until the end. Members are few.
    """
    first = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    said = raw.filter(F.col("id").isNotNull() & F.col("sent_index").isNotNull()).select(*CELL, F.col("member").alias("_m"), first.alias("_o"), place(F.col("label"), labels).alias("_p"), F.col("conf").cast("double").alias("_c"))
    both = cells.select(*CELL, *carry, F.lit(1).alias("_cell")).unionByName(said, allowMissingColumns=True).repartition("id")
    kept = [F.max("_cell").alias("_cell"), *[F.max(c).alias(c) for c in carry]]
    for i, m in enumerate(members):
        own = F.when(F.col("_m") == m, F.col("_o"))
        kept += [F.min_by("_p", own).alias(f"_p{i}"), F.min_by("_c", own).alias(f"_c{i}")]
    kind = raw.schema["member"].dataType
    rows = F.array(*[F.struct(F.lit(m).cast(kind).alias("member"), F.col(f"_p{i}").alias("place"), F.col(f"_c{i}").alias("conf")) for i, m in enumerate(members)])
    return both.groupBy(*CELL).agg(*kept).filter("_cell = 1").select(*CELL, *carry, F.inline(rows)).select("member", *CELL, *carry, "place", "conf")


def named(spread: DataFrame, labels: LabelSet) -> DataFrame:
    """spread() rows as assemble() names them: label, conf and origin."""
    known = F.col("place") >= 0
    label = F.when(known, F.get(F.array(*[F.lit(x) for x in labels.labels]), F.col("place"))).otherwise(labels.default)
    origin = F.when(F.col("place").isNull(), "missing").when(~known, "invalid").otherwise("given")
    return spread.select(*[c for c in spread.columns if c not in ("place", "conf")], label.alias("label"), "conf", origin.alias("origin"))


def to_submission(dense: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each id: its labels in sentence order."""
    ordered = F.sort_array(F.collect_list(F.struct("sent_index", "label")))
    return dense.groupBy(*keys, "id").agg(F.transform(ordered, lambda x: x["label"]).alias("labels"))


def from_submission(df: DataFrame) -> DataFrame:
    """Long form of (id, labels)."""
    return df.select(*[c for c in df.columns if c != "labels"], F.posexplode("labels").alias("sent_index", "label"))


def suppress_uncertain(dense: DataFrame, labels: LabelSet, threshold: float) -> DataFrame:
    """Minority labels whose first-token confidence is null or below -threshold become the default.

    Nothing happens if the threshold isn't positive or no row has a confidence at all.
    """
    if threshold <= 0:
        return dense
    some = dense.agg((F.count("conf") > 0).alias("_some"))
    return dense.crossJoin(F.broadcast(some)).withColumn("label", F.when(F.col("_some") & _weak(labels, threshold), labels.default).otherwise(F.col("label"))).drop("_some")


def _weak(labels: LabelSet, threshold: float) -> Column:
    return (F.col("label") != labels.default) & (F.col("conf").isNull() | (-F.col("conf") > threshold))


def certain_counts(dense: DataFrame, labels: LabelSet, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, n): labels counted as suppress_uncertain() leaves them, in one pass; whether any row has a confidence is told from the counts."""
    counts = dense.groupBy(*keys, "label", (F.lit(threshold > 0) & _weak(labels, threshold)).alias("_weak")).agg(F.count("*").alias("n"), F.count("conf").alias("_c"))
    some = F.sum("_c").over(Window.partitionBy(F.lit(0))) > 0  # a row for each key, label and weakness
    return counts.select(*keys, F.when(some & F.col("_weak"), labels.default).otherwise(F.col("label")).alias("label"), "n").groupBy(*keys, "label").agg(F.sum("n").alias("n"))
