"""Oversampling with copies that stay apart, and complete groups for workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.config import LabelSet
from loomkit.operators.split import running_total


def _copies(rate: Column, chance: Column) -> Column:
    """Copies beside the original: the whole part of rate - 1, and one more with the chance of the rest."""
    extra = F.greatest(rate - 1, F.lit(0.0))
    return (F.floor(extra) + (chance < extra - F.floor(extra)).cast("int")).cast("int")


def oversample(samples: DataFrame, labels: LabelSet, rate: float, chance: Column, per_class: dict[str, float] | None = None) -> DataFrame:
    """samples (channel, sent_index, label, ...) with copies of minority rows; copy 0 is the original.

    Copies get the channel `<channel>#augK`, K counted over all copies of a channel. With an array column
    `rationales`, copy j takes rationale (j + 1) mod n if there are more than one.
    """
    rates = F.coalesce(*[F.when(F.col("label") == k, F.lit(float(v))) for k, v in (per_class or {}).items()], F.lit(float(rate)))
    wanted = F.when(F.col("label") != labels.default, _copies(rates, chance)).otherwise(0)
    out = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), wanted)))
    number = F.row_number().over(Window.partitionBy("channel", F.col("copy") > 0).orderBy("sent_index", "copy")) - 1
    out = out.withColumn("_k", number).withColumn("channel", F.when(F.col("copy") == 0, F.col("channel").cast("string")).otherwise(F.concat(F.col("channel").cast("string"), F.lit("#aug"), F.col("_k")))).drop("_k")
    if "rationales" in samples.columns:
        n = F.size("rationales")
        turned = F.when((F.col("copy") > 0) & (n > 1), F.pmod(F.col("copy"), n) + 1).otherwise(1)
        out = out.withColumn("rationale", F.try_element_at("rationales", turned.cast("int")))
    return out


def oversample_groups(groups: DataFrame, rate: float, chance: Column) -> DataFrame:
    """groups (id, hard, ...) with copies `<id>#dupK` of those with minority labels."""
    wanted = F.when(F.col("hard"), _copies(F.lit(float(rate)), chance)).otherwise(0)
    out = groups.withColumn("copy", F.explode(F.sequence(F.lit(0), wanted)))
    return out.withColumn("channel", F.when(F.col("copy") == 0, F.col("id").cast("string")).otherwise(F.concat(F.col("id").cast("string"), F.lit("#dup"), F.col("copy") - 1)))


def shards(groups: DataFrame, order: Column, world: int, store) -> DataFrame:
    """(id, rank): whole groups dealt round to `world` workers in order; the tail that makes them unequal is left out."""
    summed = running_total(groups, order, F.lit(1), store)
    return summed.filter(F.col("before") < world * F.floor(F.col("total") / world)).select("id", F.pmod(F.col("before"), F.lit(world)).cast("int").alias("rank"))
