"""Rank correlation of offline and external scores, and the decision that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.operators.split import running_total, spread_order
from loomkit.sources.store import stored


def spearman(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation of average ranks for each key; NaN for fewer than two rows or a constant column.

    Rows where x or y is null are left out. Ranks are those of distinct values, by a distributed running total. df is read
    once: what follows works on its distinct pairs of values. Deviations are from the mean rank, which is half of n + 1.
    """
    pairs = stored(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_k")), "pairs")
    ranked = pairs
    for name, c in (("_dx", x), ("_dy", y)):
        values = stored(pairs.groupBy(*keys, c).agg(F.sum("_k").alias("_n")), "values")
        placed = running_total(values, spread_order(values, c), F.col("_n"), stored, keys, ties=(c,))
        ranked = ranked.join(placed.select(*keys, c, (F.col("before") + (F.col("_n") - F.col("total")) / 2).cast("double").alias(name)), [*keys, c])
    k, dx, dy = F.col("_k"), F.col("_dx"), F.col("_dy")
    sums = ranked.groupBy(*keys).agg(F.sum(k).alias("n"), F.sum(k * dx * dx).alias("_vx"), F.sum(k * dy * dy).alias("_vy"), F.sum(k * dx * dy).alias("_c"))
    rho = F.when((F.col("n") < 2) | (F.col("_vx") == 0) | (F.col("_vy") == 0), F.lit(float("nan"))).otherwise(F.try_divide(F.col("_c"), F.sqrt("_vx") * F.sqrt("_vy")))
    return sums.select(*keys, "n", F.coalesce(rho, F.lit(float("nan"))).alias("rho"))


def gate(correlations: DataFrame) -> DataFrame:
    """How far a correlation is to be trusted."""
    r = F.col("rho")
    decision = F.when(F.isnan(r), "undefined").when(r >= 0.8, "trustworthy").when(r >= 0.6, "coarse").when(r >= 0.5, "weak").otherwise("abandon")
    return correlations.withColumn("decision", decision)


def anchored(metrics: DataFrame, anchors: DataFrame, least: int = 3) -> DataFrame:
    """Members with a known external score joined to their own metrics; fails with fewer than `least`."""
    joined = metrics.join(anchors.filter("external is not null"), "member")
    # members are few: one row holds them while they are counted, so metrics are worked out once
    whole = joined.agg(F.count("*").alias("anchors"), F.collect_list(F.struct(*joined.columns)).alias("_all"))
    enough = F.when(F.col("anchors") < least, F.raise_error(F.lit(f"fewer than {least} anchors")).cast("boolean")).otherwise(True)
    return whole.filter(enough).select("anchors", F.inline("_all")).select(*joined.columns, "anchors")


def ordered(configs: DataFrame, score: str = "score", tie: str = "member") -> DataFrame:
    """Place of each configuration, the best first, those without a score last. Configurations are few."""
    return configs.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), tie)))


def family_place(metrics: DataFrame, family: str, score: str, member: str) -> DataFrame:
    """Place of a member within its family by score."""
    ranked = metrics.withColumn("place", F.row_number().over(Window.partitionBy(family).orderBy(F.desc_nulls_last(score), "member")))
    return ranked.filter(F.col("member") == member).select(family, "member", "place")
